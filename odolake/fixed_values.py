"""Patterns and constants that must equal the reference behaviour for right results."""

# Column-name patterns.
LATITUDE_NAME = r"(^|[_\-\s])(lat(itude)?|緯度)([_\-\s]|$)|gps.*lat|lat.*deg"
LONGITUDE_NAME = r"(^|[_\-\s])(lon(g(itude)?)?|lng|経度)([_\-\s]|$)|gps.*(lon|lng)|lon.*deg"
AXIS_NAME = r"(?:^|[_\-\s])(?:gps|pos(?:ition)?|coord|xyz)[_\-\s]*([xyz])(?:[_\-\s]|$)"
TIME_NAME = r"time|date|時刻|時間"
SPEED_NAME = r"speed|vehicle.*spd|車速|km.?h"
OFFSET_SIGNAL_NAME = r"speed|km\/?h|車速|rpm|回転"
CLUSTER_COLUMN_NAME = r"[\w぀-ヿ㐀-鿿][\w぀-ヿ㐀-鿿 ()-]{0,63}"

# File-name and tag patterns (Java regex syntax, case-insensitive).
FILE_EXTENSION = r"(?i)\.(csv|parquet|pq)$"
GPS_FILE_SUFFIX = r"(?i)[_\-\s]*(gps|pos(ition)?|loc(ation)?|latlon|track|位置)$"
GPS_TAG_SUFFIX = r"(?i)[_\-\s]*(gps|位置|pos(ition)?|loc(ation)?)$"
START_LONG = r"(19|20)(\d{2})[-_./]?(\d{2})[-_./]?(\d{2})[ _tT./-]*(\d{2})[-_.:]?(\d{2})[-_.:]?(\d{2})"
START_SHORT = r"(?<!\d)(\d{2})(\d{2})(\d{2})[-_ ]?(\d{2})(\d{2})(\d{2})(?!\d)"

# Numeric constants.
EARTH_RADIUS_KM = 6371.0088
COURSE_EARTH_RADIUS_M = 6371000.0
NEARBY_RELATIVE = 1.5
SPAN_FLOOR = 1e-9
FROZEN_COORD_EPSILON = 1e-10
FROZEN_MIN_SPEED = 0.5
ORIGIN_EPSILON = 1e-6
MIN_TIME_STEP = 1e-6
BOOTSTRAP_SEED = 20260721
BOOTSTRAP_ROUNDS = 2000
CLUSTER_SEED = 42
CLUSTER_RESTARTS = 4
OFFSET_GRID = 600
OFFSET_OVERLAP = 0.85
OFFSET_WEAK_SCORE = 0.4
COURSE_SEARCH_MIN = 40
COURSE_SEARCH_FACTOR = 30
DEGENERATE_MEAN = 1e-12
DEFAULT_BAND = (4.0, 8.0)
SUPPORTED_EXTENSIONS = (".csv", ".parquet", ".pq")
COHORT_METRICS = ("avg", "q50", "q75", "std", "max")
CHART_AGGREGATES = ("avg", "sum", "count", "min", "max", "median", "share")
