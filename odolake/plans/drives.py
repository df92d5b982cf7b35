"""Alignment of logs, pairing, routes, tracks and course geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import asof, course, overlay, pairing, routes, tracks
from . import tables
from .registry import query, rounded

# A second logger of the same drive: the users' events again, with a clock that runs ahead by a constant.
_CLOCKS = """
sg AS (SELECT dataset_id AS pair, row_pos, epoch_us(ts) / 1e6 AS t, value, k FROM ev),
gp AS (SELECT dataset_id AS pair, row_pos, epoch_us(ts) / 1e6 + CASE WHEN user_id % 2 = 0 THEN 7.5 ELSE 40000.0 END::DOUBLE AS t, lat, lon FROM ev)"""


def _signal(spark, sf):
    ev = tables.events(spark, sf)
    return ev.select(F.col("dataset_id").alias("pair"), "row_pos",
                     (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), "value", "k")


def _gps(spark, sf):
    ev = tables.events(spark, sf)
    ahead = F.when(F.expr("cast(substr(dataset_id, 2) as int) % 2") == 0, 7.5).otherwise(40000.0)
    return ev.select(F.col("dataset_id").alias("pair"), "row_pos",
                     (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 + ahead).alias("t"), "lat", "lon")


_NEAREST = _CLOCKS + """,
p AS (SELECT s.pair, s.row_pos, s.t, g.row_pos AS prev_pos, g.t AS prev_t FROM sg s ASOF LEFT JOIN gp g ON s.pair = g.pair AND s.t >= g.t),
n AS (SELECT p.*, g.row_pos AS next_pos, g.t AS next_t FROM p ASOF LEFT JOIN gp g ON p.pair = g.pair AND p.t <= g.t),
m AS (SELECT pair, row_pos, CASE WHEN next_pos IS NULL OR t - prev_t <= next_t - t THEN prev_pos ELSE next_pos END AS right_pos,
        CASE WHEN next_pos IS NULL OR t - prev_t <= next_t - t THEN t - prev_t ELSE next_t - t END AS delta
      FROM n WHERE prev_pos IS NOT NULL OR next_pos IS NOT NULL),
d AS (SELECT pair, quantile_cont(delta, 0.5) AS median_delta FROM m GROUP BY 1)"""


@query("asof_nearest", _NEAREST + " SELECT pair, row_pos, right_pos, round(delta, 4) AS delta FROM m")
def asof_nearest(spark, sf):
    return rounded(asof.nearest(_signal(spark, sf), _gps(spark, sf)), 4)


@query("alignment_choice", _NEAREST + """
SELECT pair, round(median_delta, 4) AS median_delta, CASE WHEN median_delta <= 30 THEN 'time' ELSE 'rowid' END AS align_mode FROM d""")
def alignment_choice(spark, sf):
    return rounded(asof.choose_alignment(asof.nearest(_signal(spark, sf), _gps(spark, sf))), 4)


@query("positional_join", _CLOCKS + """
SELECT sg.pair, sg.row_pos, value, round(lat, 6) AS lat, round(lon, 6) AS lon FROM sg JOIN gp USING (pair, row_pos) WHERE k >= 30.0""")
def positional_join(spark, sf):
    left = _signal(spark, sf).filter("k >= 30.0D").select("pair", "row_pos", "value")
    return rounded(asof.by_position(left, _gps(spark, sf).select("pair", "row_pos", "lat", "lon")))


@query("nearest_in_range", """
l AS (SELECT event_type AS pair, row_pos, elapsed + 3600.0 AS t FROM ev),
g AS (SELECT event_type AS pair, row_pos, elapsed AS t FROM ev WHERE k >= 50.0),
s AS (SELECT pair, min(t) AS lo, max(t) AS hi FROM g GROUP BY 1),
i AS (SELECT l.* FROM l JOIN s USING (pair) WHERE t BETWEEN lo AND hi),
p AS (SELECT i.*, g.row_pos AS prev_pos, g.t AS prev_t FROM i ASOF LEFT JOIN g ON i.pair = g.pair AND i.t >= g.t),
n AS (SELECT p.*, g.row_pos AS next_pos, g.t AS next_t FROM p ASOF LEFT JOIN g ON p.pair = g.pair AND p.t <= g.t)
SELECT pair, row_pos, CASE WHEN t - prev_t <= next_t - t THEN prev_pos ELSE next_pos END AS right_pos,
  round(least(t - prev_t, next_t - t), 4) AS delta FROM n""")
def nearest_in_range(spark, sf):
    """Linked cursor: events one hour later, inside the span of the other log."""
    ev = tables.events(spark, sf).select(F.col("event_type").alias("pair"), "row_pos", F.col("elapsed").alias("t"), "k")
    return rounded(asof.nearest_in_range(ev.select("pair", "row_pos", "t"), ev.filter("k >= 50.0D").drop("k"), shift=-3600.0), 4)


@query("resampled_series", """
s AS (SELECT dataset_id, min(elapsed) AS lo, max(elapsed) AS hi FROM ev GROUP BY 1),
g AS (SELECT dataset_id, unnest(range(greatest(2, CAST(floor((hi - lo) / 21600.0 + 0.5) AS BIGINT) + 1))) AS g, lo FROM s),
t AS (SELECT dataset_id, g, lo + g * 21600.0::DOUBLE AS t FROM g),
v AS (SELECT dataset_id, row_pos, elapsed AS t, value AS y FROM ev),
a AS (SELECT t.*, v.t AS t0, v.y AS y0 FROM t ASOF LEFT JOIN v ON t.dataset_id = v.dataset_id AND t.t > v.t),
b AS (SELECT a.*, v.t AS t1, v.y AS y1 FROM a ASOF LEFT JOIN v ON a.dataset_id = v.dataset_id AND a.t <= v.t)
SELECT dataset_id, g, round(t, 4) AS t, round(CASE WHEN t1 IS NULL THEN y0 WHEN t0 IS NULL OR t1 = t THEN y1
  ELSE y0 + (y1 - y0) * ((t - t0) / (t1 - t0)) END, 6) AS y FROM b""")
def resampled_series(spark, sf):
    """Every user's value on a six-hour grid."""
    rows = tables.events(spark, sf).select("dataset_id", "row_pos", F.col("elapsed").alias("t"), F.col("value").alias("y"))
    grid = asof.uniform_grid(rows, ["dataset_id"], 21600.0)
    out = asof.resample(rows, grid, ["dataset_id"])
    return out.select("dataset_id", "g", F.round("t", 4).alias("t"), F.round("y", 6).alias("y"))


@query("track_join", _NEAREST + """,
w AS (SELECT sg.*, row_number() OVER (PARTITION BY pair ORDER BY row_pos) AS rn FROM sg WHERE k >= 10.0),
wp AS (SELECT w.pair, w.row_pos, w.t, g.row_pos AS prev_pos, g.t AS prev_t FROM w ASOF LEFT JOIN gp g ON w.pair = g.pair AND w.t >= g.t),
wn AS (SELECT wp.*, g.row_pos AS next_pos, g.t AS next_t FROM wp ASOF LEFT JOIN gp g ON wp.pair = g.pair AND wp.t <= g.t),
wm AS (SELECT pair, row_pos, CASE WHEN next_pos IS NULL OR t - prev_t <= next_t - t THEN prev_pos ELSE next_pos END AS right_pos,
         CASE WHEN next_pos IS NULL OR t - prev_t <= next_t - t THEN t - prev_t ELSE next_t - t END AS delta
       FROM wn WHERE prev_pos IS NOT NULL OR next_pos IS NOT NULL),
wd AS (SELECT pair FROM wm GROUP BY 1 HAVING quantile_cont(delta, 0.5) <= 30),
x AS (SELECT pair, row_pos, right_pos, 'time' AS align_mode FROM wm WHERE pair IN (SELECT pair FROM wd)
      UNION ALL SELECT pair, row_pos, row_pos, 'rowid' FROM w WHERE pair NOT IN (SELECT pair FROM wd)),
j AS (SELECT w.pair, w.row_pos, w.rn, w.value, gp.lat, gp.lon, align_mode, count(*) OVER (PARTITION BY w.pair) AS total_rows
      FROM w JOIN x USING (pair, row_pos) JOIN gp ON gp.pair = w.pair AND gp.row_pos = x.right_pos),
s AS (SELECT *, greatest(1, CAST(ceil(total_rows / 40.0) AS BIGINT)) AS stride FROM j)
SELECT pair, row_pos, value, round(lat, 6) AS lat, round(lon, 6) AS lon, align_mode, total_rows, stride FROM s WHERE (rn - 1) % stride = 0""")
def track_join(spark, sf):
    """Signals with positions for all pairs: by time where the clocks agree, else by row position."""
    out = tracks.join_track(_signal(spark, sf), _gps(spark, sf), ["value"], ["lat", "lon"],
                            filters=[{"column": "k", "op": "ge", "value": 10}], max_points=40,
                            signal_seconds=F.col("t"), gps_seconds=F.col("t"))
    return rounded(out)


_EXTENTS = """
e AS (SELECT dataset_id, min(lon) AS xmin, max(lon) AS xmax, avg(lon) AS cx, min(lat) AS ymin, max(lat) AS ymax, avg(lat) AS cy FROM ev GROUP BY 1)"""


@query("route_extents", _EXTENTS + """
SELECT dataset_id, round(xmin, 6) AS xmin, round(xmax, 6) AS xmax, round(cx, 6) AS cx, round(ymin, 6) AS ymin, round(ymax, 6) AS ymax,
  round(cy, 6) AS cy, 'geographic' AS mode FROM e""")
def route_extents(spark, sf):
    """Extents with the mode read from the values."""
    return rounded(routes.route_extents(tables.events(spark, sf), "lon", "lat"))


def _haversine(x1, y1, x2, y2):
    h = (f"power(sin(radians({y2} - {y1}) / 2), 2) + cos(radians({y1})) * cos(radians({y2})) "
         f"* power(sin(radians({x2} - {x1}) / 2), 2)")
    return f"2 * 6371.0088 * asin(least(1.0, sqrt({h})))"


@query("similar_runs", _EXTENTS + f""",
r AS (SELECT e.*, cat.tags FROM e JOIN cat USING (dataset_id) WHERE dataset_id = 'u1'),
d AS (SELECT e.dataset_id, {_haversine('r.cx', 'r.cy', 'e.cx', 'e.cy')} AS raw,
    greatest({_haversine('r.xmin', 'r.ymin', 'r.xmax', 'r.ymax')}, {_haversine('e.xmin', 'e.ymin', 'e.xmax', 'e.ymax')}, 1e-9) AS size,
    NOT (e.xmax < r.xmin OR e.xmin > r.xmax OR e.ymax < r.ymin OR e.ymin > r.ymax) AS "overlaps",
    len(list_intersect(cat.tags, r.tags)) > 0 AS same_tag
  FROM e JOIN cat USING (dataset_id), r WHERE e.dataset_id <> 'u1'),
s AS (SELECT *, round(raw, 3) AS distance, round(raw / size, 3) AS relative_distance, "overlaps" OR round(raw / size, 3) <= 1.5 AS nearby FROM d)
SELECT dataset_id AS signal_id, distance, relative_distance, "overlaps", nearby, same_tag, nearby OR same_tag AS recommended
FROM s ORDER BY "overlaps" DESC, nearby DESC, distance, same_tag DESC, dataset_id LIMIT 10""")
def similar_runs(spark, sf):
    cat = tables.catalog(spark, sf)
    runs = cat.select(F.col("dataset_id").alias("signal_id"), F.col("dataset_id").alias("gps_id"), F.lit("self").alias("match"))
    extents = routes.route_extents(tables.events(spark, sf), "lon", "lat", geographic=True)
    out = routes.similar_runs(runs, extents, cat, "u1")
    return out.select("signal_id", "distance", "relative_distance", "overlaps", "nearby", "same_tag", "recommended")


@query("coordinate_roles", """
s AS (SELECT dataset_id, max(abs(lon)) AS af, avg(abs(lon)) AS am, max(lon) - min(lon) AS asp, max(abs(lat)) AS bf, avg(abs(lat)) AS bm,
        max(lat) - min(lat) AS bsp FROM ev GROUP BY 1)
SELECT dataset_id, ((af <= 90 AND bf <= 180) OR (bf <= 90 AND af <= 180)) AND asp <= 20 AND bsp <= 20 AND greatest(am, bm) >= 1 AS degrees,
  CASE WHEN af <= 90 AND bf > 90 THEN true WHEN bf <= 90 AND af > 90 THEN false ELSE am <= bm END AS first_is_latitude,
  bf > 90 AND af <= 90 AS swapped FROM s""")
def coordinate_roles(spark, sf):
    """Which recordings hold degrees, and which of two unnamed columns is the latitude."""
    stats = routes.coordinate_stats(tables.events(spark, sf), ["dataset_id"], ["lon", "lat"])
    c = {n: F.col(n) for n in ("min_0", "max_0", "mean_0", "min_1", "max_1", "mean_1")}
    far = [F.greatest(F.abs(f"min_{i}"), F.abs(f"max_{i}")) for i in range(2)]
    return stats.select("dataset_id", routes.looks_like_degrees(*c.values()).alias("degrees"),
                        routes.latitude_first(far[0], c["mean_0"], far[1], c["mean_1"]).alias("first_is_latitude"),
                        routes.swap_roles(far[1], far[0]).alias("swapped"))


@query("track_centres", """
SELECT dataset_id, round(avg(lon), 6) AS center_x, round(avg(lat), 6) AS center_y,
  round(greatest(max(lon) - min(lon), max(lat) - min(lat)), 6) AS span FROM ev GROUP BY 1""")
def track_centres(spark, sf):
    return rounded(routes.track_centre(tables.events(spark, sf), "lon", "lat", ["dataset_id"]))


_LOGS = """
lg AS (SELECT 'o' || CAST(o_orderkey AS VARCHAR) AS dataset_id, o_orderkey,
   CASE o_orderkey % 5 WHEN 0 THEN 'drive' || CAST(o_custkey AS VARCHAR) || '.csv' WHEN 1 THEN 'drive' || CAST(o_custkey AS VARCHAR) || '_GPS.csv'
     WHEN 2 THEN strftime(o_orderdate, '%y%m%d') || '_0000' || lpad(CAST(o_custkey % 60 AS VARCHAR), 2, '0')
     WHEN 3 THEN 'gps_' || strftime(o_orderdate, '%Y-%m-%d') || '_00-00-' || lpad(CAST(o_custkey % 60 AS VARCHAR), 2, '0')
     ELSE 'car' || CAST(o_orderkey AS VARCHAR) END AS name,
   o_orderkey % 5 IN (1, 3) OR o_orderkey % 35 = 4 AS is_gps, o_orderkey % 35 = 4 AS extra,
   CASE o_orderkey % 5 WHEN 1 THEN 'maker' || CAST(o_custkey % 10 AS VARCHAR) || '_gps' WHEN 3 THEN 'fleet' || CAST(o_custkey % 10 AS VARCHAR) || '_gps'
     WHEN 2 THEN 'fleet' || CAST(o_orderkey % 10 AS VARCHAR) ELSE 'maker' || CAST(o_orderkey % 10 AS VARCHAR) END AS tag FROM orders),
kk AS (SELECT *, CASE o_orderkey % 5 WHEN 0 THEN regexp_replace(name, '\\.csv$', '') WHEN 1 THEN regexp_replace(name, '_GPS\\.csv$', '') ELSE name END AS base,
   CASE WHEN o_orderkey % 5 = 2 THEN epoch(strptime('20' || name, '%Y%m%d_%H%M%S')) WHEN o_orderkey % 5 = 3 THEN epoch(strptime(name, 'gps_%Y-%m-%d_%H-%M-%S')) END AS start,
   regexp_replace(tag, '_gps$', '') AS tagbase FROM lg)"""


def _logs(spark, sf):
    """A catalog of recordings, one per order, whose names and tags follow four loggers' habits."""
    o = tables.table(spark, sf, "orders")
    style, cust = F.col("o_orderkey") % 5, F.col("o_custkey")
    second = F.lpad((cust % 60).cast("string"), 2, "0")
    name = (F.when(style == 0, F.concat(F.lit("drive"), cust, F.lit(".csv"))).when(style == 1, F.concat(F.lit("drive"), cust, F.lit("_GPS.csv")))
            .when(style == 2, F.concat(F.date_format("o_orderdate", "yyMMdd"), F.lit("_0000"), second))
            .when(style == 3, F.concat(F.lit("gps_"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("_00-00-"), second))
            .otherwise(F.concat(F.lit("car"), F.col("o_orderkey"))))
    extra = F.col("o_orderkey") % 35 == 4
    tag = (F.when(style == 1, F.concat(F.lit("maker"), cust % 10, F.lit("_gps"))).when(style == 3, F.concat(F.lit("fleet"), cust % 10, F.lit("_gps")))
           .when(style == 2, F.concat(F.lit("fleet"), F.col("o_orderkey") % 10)).otherwise(F.concat(F.lit("maker"), F.col("o_orderkey") % 10)))
    return o.select(F.concat(F.lit("o"), F.col("o_orderkey")).alias("dataset_id"), name.alias("name"), name.alias("original_filename"),
                    F.array(tag).alias("tags"), F.timestamp_seconds(F.col("o_orderkey")).alias("created_at"),
                    F.when(style.isin(1, 3) | extra, "latlon").otherwise("none").alias("coord_kind"), extra.alias("extra_signals"))


@query("gps_logs", _LOGS + " SELECT dataset_id, name FROM lg WHERE is_gps")
def gps_logs(spark, sf):
    return pairing.list_gps(_logs(spark, sf)).select("dataset_id", "name")


@query("gps_pairs", _LOGS + """,
sig AS (SELECT * FROM kk WHERE NOT is_gps OR extra), gps AS (SELECT * FROM kk WHERE is_gps),
nm AS (SELECT s.dataset_id AS signal_id, g.dataset_id AS gps_id, 0 AS kind, CASE WHEN g.tagbase = s.tag THEN 0 ELSE 1 END AS tr, 0 AS gap, g.o_orderkey AS place
       FROM sig s JOIN gps g ON s.base = g.base AND s.dataset_id <> g.dataset_id),
tm AS (SELECT s.dataset_id AS signal_id, g.dataset_id AS gps_id, 1 AS kind, CASE WHEN g.tagbase = s.tag THEN 0 ELSE 1 END AS tr, abs(g.start - s.start) AS gap, g.o_orderkey AS place
       FROM sig s JOIN gps g ON abs(g.start - s.start) <= 2 AND s.dataset_id <> g.dataset_id),
tg AS (SELECT s.dataset_id AS signal_id, min(g.dataset_id) AS gps_id, 2 AS kind, 0 AS tr, 0 AS gap, 0 AS place FROM sig s
       JOIN gps g ON g.tagbase = s.tag AND s.dataset_id <> g.dataset_id GROUP BY 1 HAVING count(*) = 1),
me AS (SELECT dataset_id AS signal_id, dataset_id AS gps_id, 3 AS kind, 0 AS tr, 0 AS gap, 0 AS place FROM sig WHERE is_gps AND extra),
al AS (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY kind, tr, gap, place DESC) AS rn
       FROM (SELECT * FROM nm UNION ALL SELECT * FROM tm UNION ALL SELECT * FROM tg UNION ALL SELECT * FROM me))
SELECT signal_id, gps_id, CASE kind WHEN 0 THEN 'name' WHEN 1 THEN 'timestamp' WHEN 2 THEN 'tag' ELSE 'self' END AS "match" FROM al WHERE rn = 1""")
def gps_pairs(spark, sf):
    return pairing.gps_pairs(_logs(spark, sf))


_COURSE_ROWS = """
c0 AS (SELECT dataset_id AS run, row_pos, epoch_us(ts) / 1e6 AS t, k AS speed,
   CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'signup' THEN 0.0 ELSE CASE WHEN k < 50 THEN 139.5 ELSE lon END END::DOUBLE AS x,
   CASE WHEN event_type = 'signup' THEN 0.0 ELSE CASE WHEN k < 50 THEN 35.5 ELSE lat END END::DOUBLE AS y FROM ev)"""


def _course_rows(spark, sf):
    """Positions with missing, zero and frozen stretches."""
    ev = tables.events(spark, sf)
    kind = F.col("event_type")
    x = F.when(kind == "error", None).when(kind == "signup", 0.0).when(F.col("k") < 50, 139.5).otherwise(F.col("lon"))
    y = F.when(kind == "signup", 0.0).when(F.col("k") < 50, 35.5).otherwise(F.col("lat"))
    return ev.select(F.col("dataset_id").alias("run"), "row_pos", "ts", F.col("k").alias("speed"), x.alias("x"), y.alias("y"))


@query("absolute_clock", """
SELECT dataset_id AS run, row_pos, round(epoch_us(date_trunc('second', ts)) / 1e6 + k, 3) AS seconds FROM ev""")
def absolute_clock(spark, sf):
    """Seconds on the shared clock: the start time in the file name plus an elapsed column."""
    ev = tables.events(spark, sf)
    name = F.concat(F.lit("log_"), F.date_format("ts", "yyyy-MM-dd_HH-mm-ss"), F.lit(".csv"))
    rows = ev.select(F.col("dataset_id").alias("run"), "row_pos", F.col("k").alias("elapsed_time"), name.alias("file"))
    return rounded(rows.select("run", "row_pos", tracks.absolute_seconds(rows, "file").alias("seconds")), 3)


@query("elapsed_timeline", """
SELECT dataset_id AS run, row_pos, round(t - first_value(t) OVER (PARTITION BY dataset_id ORDER BY row_pos), 4) AS seconds
FROM (SELECT *, epoch_us(ts) / 1e6 AS t FROM ev)""")
def elapsed_timeline(spark, sf):
    rows = tables.events(spark, sf).select(F.col("dataset_id").alias("run"), "row_pos", "ts")
    return rounded(course.timeline(rows, "ts").drop("ts"), 4)


@query("elapsed_text_times", """
SELECT dataset_id AS run, row_pos, round(CASE user_id % 4 WHEN 3 THEN i - 1 ELSE t - first_value(t) OVER (PARTITION BY dataset_id ORDER BY row_pos) END, 3) AS seconds
FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY row_pos) AS i,
        CASE user_id % 4 WHEN 2 THEN row_pos / 100.0::DOUBLE ELSE floor(epoch_us(ts) / 1e6) END AS t FROM ev)""")
def elapsed_text_times(spark, sf):
    """Times written as text: dates with dashes or slashes, numbers, and runs that hold an unreadable one."""
    ev = tables.events(spark, sf)
    style = F.substr("dataset_id", F.lit(2)).cast("int") % 4
    text = (F.when(style == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(style == 1, F.date_format("ts", "yyyy/MM/dd HH:mm:ss"))
            .when(style == 2, (F.col("row_pos") / 100.0).cast("string")).otherwise(F.concat(F.lit("at "), F.col("ts").cast("string"))))
    rows = ev.select(F.col("dataset_id").alias("run"), "row_pos", text.alias("time"))
    return rounded(course.timeline(rows, "time").drop("time"), 3)


@query("elapsed_milliseconds", """
SELECT event_type AS run, row_pos, round((t - first_value(t) OVER (PARTITION BY event_type ORDER BY row_pos)) / 1000.0::DOUBLE, 6) AS seconds
FROM (SELECT *, epoch_us(ts) / 1000.0::DOUBLE AS t FROM ev)""")
def elapsed_milliseconds(spark, sf):
    """Numeric times that are milliseconds by their size."""
    ev = tables.events(spark, sf)
    rows = ev.select(F.col("event_type").alias("run"), "row_pos", (F.unix_micros(F.col("ts").cast("timestamp")) / 1000.0).alias("ms"))
    return rounded(course.timeline(rows, "ms").drop("ms"))


@query("course_progress", _COURSE_ROWS + """,
c1 AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY row_pos) AS i, t - first_value(t) OVER (PARTITION BY run ORDER BY row_pos) AS s,
   coalesce(x IS NOT NULL AND y IS NOT NULL AND abs(y) <= 90 AND abs(x) <= 180 AND (abs(x) > 1e-6 OR abs(y) > 1e-6), false) AS ok FROM c0),
v AS (SELECT run, i, lag(x) OVER w AS px, lag(y) OVER w AS py FROM c1 WHERE ok WINDOW w AS (PARTITION BY run ORDER BY i)),
c2 AS (SELECT c1.*, ok AND NOT coalesce(abs(x - px) < 1e-10 AND abs(y - py) < 1e-10 AND speed > 0.5, false) AS good,
   lag(s) OVER w AS ps, lag(speed) OVER w AS pv FROM c1 LEFT JOIN v USING (run, i) WINDOW w AS (PARTITION BY run ORDER BY i)),
c3 AS (SELECT *, CASE WHEN ps IS NULL THEN 0.0 WHEN (pv + speed) / 2.0 > 0 THEN (pv + speed) / 2.0 * greatest(1e-6, s - ps) ELSE greatest(1e-6, s - ps) END::DOUBLE AS wt FROM c2),
c4 AS (SELECT *, sum(wt) OVER (PARTITION BY run ORDER BY i) AS cum FROM c3),
c5 AS (SELECT *, max(CASE WHEN good THEN i END) OVER (PARTITION BY run ORDER BY i) AS ai,
   min(CASE WHEN good THEN i END) OVER (PARTITION BY run ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS bi FROM c4),
c6 AS (SELECT c5.*, a.x AS ax, a.y AS ay, a.cum AS ac, b.x AS bx, b.y AS byy, b.cum AS bc FROM c5
   LEFT JOIN c4 a ON a.run = c5.run AND a.i = c5.ai LEFT JOIN c4 b ON b.run = c5.run AND b.i = c5.bi),
c7 AS (SELECT *, CASE WHEN good THEN x WHEN ai IS NULL THEN bx WHEN bi IS NULL THEN ax ELSE ax + (bx - ax) * ((cum - ac) / (bc - ac)) END AS fx,
   CASE WHEN good THEN y WHEN ai IS NULL THEN byy WHEN bi IS NULL THEN ay ELSE ay + (byy - ay) * ((cum - ac) / (bc - ac)) END AS fy FROM c6),
c8 AS (SELECT *, lag(fx) OVER w AS qx, lag(fy) OVER w AS qy FROM c7 WINDOW w AS (PARTITION BY run ORDER BY i)),
c9 AS (SELECT *, power(sin(radians(fy - qy) / 2), 2) + cos(radians(qy)) * cos(radians(fy)) * power(sin(radians(fx - qx) / 2), 2) AS h FROM c8),
c10 AS (SELECT *, sum(coalesce(2 * 6371000.0 * atan2(sqrt(h), sqrt(greatest(0, 1 - h))), 0)) OVER (PARTITION BY run ORDER BY i) AS dist FROM c9)
SELECT run, row_pos, NOT good AS estimated, round(fx, 6) AS filled_x, round(fy, 6) AS filled_y, round(dist, 3) AS distance,
  round(dist / max(dist) OVER (PARTITION BY run), 6) AS progress, count(*) FILTER (WHERE NOT good) OVER (PARTITION BY run) AS estimated_count FROM c10""")
def course_progress(spark, sf):
    """Bad positions found, gaps filled by driven distance, and progress along each drive."""
    rows = course.timeline(_course_rows(spark, sf), "ts")
    out = course.course_axis(rows, "x", "y", speed="speed")
    return out.select("run", "row_pos", "estimated", F.round("filled_x", 6).alias("filled_x"), F.round("filled_y", 6).alias("filled_y"),
                      F.round("distance", 3).alias("distance"), F.round("progress", 6).alias("progress"), "estimated_count")


@query("matched_course")
def matched_course(spark, sf):
    """Odd users' drives placed on the course of the user before them."""
    rows = course.course_axis(course.timeline(_course_rows(spark, sf), "ts"), "x", "y", speed="speed")
    number = F.substring("run", 2, 9).cast("int")
    pair = F.floor(number / 2).cast("int")
    columns = ["row_pos", "filled_x", "filled_y", "progress"]
    a = rows.filter(number % 2 == 0).select(pair.alias("pair"), *columns)
    b = rows.filter(number % 2 == 1).select(pair.alias("pair"), *columns)
    return course.match_course(a, b)


@query("signal_offsets")
def signal_offsets(spark, sf):
    """Time offset between every user's series and the series of the next event-rich user."""
    ev = tables.events(spark, sf)
    number = F.substring("dataset_id", 2, 9).cast("int")
    side = ev.select(F.floor(number / 2).cast("int").alias("pair"), (number % 2).alias("side"), "row_pos",
                     F.col("elapsed").alias("t"), F.col("value").alias("y"))
    return overlay.best_offset(side.filter("side = 0").drop("side"), side.filter("side = 1").drop("side"))
