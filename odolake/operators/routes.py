"""Route extents, coordinate kinds and similar runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import NEARBY_RELATIVE, SPAN_FLOOR
from ..functions.scalars import haversine_km, normal_tags, planar_distance
from ..limits import SIMILAR_RUNS
from .frames import beside


def looks_like_degrees(a_min: Column, a_max: Column, a_mean: Column, b_min: Column, b_max: Column,
                       b_mean: Column) -> Column:
    """Two columns read as latitude and longitude: in range, spans of at most 20, and away from the origin.

    `*_mean` is the mean of the absolute values.
    """
    a_far, b_far = F.greatest(F.abs(a_min), F.abs(a_max)), F.greatest(F.abs(b_min), F.abs(b_max))
    fits = ((a_far <= 90) & (b_far <= 180)) | ((b_far <= 90) & (a_far <= 180))
    modest = ((a_max - a_min) <= 20) & ((b_max - b_min) <= 20)
    return F.coalesce(fits & modest & (F.greatest(a_mean, b_mean) >= 1.0), F.lit(False))


def latitude_first(a_far: Column, a_mean: Column, b_far: Column, b_mean: Column) -> Column:
    """True when the first of two degree columns is the latitude."""
    return F.when((a_far <= 90) & (b_far > 90), True).when((b_far <= 90) & (a_far > 90), False).otherwise(
        a_mean <= b_mean)


def swap_roles(lat_far: Column, lon_far: Column) -> Column:
    """True when named latitude and longitude columns contradict their ranges and must be exchanged."""
    return (lat_far > 90) & (lon_far <= 90)


def coordinate_stats(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """min, max and mean absolute value per coordinate column: (keys, min_i, max_i, mean_i)."""
    wanted = []
    for i, column in enumerate(columns):
        v = F.col(column).cast("double")
        wanted += [F.min(v).alias(f"min_{i}"), F.max(v).alias(f"max_{i}"), F.avg(F.abs(v)).alias(f"mean_{i}")]
    return df.groupBy(*keys).agg(*wanted) if keys else df.agg(*wanted)


def route_extents(df: DataFrame, x: str, y: str, *, geographic: bool | str = False,
                  key: str = "dataset_id") -> DataFrame:
    """Bounding box, centre and mode of every track. `geographic` is True for columns named as longitude and
    latitude, or the name of a boolean column that tells it per track."""
    vx, vy = F.col(x).cast("double"), F.col(y).cast("double")
    known = F.col(geographic) if isinstance(geographic, str) else F.lit(bool(geographic))
    out = df.groupBy(key).agg(
        F.min(vx).alias("xmin"), F.max(vx).alias("xmax"), F.avg(vx).alias("cx"),
        F.min(vy).alias("ymin"), F.max(vy).alias("ymax"), F.avg(vy).alias("cy"), F.bool_or(known).alias("__known"))
    c = {n: F.col(n) for n in ("xmin", "xmax", "ymin", "ymax")}
    degrees = looks_like_degrees(c["ymin"], c["ymax"], (F.abs(c["ymin"]) + F.abs(c["ymax"])) / 2,
                                 c["xmin"], c["xmax"], (F.abs(c["xmin"]) + F.abs(c["xmax"])) / 2)
    out = out.filter(F.col("xmin").isNotNull() & F.col("ymin").isNotNull())
    return out.withColumn("mode", F.when(F.col("__known") | degrees, "geographic").otherwise("planar")).drop("__known")


def boxes_overlap(a: str = "", b: str = "r_") -> Column:
    axes = [(F.col(f"{a}{v}max") >= F.col(f"{b}{v}min")) & (F.col(f"{a}{v}min") <= F.col(f"{b}{v}max")) for v in "xy"]
    return axes[0] & axes[1]


def _by_mode(mode: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.when(mode == "geographic", haversine_km(x1, y1, x2, y2)).otherwise(planar_distance(x1, y1, x2, y2))


def _diagonal(prefix: str) -> Column:
    corner = [F.col(f"{prefix}{n}") for n in ("xmin", "ymin", "xmax", "ymax")]
    return _by_mode(F.col(f"{prefix}mode"), *corner)


def extent_distance(df: DataFrame) -> DataFrame:
    """Adds distance, unit and relative distance of an extent to the one prefixed r_; null across modes."""
    same = F.col("mode") == F.col("r_mode")
    raw = F.when(same, _by_mode(F.col("mode"), F.col("r_cx"), F.col("r_cy"), F.col("cx"), F.col("cy")))
    scale = F.greatest(_diagonal(""), _diagonal("r_"), F.lit(SPAN_FLOOR))
    geographic = F.col("mode") == "geographic"
    return df.withColumn("__raw", raw).select(
        "*", F.when(geographic, F.round("__raw", 3)).otherwise(F.round("__raw", 2)).alias("distance"),
        F.when(same, F.when(geographic, "km").otherwise("coordinate unit")).alias("distance_unit"),
        F.round(F.col("__raw") / scale, 3).alias("relative_distance")).drop("__raw")


def similar_runs(runs: DataFrame, extents: DataFrame, catalog: DataFrame, reference_id: str,
                 limit: int = SIMILAR_RUNS) -> DataFrame:
    """Candidates to compare with one run, best first.

    runs: (signal_id, gps_id, match); extents: (dataset_id, ...) of tracks; catalog: (dataset_id, tags).
    Each candidate is set beside the one reference row; only a top-k reaches the result.
    """
    fields = ["xmin", "xmax", "ymin", "ymax", "cx", "cy", "mode"]
    placed = runs.join(extents.withColumnRenamed("dataset_id", "gps_id"), "gps_id", "left")
    tags = catalog.select(F.col("dataset_id").alias("signal_id"), normal_tags(F.col("tags")).alias("tags"))
    placed = placed.join(tags, "signal_id", "left")
    is_ref = F.col("signal_id") == reference_id
    own = placed.filter(is_ref).agg(*[F.first(c).alias(f"r_{c}") for c in fields])  # one row, nulls when unpaired
    ref_tags = tags.filter(is_ref).agg(F.first("tags").alias("r_tags"))
    measured = extent_distance(beside(beside(placed.filter(~is_ref), own), ref_tags))
    comparable = F.col("distance").isNotNull()
    overlap = F.coalesce(comparable & boxes_overlap(), F.lit(False))
    scored = measured.withColumn("overlaps", overlap).withColumn(
        "nearby", F.coalesce(F.col("overlaps") | (F.col("relative_distance") <= NEARBY_RELATIVE), F.lit(False))
    ).withColumn("same_tag", F.coalesce(F.arrays_overlap("tags", "r_tags"), F.lit(False))).withColumn(
        "recommended", F.col("nearby") | F.col("same_tag"))
    best = scored.orderBy(F.desc("overlaps"), F.desc("nearby"), F.col("distance").asc_nulls_last(), F.desc("same_tag"),
                          "signal_id").limit(int(limit))
    return best.select("signal_id", "gps_id", "match", "distance", "distance_unit", "relative_distance", "overlaps",
                       "nearby", "same_tag", "recommended", F.col("mode").alias("coord_mode"))


def track_centre(df: DataFrame, x: str, y: str, keys: list[str]) -> DataFrame:
    """Mean coordinates and the larger span of each track."""
    vx, vy = F.col(x).cast("double"), F.col(y).cast("double")
    return df.groupBy(*keys).agg(
        F.avg(vx).alias("center_x"), F.avg(vy).alias("center_y"),
        F.greatest(F.max(vx) - F.min(vx), F.max(vy) - F.min(vy)).alias("span"))
