"""Alignment of separate logs: by row position, by nearest time, and resampling on a uniform grid."""

from __future__ import annotations

from collections.abc import Sequence as Seq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..limits import ALIGN_MEDIAN_SECONDS
from ..session import materialize
from .frames import lookup
from .ordered import Ordered
from .quantiles import quantiles

GRID_BLOCK = 4096


def by_position(left: DataFrame, right: DataFrame, keys: Seq[str] = ("pair",), pos: str = "row_pos") -> DataFrame:
    """1:1 join of two logs of a pair by row position; filters on the left keep the alignment."""
    return left.join(right, [*keys, pos])


def nearest(left: DataFrame, right: DataFrame, keys: Seq[str] = ("pair",), *, time: str = "t",
            pos: str = "row_pos") -> DataFrame:
    """For each left row the right row nearest in time: (keys, pos, right_pos, delta). Ties go to the earlier one.

    Left rows without a time are dropped. Both sides are sorted together once, right rows first at equal times,
    so a right row at the same time is the previous one with distance zero and wins.
    """
    marks = right.filter(F.col(time).isNotNull()).select(
        *keys, F.col(time).cast("double").alias("t"), F.lit(0).alias("side"), F.col(pos).alias("at"))
    probes = left.filter(F.col(time).isNotNull()).select(
        *keys, F.col(time).cast("double").alias("t"), F.lit(1).alias("side"), F.col(pos).alias("at"))
    mark = F.when(F.col("side") == 0, F.struct("t", "at"))
    merged = Ordered(marks.unionByName(probes), keys, ["t", "side", "at"])
    around = merged.last_known({"before": mark}).next_known({"after": mark}).df
    back, ahead = F.col("t") - F.col("before.t"), F.col("after.t") - F.col("t")
    choose_back = F.col("after").isNull() | (F.col("before").isNotNull() & (back <= ahead))
    found = around.filter((F.col("side") == 1) & (F.col("before").isNotNull() | F.col("after").isNotNull()))
    return found.select(*keys, F.col("at").alias(pos),
                        F.when(choose_back, F.col("before.at")).otherwise(F.col("after.at")).alias("right_pos"),
                        F.when(choose_back, back).otherwise(ahead).alias("delta"))


def nearest_in_range(left: DataFrame, right: DataFrame, keys: Seq[str] = ("pair",), *, time: str = "t",
                     pos: str = "row_pos", shift: float = 0.0) -> DataFrame:
    """Linked cursor: nearest right row to the shifted left time, only inside the right log's time span."""
    moved = left.withColumn(time, F.col(time) - F.lit(float(shift)))
    span = right.groupBy(*keys).agg(F.min(time).alias("__from"), F.max(time).alias("__to"))
    inside = lookup(moved, span, keys).filter(F.col(time).between(F.col("__from"), F.col("__to")))
    return nearest(inside.drop("__from", "__to"), right, keys, time=time, pos=pos)


def choose_alignment(aligned: DataFrame, keys: Seq[str] = ("pair",)) -> DataFrame:
    """Per pair: 'time' when the median distance is at most 30 s, else 'rowid'."""
    q = quantiles(aligned, keys, "delta", [0.5], "q")
    median = F.get("q", F.lit(0))
    return q.select(*keys, median.alias("median_delta"),
                    F.when(median <= ALIGN_MEDIAN_SECONDS, "time").otherwise("rowid").alias("align_mode"))


def align(left: DataFrame, right: DataFrame, keys: Seq[str] = ("pair",), *, time: str | None = "t",
          pos: str = "row_pos") -> DataFrame:
    """(keys, pos, right_pos, align_mode): nearest time for pairs whose clocks agree, row position for the others."""
    same = left.select(*keys, pos, F.col(pos).alias("right_pos"))
    if time is None or time not in left.columns or time not in right.columns:
        return same.withColumn("align_mode", F.lit("rowid"))
    timed = materialize(nearest(left, right, keys, time=time, pos=pos))  # the sort runs once, not per use
    modes = materialize(choose_alignment(timed, keys))  # one row per pair
    by_time = lookup(timed, modes.filter(F.col("align_mode") == "time").select(*keys, "align_mode"), keys, written=True)
    agreeing = modes.filter(F.col("align_mode") == "time").select(*keys)
    others = left.select(*keys, pos).join(agreeing, list(keys), "left_anti")
    by_row = others.select(*keys, pos, F.col(pos).alias("right_pos"), F.lit("rowid").alias("align_mode"))
    return by_time.select(*keys, pos, "right_pos", "align_mode").unionByName(by_row)


def resample(df: DataFrame, grid: DataFrame, keys: Seq[str], *, time: str = "t", value: str = "y",
             pos: str = "row_pos") -> DataFrame:
    """Linear interpolation of (time, value) at the grid times (keys, g, t); edges hold the end values."""
    samples = df.select(*keys, F.col(time).cast("double").alias("t"), F.lit(1).alias("side"),
                        F.lit(None).cast("long").alias("g"), F.col(value).cast("double").alias("y"),
                        F.col(pos).cast("long").alias("at"))
    wanted = grid.select(*keys, F.col("t").cast("double").alias("t"), F.lit(0).alias("side"),
                         F.col("g").cast("long").alias("g"), F.lit(None).cast("double").alias("y"),
                         F.col("g").cast("long").alias("at"))
    point = F.when(F.col("side") == 1, F.struct("t", "y"))
    merged = Ordered(samples.unionByName(wanted), keys, ["t", "side", "at"])
    around = merged.last_known({"a": point}).next_known({"b": point}).df.filter(F.col("side") == 0)
    share = (F.col("t") - F.col("a.t")) / (F.col("b.t") - F.col("a.t"))  # a lies strictly before t
    y = (F.when(F.col("b").isNull(), F.col("a.y")).when(F.col("a").isNull() | (F.col("b.t") == F.col("t")), F.col("b.y"))
         .otherwise(F.col("a.y") + (F.col("b.y") - F.col("a.y")) * share))
    return around.select(*keys, "g", "t", y.alias("y"))


def uniform_grid(df: DataFrame, keys: Seq[str], step: DataFrame | float, *, time: str = "t",
                 written: bool = False) -> DataFrame:
    """(keys, g, t) grid points from the first to the last time in equal steps (at least two points).

    `step` is one positive number or a (keys, dt) table. Points are made in blocks, so a long grid is never one array.
    """
    span = df.groupBy(*keys).agg(F.min(time).cast("double").alias("lo"), F.max(time).cast("double").alias("hi"))
    span = span.withColumn("dt", F.lit(float(step))) if isinstance(step, (int, float)) else lookup(
        span, step, keys, written=written)
    n = F.greatest(F.lit(2), F.floor((F.col("hi") - F.col("lo")) / F.col("dt") + 0.5) + 1).cast("long")
    blocks = span.select(*keys, "lo", "dt", n.alias("n")).withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / GRID_BLOCK))))
    first = F.col("block") * GRID_BLOCK
    points = blocks.select(*keys, "lo", "dt", F.explode(
        F.sequence(first, F.least(first + (GRID_BLOCK - 1), F.col("n") - 1))).alias("g"))
    return points.select(*keys, "g", (F.col("lo") + F.col("g") * F.col("dt")).alias("t"))
