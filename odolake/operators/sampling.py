"""Even-stride sampling, ordered previews and top-k."""

from __future__ import annotations

from collections.abc import Sequence as Seq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import plain_number
from ..limits import COHORT_SAMPLE_ROWS, PREVIEW_DEFAULT, PREVIEW_MAX, clamp_points, require
from .filters import apply_filters
from .frames import beside, require_columns
from .ordered import Ordered

DATASET = ("dataset_id",)
SPREAD_PARTS = 256


def every_stride(df: DataFrame, keys: Seq[str], order: Seq[str], limit: int, *, floor: bool = False,
                 split: bool | None = None) -> DataFrame:
    """Rows 1, 1+stride, 1+2*stride ... of each key, with rn, total_rows and stride.

    stride = ceil(total / limit), or floor when the caller accepts up to twice the limit.
    """
    numbered = Ordered(df, keys, order, split=split).row_number("rn", "total_rows").df
    share = F.col("total_rows") / F.lit(limit)
    stride = F.greatest(F.lit(1), F.floor(share) if floor else F.ceil(share)).cast("long")
    return numbered.withColumn("stride", stride).filter((F.col("rn") - 1) % F.col("stride") == 0)


def timeseries(df: DataFrame, x: str, ys: Seq[str], filters: list[dict] | None = None,
               max_points: int | None = None, *, keys: Seq[str] = DATASET, tie: str = "row_pos") -> DataFrame:
    """Filtered rows of every recording in the order of x, thinned to about `max_points` per recording."""
    require(bool(ys), "choose at least one column for y")
    require_columns(df, x, *ys)
    wanted = list(dict.fromkeys([*keys, x, *ys, tie]))
    rows = apply_filters(df, filters).select(*wanted)
    return every_stride(rows, keys, [x, tie], clamp_points(max_points))


def scatter(df: DataFrame, x: str, y: str, color: str | None = None, filters: list[dict] | None = None,
            max_points: int | None = None, *, keys: Seq[str] = DATASET, tie: str = "row_pos") -> DataFrame:
    """Filtered rows in recorded order, thinned by the same stride."""
    require_columns(df, x, y, color)
    wanted = list(dict.fromkeys([*keys, x, y, *([color] if color else []), tie]))
    rows = apply_filters(df, filters).select(*wanted)
    return every_stride(rows, keys, [tie], clamp_points(max_points))


def group_sample(df: DataFrame, keys: Seq[str], order: Seq[str], rows: int = COHORT_SAMPLE_ROWS) -> DataFrame:
    """About `rows` (fewer than twice as many) evenly spaced rows of each group."""
    return every_stride(df, keys, order, rows, floor=True)


def preview(df: DataFrame, limit: int = PREVIEW_DEFAULT, *, tie: str = "row_pos") -> DataFrame:
    return df.orderBy(tie).limit(min(int(limit), PREVIEW_MAX))


def top_rows(df: DataFrame, keys: Seq[str], order: Seq[Column], n: int, name: str = "rank", *,
             spread: str | None = None) -> DataFrame:
    """First n rows of each key. Only a per-task top-n is shuffled.

    Spark pushes that bound down for up to 1000 rows. A larger n names a column to `spread` a key over: its
    parts are cut to n rows each before they meet.
    """
    if not keys:
        return df.orderBy(*order).limit(n).withColumn(name, F.row_number().over(Window.orderBy(*order)))
    if spread is not None:
        part = F.pmod(F.xxhash64(spread), F.lit(SPREAD_PARTS))
        within = F.row_number().over(Window.partitionBy(*keys, part).orderBy(*order))
        df = df.withColumn(name, within).filter(F.col(name) <= n).drop(name)
    # the optimizer pushes the row_number bound below the shuffle (WindowGroupLimit)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(name, rank).filter(F.col(name) <= n)


def fold_colors(df: DataFrame, color: str, keys: Seq[str] = (), keep: int = 8, *, by_count: bool = True) -> DataFrame:
    """Adds `series`: the colour label, or 'other' beyond the `keep` largest ones.

    `by_count=False` keeps numeric labels in numeric order when all labels are numbers, and folds only
    when there are more than keep + 1 series, as the chart builder does.
    """
    label = F.coalesce(F.col(color).cast("string"), F.lit("(null)"))
    rows = df.withColumn("__label", label)
    counts = rows.groupBy(*keys, "__label").agg(F.count(F.lit(1)).alias("__n"))
    by_size = [F.desc("__n"), F.asc("__label")]
    if by_count:
        kept = top_rows(counts, keys, by_size, keep, "__rank")
    else:
        number = plain_number(F.col("__label"))
        shape = counts.groupBy(*keys).agg(
            F.bool_and((F.col("__label") == "(null)") | number.isNotNull()).alias("__numeric"),
            F.count(F.lit(1)).alias("__labels"))
        counts = counts.join(shape, list(keys)) if keys else beside(counts, shape)
        order = [F.when(F.col("__numeric"), number).asc_nulls_last(), *by_size]
        kept = top_rows(counts, keys, order, keep + 1, "__rank").filter(
            (F.col("__rank") <= keep) | (F.col("__labels") <= keep + 1))
    kept = F.broadcast(kept.select(*keys, "__label", F.lit(True).alias("__kept"))) if not keys else \
        kept.select(*keys, "__label", F.lit(True).alias("__kept"))  # keyless: at most keep + 1 rows
    out = rows.join(kept, [*keys, "__label"], "left")
    series = F.when(F.col("__kept"), F.col("__label")).otherwise("other")
    return out.withColumn("series", series).drop("__label", "__kept")
