"""Equal-width binning: ranges, bin numbers, zero-filled histograms and 2-D densities."""

from __future__ import annotations

from collections.abc import Sequence as Seq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..limits import CATEGORY_LABELS, clamp_bins, require
from .filters import apply_filters
from .frames import beside, lookup
from .sampling import top_rows
from .schema import dtype_of, require_numeric
from ..functions.scalars import category, plain_number, ratio


def value_range(df: DataFrame, columns: Seq[str], bins: Seq[int], keys: Seq[str] = ()) -> DataFrame:
    """(keys, lo_c, width_c) per column. An empty range is widened to 1; groups without values are dropped.

    Without keys the one row is computed here, so that edges and bins use it without another scan.
    """
    aggregates = []
    for i, column in enumerate(columns):
        aggregates += [F.min(column).cast("double").alias(f"lo_{i}"), F.max(column).cast("double").alias(f"hi_{i}")]
    out = df.groupBy(*keys).agg(*aggregates) if keys else df.agg(*aggregates)
    for i, n in enumerate(bins):
        hi = F.when(F.col(f"hi_{i}") == F.col(f"lo_{i}"), F.col(f"lo_{i}") + 1).otherwise(F.col(f"hi_{i}"))
        out = out.withColumn(f"width_{i}", (hi - F.col(f"lo_{i}")) / F.lit(n)).filter(F.col(f"lo_{i}").isNotNull())
    out = out.drop(*[f"hi_{i}" for i in range(len(columns))])
    return out if keys else df.sparkSession.createDataFrame(out.collect(), out.schema)


def bin_of(column: str, i: int, bins: int, clamp_low: bool = False) -> Column:
    raw = F.floor((F.col(column).cast("double") - F.col(f"lo_{i}")) / F.col(f"width_{i}")).cast("int")
    out = F.least(raw, F.lit(bins - 1))
    return F.greatest(out, F.lit(0)) if clamp_low else out


def bin_grid(ranges: DataFrame, bins: int, keys: Seq[str] = (), i: int = 0, name: str = "bin") -> DataFrame:
    """One row per bin with its edges and centre."""
    grid = ranges.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    lo, width = F.col(f"lo_{i}"), F.col(f"width_{i}")
    return grid.select(*keys, name, (lo + width * F.col(name)).alias("lower"),
                       (lo + width * (F.col(name) + 1)).alias("upper"))


def histogram(df: DataFrame, column: str, bins: int = 40, filters: list[dict] | None = None, *,
              keys: Seq[str] = ()) -> DataFrame:
    """Counts per bin, zero-filled. With `keys`, every group has its own edges."""
    require_numeric(df, column)
    n = clamp_bins(bins)
    rows = apply_filters(df, filters).select(*keys, column).filter(F.col(column).isNotNull())
    ranges = value_range(rows, [column], [n], keys)
    binned = lookup(rows, ranges, keys).withColumn("bin", bin_of(column, 0, n))
    counts = binned.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("count"))
    filled = bin_grid(ranges, n, keys).join(counts, [*keys, "bin"], "left")
    return filled.withColumn("count", F.coalesce("count", F.lit(0)))


def label_counts(df: DataFrame, column: str, keys: Seq[str] = (), name: str = "label") -> DataFrame:
    label = category(F.col(column), dtype_of(df, column))
    return df.select(*keys, label.alias(name)).groupBy(*keys, name).agg(F.count(F.lit(1)).alias("count"))


def top_labels(totals: DataFrame, limit: int, label: str = "label", total: str = "total", *,
               keys: Seq[str] = (), numeric_order: str | None = "label") -> DataFrame:
    """The `limit` largest labels with `axis`, their 0-based place on the axis.

    numeric_order: "label" orders by number when all labels are numbers, else by label; "count" orders by
    number when possible, else keeps count order; None always keeps count order. Ties go by label.
    """
    by_count = [F.desc(total), F.col(label).asc_nulls_last()]
    top = top_rows(totals, keys, by_count, limit, "__rank")
    if numeric_order is None:
        return top.withColumn("axis", (F.col("__rank") - 1).cast("int")).drop("__rank")
    number = plain_number(F.col(label))
    group = Window.partitionBy(*keys)  # at most `limit` rows per key
    top = top.withColumn("__number", number).withColumn(
        "__numeric", F.bool_and(F.coalesce(F.col("__number").isNotNull(), F.lit(False))).over(group))
    rest = F.col(label).asc_nulls_last() if numeric_order == "label" else F.col("__rank").asc()
    order = [F.when(F.col("__numeric"), F.col("__number")).asc_nulls_last(), rest]
    if numeric_order == "label":
        order.append(F.col("__rank").asc())
    axis = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return top.withColumn("axis", axis.cast("int")).drop("__rank", "__number", "__numeric")


def category_histogram(df: DataFrame, column: str, filters: list[dict] | None = None, *,
                       keys: Seq[str] = ()) -> DataFrame:
    """Counts of the 40 most frequent labels, null included, in count order."""
    counts = label_counts(apply_filters(df, filters), column, keys).withColumnRenamed("count", "total")
    return top_labels(counts, CATEGORY_LABELS, keys=keys, numeric_order=None).withColumnRenamed("total", "count")


def density(df: DataFrame, x: str, y: str, bins_x: int, bins_y: int | None = None, filters: list[dict] | None = None,
            *, keys: Seq[str] = (), clamp_low: bool = False, upper: int | None = None) -> DataFrame:
    """Sparse 2-D counts (keys, bin_x, bin_y, count) over edges shared by all groups, with the cell's corner."""
    require_numeric(df, x, y)
    require(x != y, "x and y must be different columns")
    nx = clamp_bins(bins_x, upper or 200)
    ny = clamp_bins(bins_y if bins_y is not None else bins_x, upper or 200)
    rows = apply_filters(df, filters).select(*keys, x, y)
    ranges = value_range(rows, [x, y], [nx, ny])  # each axis over all its values; one row
    both = beside(rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull()), ranges)
    cells = both.groupBy(*keys, bin_of(x, 0, nx, clamp_low).alias("bin_x"), bin_of(y, 1, ny, clamp_low).alias("bin_y"))
    edge = [(F.first(f"lo_{i}") + F.first(f"width_{i}") * F.col(f"bin_{a}")).alias(f"lower_{a}")
            for i, a in enumerate("xy")]
    return cells.agg(F.count(F.lit(1)).alias("count"), *edge)


def percent_within(df: DataFrame, keys: Seq[str], count: str, name: str, digits: int) -> DataFrame:
    """Share of the group's total, in percent. The rows are bins or labels, so the window groups are small."""
    total = F.sum(count).over(Window.partitionBy(*keys))
    return df.withColumn(name, F.coalesce(F.round(ratio(F.col(count) * 100, total), digits), F.lit(0.0)))

