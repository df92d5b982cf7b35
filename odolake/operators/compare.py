"""Comparison of recordings: every operator handles all recordings of the frame in one job."""

from __future__ import annotations

from collections.abc import Iterator
from collections.abc import Sequence as Seq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..fixed_values import DEGENERATE_MEAN
from ..functions.scalars import category, finite, ratio
from ..limits import BOX_CARDINALITY, BOX_GROUPS, CATEGORY_LABELS, clamp_bins, require
from ..session import materialize
from .bins import bin_grid, bin_of, label_counts, percent_within, top_labels, value_range
from .filters import apply_filters
from .frames import beside, lookup, repeat_for
from .ordered import Ordered
from .profile import box_stats, grouped_stats, spread_quartiles
from .quantiles import all_quantiles, quantiles
from .schema import dtype_of, kind_of, numeric_columns, require_numeric

DATASET = ("dataset_id",)
PERCENTS = [i / 100 for i in range(101)]
DIFF_PERCENTS = PERCENTS[1:100]


def _with_emptied(df: DataFrame, found: DataFrame, keys: Seq[str], filters: list[dict] | None) -> DataFrame:
    """`found` with a row of nulls for every recording of `df` that the filters empty."""
    return df.select(*keys).distinct().join(found, list(keys), "left") if filters else found


def compare_histogram(df: DataFrame, column: str, bins: int = 40, filters: list[dict] | None = None, *,
                      as_category: bool = False, keys: Seq[str] = DATASET) -> DataFrame:
    """Counts and percents of every recording over shared bin edges, or over the shared top-40 labels."""
    rows = apply_filters(df, filters).select(*keys, column)
    if as_category or kind_of(dtype_of(df, column)) != "numeric":
        return _compare_labels(df, rows, column, keys)
    n = clamp_bins(bins)
    present = rows.filter(F.col(column).isNotNull())
    ranges = value_range(present, [column], [n])
    binned = beside(present, ranges).withColumn("bin", bin_of(column, 0, n))
    counts = binned.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("count"))
    # recordings that the filters empty keep a row of zeros; the grid has at most 200 rows
    every = repeat_for(df.select(*keys).distinct(), bin_grid(ranges, n))
    filled = every.join(counts, [*keys, "bin"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    return percent_within(filled, keys, "count", "percent", 3)


def _compare_labels(df: DataFrame, rows: DataFrame, column: str, keys: Seq[str]) -> DataFrame:
    counts = materialize(label_counts(rows, column, keys))  # read for sizes, labels and cells
    sizes = df.select(*keys).distinct().join(counts.groupBy(*keys).agg(F.sum("count").alias("__n")), list(keys), "left")
    pooled = counts.groupBy("label").agg(F.sum("count").alias("total"))
    labels = top_labels(pooled, CATEGORY_LABELS, numeric_order="count").drop("total")
    grid = repeat_for(sizes, labels)  # at most 40 labels
    shown = grid.alias("g").join(
        counts.alias("c"), [F.col(f"g.{k}") == F.col(f"c.{k}") for k in keys]
        + [F.col("g.label").eqNullSafe(F.col("c.label"))], "left")
    return shown.select(*[F.col(f"g.{k}").alias(k) for k in keys], F.col("g.label").alias("label"), "axis",
                        F.coalesce("count", F.lit(0)).alias("count"),
                        F.round(ratio(F.coalesce("count", F.lit(0)) * 100, F.col("__n")), 3).alias("percent"))


def compare_group_stats(df: DataFrame, column: str, group_by: str, filters: list[dict] | None = None, *,
                        keys: Seq[str] = DATASET) -> DataFrame:
    """Box statistics of a signal per recording and group value; the 30 largest groups share one axis."""
    require(column != group_by, "signal and group must be different columns")
    require_numeric(df, column)
    label = category(F.col(group_by), dtype_of(df, group_by))
    rows = apply_filters(df, filters).filter(F.col(column).isNotNull() & F.col(group_by).isNotNull())
    rows = rows.select(*keys, label.alias("group"), column)
    stats = materialize(box_stats(rows, [*keys, "group"], column))  # one row per recording and group value
    guard_cardinality(stats, keys, BOX_CARDINALITY)
    pooled = stats.groupBy("group").agg(F.sum("count").alias("total"))
    axis = top_labels(pooled, BOX_GROUPS, "group").drop("total")
    return stats.join(F.broadcast(axis), "group")  # at most 30 rows


def guard_cardinality(cells: DataFrame, keys: Seq[str], limit: int) -> None:
    """Refuse a grouping with more than `limit` cells in any group of `keys`; `cells` has one row per cell."""
    worst = cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    require(worst <= limit, f"too many groups: {worst}; choose a discrete column")


def compare_summary(df: DataFrame, column: str, filters: list[dict] | None = None, *,
                    keys: Seq[str] = DATASET) -> DataFrame:
    """count, avg, std, min, max and quartiles of a signal for every recording."""
    require_numeric(df, column)
    rows = apply_filters(df, filters).select(*keys, column)
    stats = _with_emptied(df, spread_quartiles(grouped_stats(rows, keys, column)), keys, filters)
    return stats.withColumn("count", F.coalesce("count", F.lit(0)))


def compare_curve(df: DataFrame, x: str, y: str, bins: int = 40, filters: list[dict] | None = None, *,
                  keys: Seq[str] = DATASET) -> DataFrame:
    """Mean and P10..P90 band of y in shared bins of x; empty bins are present with nulls."""
    require(x != y, "x and y must be different columns")
    require_numeric(df, x, y)
    n = clamp_bins(bins)
    rows = apply_filters(df, filters).select(*keys, x, y)
    ranges = value_range(rows, [x], [n])  # over all x, also where y is missing
    both = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    binned = beside(both, ranges).select(*keys, bin_of(x, 0, n).alias("bin"), F.col(y).alias("__y"))
    stats = spread_quartiles(grouped_stats(binned, [*keys, "bin"], "__y", [0.1, 0.9]), ("p10", "p90"))
    centre = (F.col("lower") + F.col("upper")) / 2
    grid = bin_grid(ranges, n).select("bin", centre.alias("center"))
    every = repeat_for(df.select(*keys).distinct(), grid)  # at most 200 bins
    out = every.join(stats, [*keys, "bin"], "left")
    return out.select(*keys, "bin", "center", F.coalesce("count", F.lit(0)).alias("count"),
                      F.col("avg").alias("mean"), "p10", "p90")


def compare_cdf(df: DataFrame, column: str, filters: list[dict] | None = None, *,
                keys: Seq[str] = DATASET) -> DataFrame:
    """Percentiles 0..100 of every recording, long form (keys, percent, value)."""
    require_numeric(df, column)
    q = quantiles(apply_filters(df, filters).select(*keys, column), keys, column, PERCENTS, "q")
    q = _with_emptied(df, q, keys, filters)
    return q.select(*keys, F.posexplode(F.coalesce("q", F.array_repeat(F.lit(None).cast("double"), len(PERCENTS)))).alias("percent", "value"))


def diff_stats(df: DataFrame, columns: Seq[str], keys: Seq[str]) -> DataFrame:
    """(keys, signal, avg, q[99]): means of all signals in one wide aggregation, curves of all from two more scans."""
    wide = df.groupBy(*keys).agg(*[F.avg(F.col(c).cast("double")).alias(f"m_{i}") for i, c in enumerate(columns)])
    cells = F.array(*[F.struct(F.lit(c).alias("signal"), F.col(f"m_{i}").alias("avg")) for i, c in enumerate(columns)])
    means = wide.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.*")
    return means.join(all_quantiles(df, keys, columns, DIFF_PERCENTS, "q"), [*keys, "signal"], "left")


@F.pandas_udf(T.DoubleType())
def ks_of_quantiles(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Largest gap of two distributions given by their 1..99 % quantiles, one row per comparison."""
    probs = np.arange(1, 100) / 100

    def gap(qa, qb):
        if qa is None or qb is None:
            return None
        a, b = np.asarray(qa, dtype=float), np.asarray(qb, dtype=float)
        if np.isnan(a).any() or np.isnan(b).any():
            return None
        at = np.unique(np.concatenate([a, b]))
        curves = [np.interp(at, q, probs, left=0.0, right=1.0) for q in (a, b)]
        return round(float(np.abs(curves[0] - curves[1]).max()), 4)

    for left, right in batches:
        yield pd.Series([gap(a, b) for a, b in zip(left, right)], dtype="float64")


def compare_diff(df: DataFrame, baseline: str, filters: list[dict] | None = None, *,
                 columns: Seq[str] | None = None, key: str = "dataset_id") -> DataFrame:
    """All common signals of every recording against the baseline: change of the mean and KS distance.

    Rows (signal, dataset, avg, base_avg, delta_pct, ks, max_ks, rank); rank 1 is the signal that differs most.
    """
    signals = [c for c in (columns or numeric_columns(df)) if c != key]
    require(bool(signals), "no common numeric columns")
    rows = apply_filters(df, filters).select(key, *signals)
    stats = diff_stats(rows, signals, [key])
    if filters:
        every = df.select(key).distinct().select(key, F.explode(F.array(*[F.lit(s) for s in signals])).alias("signal"))
        stats = every.join(stats, [key, "signal"], "left")
    stats = materialize(stats)  # one row per recording and signal
    base = stats.filter(F.col(key) == baseline).select(
        "signal", F.col("avg").alias("base_avg"), F.col("q").alias("base_q"))
    others = stats.filter(F.col(key) != baseline)
    pairs = others.join(F.broadcast(base), "signal", "left")  # one row per signal
    change = F.when(F.abs("base_avg") > DEGENERATE_MEAN,
                    F.round((F.col("avg") - F.col("base_avg")) * 100 / F.abs("base_avg"), 2))
    scored = pairs.select("signal", key, finite(F.col("avg")).alias("avg"), finite(F.col("base_avg")).alias("base_avg"),
                          change.alias("delta_pct"), ks_of_quantiles("base_q", "q").alias("ks"))
    scored = materialize(scored)
    best = scored.groupBy("signal").agg(F.max("ks").alias("max_ks"))
    order = F.array(*[F.lit(s) for s in signals])
    ranked = best.withColumn("rank", F.row_number().over(
        Window.orderBy(F.desc_nulls_last("max_ks"), F.array_position(order, F.col("signal")))))  # <= 100 rows
    return scored.join(F.broadcast(ranked), "signal")


def exact_ks(df: DataFrame, column: str, baseline: str, filters: list[dict] | None = None, *,
             key: str = "dataset_id") -> DataFrame:
    """Two-sample KS distance of each recording to the baseline, over all values instead of quantiles.

    Counts per distinct value are summed before the sort, and the sort itself is chunked for large recordings.
    """
    require_numeric(df, column)
    values = apply_filters(df, filters).filter(F.col(column).isNotNull()).select(
        key, F.col(column).cast("double").alias("v"))
    counts = values.groupBy(key, "v").agg(F.count(F.lit(1)).alias("c"))
    counts = materialize(counts)  # distinct values with counts, read by each step below
    sizes = counts.groupBy(key).agg(F.sum("c").alias("n"))
    others = counts.filter(F.col(key) != baseline)
    # the baseline's values are laid beside every other recording, so each comparison is one ordered group
    # one cumulative curve of the baseline over every value that occurs anywhere: a single sorted pass
    base_at = counts.groupBy("v").agg(F.sum(F.when(F.col(key) == baseline, F.col("c")).otherwise(0)).alias("b"))
    curve = Ordered(base_at.withColumn("__all", F.lit(0)), ["__all"], ["v"]).running_sum({"cum_b": F.col("b")}).df
    running = Ordered(others, [key], ["v"]).running_sum({"cum_c": F.col("c")}).df
    total_b = sizes.filter(F.col(key) == baseline).select(F.col("n").alias("nb"))
    both = beside(lookup(running.join(curve.drop("__all"), "v"), sizes, [key]), total_b)
    n, nb = F.col("n"), F.col("nb")
    at = F.abs(F.col("cum_c") / n - F.col("cum_b") / nb)
    # between two values of the recording only the baseline moves: compare just before each value too
    before = F.abs((F.col("cum_c") - F.col("c")) / n - (F.col("cum_b") - F.col("b")) / nb)
    return both.groupBy(key).agg(F.max(F.greatest(at, before)).alias("ks"))
