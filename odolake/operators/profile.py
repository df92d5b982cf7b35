"""Column profiles, grouped summaries and correlation matrices."""

from __future__ import annotations

from collections.abc import Sequence as Seq
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import category, epoch_seconds, finite, ratio
from ..limits import CORRELATION_COLUMNS, require
from ..session import materialize
from .filters import apply_filters
from .frames import join_on
from .quantiles import all_quantiles, fits_in_memory, fitting_columns, quantile_column, quantiles
from .schema import kind_of, numeric_columns, require_numeric, signal_fields

QUARTILES = (0.25, 0.5, 0.75)


def grouped_stats(df: DataFrame, keys: Seq[str], column: str, probs: Seq[float] = QUARTILES, *,
                  extra: Seq[Column] = (), null_keys: Seq[str] = (), in_memory: bool | None = None) -> DataFrame:
    """count, avg, std, min, max and q (one value per probability) of `column` per group, in one aggregation
    when the groups' distinct values fit a task, else with quantiles by rank joined to it."""
    value = F.col(column).cast("double")
    base = [F.count(column).alias("count"), F.avg(value).alias("avg"), F.stddev_samp(value).alias("std"),
            F.min(value).alias("min"), F.max(value).alias("max"), *extra]
    if in_memory is None:
        in_memory = fits_in_memory(df, keys, [column])
    if in_memory:
        return df.groupBy(*keys).agg(*base, quantile_column(column, probs).alias("q"))
    stats = df.groupBy(*keys).agg(*base)
    q = quantiles(df, keys, column, probs, "q", in_memory=False)
    return join_on(stats, q, keys, "left", null_keys=null_keys)


def spread_quartiles(df: DataFrame, names: Seq[str] = ("q25", "q50", "q75")) -> DataFrame:
    return df.select(*[c for c in df.columns if c != "q"],
                     *[finite(F.get("q", F.lit(i))).alias(n) for i, n in enumerate(names)])


def box_stats(df: DataFrame, keys: Seq[str], column: str, null_keys: Seq[str] = ()) -> DataFrame:
    """Five-number summary with mean and Tukey fences per group."""
    out = spread_quartiles(grouped_stats(df, keys, column, null_keys=null_keys), ("q1", "median", "q3")).drop("std")
    reach = (F.col("q3") - F.col("q1")) * 1.5
    return out.select("*", F.greatest(F.col("min"), F.col("q1") - reach).alias("lowerfence"),
                      F.least(F.col("max"), F.col("q3") + reach).alias("upperfence"))


def stats_chip(df: DataFrame, column: str, filters: list[dict] | None = None, *, keys: Seq[str] = ()) -> DataFrame:
    """count, avg, std, min, max and median of one column over the filtered rows."""
    require_numeric(df, column)
    rows = apply_filters(df, filters).select(*keys, column)
    out = grouped_stats(rows, keys, column, [0.5])
    return spread_quartiles(out, ["median"])


def column_profile(df: DataFrame, *, keys: Seq[str] = (), exact: bool = False) -> DataFrame:
    """One row per column: type, min, max, approx_unique, avg, std, q25, q50, q75, count, null_percentage.

    One wide aggregation over a single scan. Quartiles are sketches unless `exact` asks for interpolated ones. Mean and
    quartiles of temporal columns are seconds since 1970, without a spread.
    """
    fields = [f for f in signal_fields(df) if f.name not in keys]
    wide: list[Column] = [F.count(F.lit(1)).alias("__rows")]
    measured = {f.name: f.name for f in fields if kind_of(f.dataType) == "numeric"}
    for i, field in enumerate(fields):
        if kind_of(field.dataType) == "temporal":
            measured[field.name] = f"__seconds_{i}"
            df = df.withColumn(f"__seconds_{i}", epoch_seconds(F.col(f"`{field.name}`"), field.dataType))
    fitting = fitting_columns(df, keys, list(measured.values())) if exact and measured else []
    rows = []
    for i, field in enumerate(fields):
        column = F.col(f"`{field.name}`")
        wide += [category(F.min(column), field.dataType).alias(f"min_{i}"),
                 category(F.max(column), field.dataType).alias(f"max_{i}"),
                 F.approx_count_distinct(column).alias(f"unique_{i}"), F.count(column).alias(f"count_{i}")]
        is_number, is_time = kind_of(field.dataType) == "numeric", kind_of(field.dataType) == "temporal"
        if is_number or is_time:
            source = measured[field.name]
            value = F.col(f"`{source}`").cast("double")
            wide += [F.avg(value).alias(f"avg_{i}"), (F.stddev_samp(value) if is_number else F.max(F.lit(None).cast("double"))).alias(f"std_{i}")]
            if not exact:
                wide.append(F.percentile_approx(value, list(QUARTILES), 10000).alias(f"q_{i}"))
            elif source in fitting:
                wide.append(quantile_column(source, QUARTILES).alias(f"q_{i}"))
        q = [F.get(f"q_{i}", F.lit(j)) if is_number or is_time else F.lit(None).cast("double") for j in range(3)]
        rows.append(F.struct(
            F.lit(i).alias("position"), F.lit(field.name).alias("column_name"),
            F.lit(field.dataType.simpleString()).alias("column_type"),
            F.col(f"min_{i}").alias("min"), F.col(f"max_{i}").alias("max"),
            F.col(f"unique_{i}").alias("approx_unique"),
            (F.col(f"avg_{i}") if is_number or is_time else F.lit(None).cast("double")).alias("avg"),
            (F.col(f"std_{i}") if is_number or is_time else F.lit(None).cast("double")).alias("std"),
            q[0].alias("q25"), q[1].alias("q50"), q[2].alias("q75"),
            F.col("__rows").alias("count"),
            F.round(ratio((F.col("__rows") - F.col(f"count_{i}")) * 100, F.col("__rows")), 2).alias("null_percentage")))
    out = df.groupBy(*keys).agg(*wide) if keys else df.agg(*wide)
    large = [c for c in measured.values() if c not in fitting] if exact else []
    if large:
        q = all_quantiles(df, keys, large, QUARTILES, "q")
        each = [F.max(F.when(F.col("signal") == measured[f.name], F.col("q"))).alias(f"q_{i}")
                for i, f in enumerate(fields) if measured.get(f.name) in large]
        out = join_on(out, materialize(q.groupBy(*keys).agg(*each)), keys, "left", null_keys=keys)
    return out.select(*keys, F.explode(F.array(*rows)).alias("r")).select(*keys, "r.*")


def pair_correlation(a: str, b: str) -> Column:
    """Pearson r over the rows where both are present; null when either is constant (no ANSI error)."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a).cast("double")), F.when(both, F.col(b).cast("double"))
    r = ratio(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return F.when(F.isnan(r), None).otherwise(r)


def correlation_targets(df: DataFrame, columns: Seq[str] | None, limit: int) -> list[str]:
    numeric = numeric_columns(df)
    targets = [c for c in (columns or numeric) if c in numeric]
    require(len(targets) <= limit, f"choose at most {limit} of the {len(targets)} numeric columns")
    require(len(targets) >= 2, "correlation needs at least two numeric columns")
    return targets


def matrix_rows(wide: DataFrame, targets: Seq[str], keys: Seq[str], value, digits: int) -> DataFrame:
    """Long symmetric matrix from one row of pair values per key; `value(i, j)` names the pair's column."""
    cells = [F.struct(F.lit(a).alias("a"), F.lit(a).alias("b"), F.lit(1.0).alias("r")) for a in targets]
    for (i, a), (j, b) in combinations(enumerate(targets), 2):
        r = F.round(finite(value(i, j)), digits)
        cells += [F.struct(F.lit(p).alias("a"), F.lit(q).alias("b"), r.alias("r")) for p, q in ((a, b), (b, a))]
    return wide.select(*keys, F.explode(F.array(*cells)).alias("c")).select(*keys, "c.a", "c.b", "c.r")


def correlation(df: DataFrame, columns: Seq[str] | None = None, filters: list[dict] | None = None, *,
                keys: Seq[str] = ()) -> DataFrame:
    """Correlation matrix in long form (keys, a, b, r), all pairs in one scan."""
    targets = correlation_targets(df, columns, CORRELATION_COLUMNS)
    rows = apply_filters(df, filters).select(*keys, *targets)
    pairs = [pair_correlation(a, b).alias(f"r_{i}_{j}")
             for (i, a), (j, b) in combinations(enumerate(targets), 2)]
    wide = rows.groupBy(*keys).agg(*pairs) if keys else rows.agg(*pairs)
    return matrix_rows(wide, targets, keys, lambda i, j: F.col(f"r_{i}_{j}"), 4)
