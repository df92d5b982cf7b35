"""Regression and correlation per cohort, rolled up from per-recording moments.

Each recording is aggregated once (map-side, so a recording of any size is fine); cohorts combine the
recordings' centred moments. The large table is never joined with the membership.
"""

from __future__ import annotations

from collections.abc import Sequence as Seq
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import finite, ratio
from ..limits import COHORT_CORRELATION_COLUMNS, require
from ..session import materialize
from .charts import pooled
from .cohorts import only_members, with_every_cohort
from .filters import apply_filters
from .frames import beside
from .profile import correlation_targets, matrix_rows
from .sampling import group_sample
from .schema import require_numeric


def _moments(a: str, b: str, tag: str = "") -> list[Column]:
    """n, means and centred sums of the rows where both columns are present."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a).cast("double")), F.when(both, F.col(b).cast("double"))
    n = F.count(x)
    return [n.alias(f"n{tag}"), F.avg(x).alias(f"mx{tag}"), F.avg(y).alias(f"my{tag}"),
            F.regr_sxx(y, x).alias(f"sxx{tag}"), F.regr_syy(y, x).alias(f"syy{tag}"),
            F.regr_sxy(y, x).alias(f"sxy{tag}")]


def _combined(tag: str = "") -> list[Column]:
    """Sums over recordings that combine centred moments: sum(s + n*(m - M)^2), with M taken as a window-free
    identity sum(n*m*m) - N*M*M on means shifted by the smallest one, which keeps the cancellation harmless."""
    n = F.col(f"n{tag}").cast("double")
    mx, my = F.col(f"mx{tag}") - F.col(f"ox{tag}"), F.col(f"my{tag}") - F.col(f"oy{tag}")
    total, sx, sy = F.sum(n), F.sum(n * mx), F.sum(n * my)
    return [total.alias(f"n{tag}"), (ratio(sx, total) + F.first(f"ox{tag}", True)).alias(f"mx{tag}"),
            (ratio(sy, total) + F.first(f"oy{tag}", True)).alias(f"my{tag}"),
            (F.sum(f"sxx{tag}") + F.sum(n * mx * mx) - ratio(sx * sx, total)).alias(f"sxx{tag}"),
            (F.sum(f"syy{tag}") + F.sum(n * my * my) - ratio(sy * sy, total)).alias(f"syy{tag}"),
            (F.sum(f"sxy{tag}") + F.sum(n * mx * my) - ratio(sx * sy, total)).alias(f"sxy{tag}")]


def _origins(per: DataFrame, tags: Seq[str]) -> DataFrame:
    """One common origin per pair (the mean over all recordings) for the shifted means."""
    at = [F.avg(f"m{axis}{tag}").alias(f"o{axis}{tag}") for tag in tags for axis in "xy"]
    per = materialize(per)  # one row per recording
    return beside(per, per.agg(*at))


def cohort_regression(df: DataFrame, members: DataFrame, x: str, y: str, filters: list[dict] | None = None, *,
                      key: str = "dataset_id") -> DataFrame:
    """slope, intercept, r2, n and the two ends of the fitted line per cohort, exact over all rows.

    A constant x has no slope: null. A cohort that the filters empty has n 0 and nulls.
    """
    require(x != y, "x and y must be different columns")
    require_numeric(df, x, y)
    rows = apply_filters(only_members(df, members, key), filters).filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    per = rows.groupBy(key).agg(*_moments(x, y), F.min(x).cast("double").alias("min_x"),
                                F.max(x).cast("double").alias("max_x"))
    joined = _origins(per, [""]).join(members.select("cohort", key), key)
    all_ = joined.groupBy("cohort").agg(*_combined(), F.min("min_x").alias("min_x"), F.max("max_x").alias("max_x"))
    flat = F.col("min_x") == F.col("max_x")
    slope = F.when(~flat, ratio(F.col("sxy"), F.col("sxx")))
    fitted = all_.withColumn("slope", slope).withColumn("intercept", F.col("my") - F.col("slope") * F.col("mx"))
    r2 = F.when(F.col("syy") <= 0, F.when(~flat, F.lit(1.0))).otherwise(
        ratio(F.col("sxy") * F.col("sxy"), F.col("sxx") * F.col("syy")))
    line = [(F.col("slope") * F.col(end) + F.col("intercept")).alias(f"fit_{end}") for end in ("min_x", "max_x")]
    found = fitted.select("cohort", *[F.round(finite(c), 6).alias(a) for c, a in (
        (F.col("slope"), "slope"), (F.col("intercept"), "intercept"), (F.when(~flat, r2), "r2"))],
        F.col("n").cast("long").alias("n"), "min_x", "max_x", *line)
    return with_every_cohort(found, members, ["n"]) if filters else found


def regression_points(df: DataFrame, members: DataFrame, x: str, y: str, filters: list[dict] | None = None, *,
                      key: str = "dataset_id", tie: str = "row_pos") -> DataFrame:
    """About 3000 evenly spaced points of each cohort for display."""
    needed = [x, y, tie, *[f["column"] for f in filters or []]]
    named = members.select(key, F.col("cohort").alias("label"))
    rows = apply_filters(pooled(df, named, needed, key), filters)
    rows = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumnRenamed("label", "cohort")
    return group_sample(rows, ["cohort"], [key, tie])


def cohort_correlation(df: DataFrame, members: DataFrame, columns: Seq[str] | None = None,
                       filters: list[dict] | None = None, *, key: str = "dataset_id") -> DataFrame:
    """Correlation matrix (cohort, a, b, r) of the common numeric signals of each cohort; null off the diagonal of an emptied one."""
    targets = correlation_targets(df, columns, COHORT_CORRELATION_COLUMNS)
    pairs = list(combinations(range(len(targets)), 2))
    tags = [f"_{i}_{j}" for i, j in pairs]
    rows = apply_filters(only_members(df, members, key), filters)
    wide = [m for (i, j), tag in zip(pairs, tags) for m in _moments(targets[i], targets[j], tag)]
    per = rows.groupBy(key).agg(*wide)
    joined = _origins(per, tags).join(members.select("cohort", key), key)
    all_ = joined.groupBy("cohort").agg(*[c for tag in tags for c in _combined(tag)])

    def r(i: int, j: int) -> Column:
        tag = f"_{i}_{j}"
        value = ratio(F.col(f"sxy{tag}"), F.sqrt(F.greatest(F.col(f"sxx{tag}") * F.col(f"syy{tag}"), F.lit(0.0))))
        return F.when(F.isnan(value), None).otherwise(value)

    every = with_every_cohort(all_, members) if filters else all_
    return matrix_rows(every, targets, ["cohort"], r, 6)
