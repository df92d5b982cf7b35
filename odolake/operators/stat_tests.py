"""Two-sample statistics of cohort values. One row per (signal, comparison), all comparisons in one job.

Input: values(signal, cohort, position, dataset_id, value), as `representative_values` gives them. The cohort
at position 0 is the baseline (left side); every other cohort is compared with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from collections.abc import Sequence as Seq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..fixed_values import BOOTSTRAP_ROUNDS, BOOTSTRAP_SEED
from ..functions.distributions import rank_sum_two_sided, student_two_sided
from ..functions.scalars import ratio
from ..session import materialize
from .frames import repeat_for
from .ordered import Ordered

BLOCK_VALUES = 1_000_000
DRAWS_AT_ONCE = 4_000_000
BY = ["signal", "comparison"]


def sides(values: DataFrame, key: str = "dataset_id") -> DataFrame:
    """(signal, comparison, is_right, dataset, value): the baseline's values are repeated per comparison."""
    present = values.filter(F.col("value").isNotNull())
    right = present.filter(F.col("position") > 0).select(
        "signal", F.col("cohort").alias("comparison"), F.lit(True).alias("is_right"), key, "value")
    others = values.filter(F.col("position") > 0).select(F.col("cohort").alias("comparison")).distinct()
    left = present.filter(F.col("position") == 0).select("signal", F.lit(False).alias("is_right"), key, "value")
    left = repeat_for(left, others).select("signal", "comparison", "is_right", key, "value")
    return left.unionByName(right)


def moments(pairs: DataFrame) -> DataFrame:
    """Counts, means and sample variances of both sides in one aggregation."""
    aggregates = []
    for side, wanted in (("left", False), ("right", True)):
        v = F.when(F.col("is_right") == F.lit(wanted), F.col("value"))
        aggregates += [F.count(v).alias(f"n_{side}"), F.avg(v).alias(f"mean_{side}"), F.var_samp(v).alias(f"var_{side}")]
    return pairs.groupBy(*BY).agg(*aggregates)


def mean_difference(m: DataFrame) -> DataFrame:
    """difference of the means and its percent of the baseline's absolute mean."""
    diff = F.col("mean_right") - F.col("mean_left")
    return m.withColumn("difference", diff).withColumn(
        "difference_percent", ratio(diff * 100, F.nullif(F.abs("mean_left"), F.lit(0.0))))


def hedges_g(m: DataFrame) -> DataFrame:
    degrees = F.col("n_left") + F.col("n_right") - 2
    pooled = ratio((F.col("n_left") - 1) * F.col("var_left") + (F.col("n_right") - 1) * F.col("var_right"), degrees)
    correction = F.when(degrees > 1, 1 - ratio(F.lit(3), 4 * degrees - 1)).otherwise(1.0)
    enough = (F.col("n_left") >= 2) & (F.col("n_right") >= 2) & (pooled > 0)
    g = correction * ratio(F.col("mean_right") - F.col("mean_left"), F.sqrt(pooled))
    return m.withColumn("hedges_g", F.when(enough, g))


def rank_statistics(pairs: DataFrame) -> DataFrame:
    """U of the right side with average ranks, the tie term sum(t^3 - t), and Cliff's delta = 2U/(nm) - 1.

    Values are counted before they are ranked, so ties collapse and a large sample is ranked in chunks.
    """
    one = F.count(F.lit(1))
    counts = pairs.groupBy(*BY, "value").agg(one.alias("t"), F.count_if(F.col("is_right")).alias("r"))
    ranked = Ordered(counts, BY, ["value"]).running_sum({"cum": F.col("t")}).df
    rank = F.col("cum") - (F.col("t") - 1) / 2
    t = F.col("t").cast("double")
    sums = ranked.groupBy(*BY).agg(
        F.sum("t").alias("n"), F.sum("r").alias("m"), F.sum(F.col("r") * rank).alias("rank_sum"),
        F.sum(t * t * t - t).alias("tie_term"))
    m = F.col("m").cast("double")
    u = F.col("rank_sum") - m * (m + 1) / 2
    cells = m * (F.col("n") - F.col("m"))
    return sums.select(*BY, u.alias("u"), "tie_term", (ratio(2 * u, cells) - 1).alias("cliffs_delta"))


@F.pandas_udf(T.DoubleType())
def welch_p(n1: pd.Series, m1: pd.Series, v1: pd.Series, n2: pd.Series, m2: pd.Series, v2: pd.Series) -> pd.Series:
    def p(n_l, mean_l, var_l, n_r, mean_r, var_r):
        if n_l < 2 or n_r < 2 or not (var_l > 0 or var_r > 0):
            return None
        a, b = var_l / n_l, var_r / n_r
        degrees = (a + b) ** 2 / (a * a / (n_l - 1) + b * b / (n_r - 1))
        return student_two_sided((mean_r - mean_l) / np.sqrt(a + b), degrees)

    return pd.Series([p(*row) for row in zip(n1, m1, v1, n2, m2, v2)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def rank_sum_p(u: pd.Series, n_right: pd.Series, n_left: pd.Series, tie_term: pd.Series) -> pd.Series:
    def p(u_, r, left, ties):
        return rank_sum_two_sided(u_, int(r), int(left), ties) if r >= 2 and left >= 2 else None

    return pd.Series([p(*row) for row in zip(u, n_right, n_left, tie_term)], dtype="float64")


def _draws(rng: np.random.Generator, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rounds, drawn ranks) of all rounds of a side of n values, in pieces; the stream does not depend on the pieces."""
    step, total = max(n, DRAWS_AT_ONCE // n * n) if n <= DRAWS_AT_ONCE else DRAWS_AT_ONCE, BOOTSTRAP_ROUNDS * n
    for begin in range(0, total, step):
        end = min(begin + step, total)
        yield np.arange(begin, end) // n, rng.integers(0, n, size=end - begin)


def _resample(block: pd.DataFrame) -> pd.DataFrame:
    """This block's part of the mean of every bootstrap round.

    Every block follows the one seeded stream of draws, the left side's rounds first, then the right side's, and adds up those that
    fall on its own ranks. So a draw depends on the round and the rank alone, never on the blocks.
    """
    first = block.iloc[0]
    rng = np.random.default_rng(BOOTSTRAP_SEED)
    block = block.sort_values("rank")
    values, low, n = block["value"].to_numpy(dtype=float), int(block["rank"].iloc[0]), int(first["n_side"])
    if first["is_right"]:
        for _ in _draws(rng, int(first["n_left"])):
            pass
    sums = np.zeros(BOOTSTRAP_ROUNDS)
    for rounds, ranks in _draws(rng, n):
        own = (ranks >= low) & (ranks < low + values.size)
        if not own.all():
            rounds, ranks = rounds[own], ranks[own]
        sums += np.bincount(rounds, values[ranks - low], BOOTSTRAP_ROUNDS)
    return pd.DataFrame({
        "signal": first["signal"], "comparison": first["comparison"], "is_right": bool(first["is_right"]),
        "round": np.arange(BOOTSTRAP_ROUNDS), "part": sums / n})


def bootstrap_interval(pairs: DataFrame, key: str = "dataset_id") -> DataFrame:
    """95 % percentile interval of the difference of means; recordings are resampled on each side.

    A side's values are ranked by recording and cut into blocks of BLOCK_VALUES ranks, each added up by its own task. The
    interval is the same for every block size.
    """
    side = [*BY, "is_right"]
    placed = pairs.select(*side, F.col(key).cast("string").alias("place"), F.col("value").cast("double").alias("value"))
    ranked = Ordered(placed, side, ["place", "value"]).row_number("rank", "n_side").df
    sizes = pairs.groupBy(*BY).agg(F.count(F.when(~F.col("is_right"), 1)).alias("n_left"), F.count(F.when(F.col("is_right"), 1)).alias("n_right"))
    both = sizes.filter((F.col("n_left") >= 2) & (F.col("n_right") >= 2)).select(*BY, "n_left")
    rank = F.col("rank") - 1
    ready = ranked.join(both, BY).select(*side, "value", "n_side", "n_left", rank.alias("rank"), F.floor(rank / BLOCK_VALUES).alias("block"))
    parts = ready.groupBy(*side, "block").applyInPandas(
        _resample, "signal string, comparison string, is_right boolean, round int, part double")
    signed = F.when(F.col("is_right"), F.col("part")).otherwise(-F.col("part"))
    rounds = parts.groupBy(*BY, "round").agg(F.sum(signed).alias("d"))
    q = rounds.groupBy(*BY).agg(F.percentile("d", [0.025, 0.975]).alias("q"))  # 2000 values each
    return q.select(*BY, F.get("q", F.lit(0)).alias("ci95_low"), F.get("q", F.lit(1)).alias("ci95_high"))


def labels(df: DataFrame) -> DataFrame:
    """Effect size words and significance flags, as the result table shows them."""
    g = F.abs("hedges_g")
    size = F.when(g >= 0.8, "large").when(g >= 0.5, "medium").when(g.isNotNull(), "small")
    return df.withColumn("effect_size", size).withColumn("t_significant", F.col("t_test_p") < 0.05).withColumn(
        "mw_significant", F.col("mann_whitney_p") < 0.05)


def compare_cohorts(values: DataFrame, key: str = "dataset_id", *, with_bootstrap: bool = True) -> DataFrame:
    """Every test of every cohort against the first one, per signal."""
    pairs = sides(materialize(values), key)  # one row per signal and recording, read by every test
    m = hedges_g(mean_difference(moments(pairs)))
    out = m.join(rank_statistics(pairs), BY).withColumn(
        "t_test_p", welch_p("n_left", "mean_left", "var_left", "n_right", "mean_right", "var_right")).withColumn(
        "mann_whitney_p", rank_sum_p("u", "n_right", "n_left", "tie_term"))
    if with_bootstrap:
        out = out.join(bootstrap_interval(pairs, key), BY, "left")
    return labels(out)


__all__: Seq[str] = ["bootstrap_interval", "compare_cohorts", "hedges_g", "labels", "mean_difference", "moments",
                     "rank_statistics", "sides"]
