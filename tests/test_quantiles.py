"""Quantiles by sort and by pivots against plain lists."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from odolake.operators import quantiles as Q
from odolake.operators.charts import group_stats
from odolake.operators.cohorts import cohort_histogram2d, cohort_summary
from odolake.operators.profile import column_profile
from odolake.operators.regression import cohort_correlation, cohort_regression
from odolake.operators.spectrum import cohort_spectrum

from conftest import rows

CURVE = [i / 100 for i in range(101)]


def plain(values, p):
    values = sorted(v for v in values if v is not None)
    at = p * (len(values) - 1)
    low, high = values[math.floor(at)], values[math.ceil(at)]
    return low + (high - low) * (at - math.floor(at))


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(2)
    data = []
    for key, n in (("a", 700), ("b", 60), (None, 30), ("c", 1), ("d", 3)):
        for _ in range(n):
            data.append((key, rng.gauss(0, 100), rng.choice([1, 1, 1, 2, 9]), None if key == "d" else rng.randrange(40) / 4))
    return spark.createDataFrame(data, "k string, smooth double, coarse int, gaps double").repartition(5).cache(), data


@pytest.mark.parametrize(("probs", "accuracy", "keys"), [
    ([0.5], 10_000, ["k"]), ([0.0, 1.0], 5, ["k"]), ([0.1, 0.1, 0.9], 40, []), (CURVE, 10_000, ["k"]), (CURVE, 40, []), (CURVE, 5, ["k"])],
    ids=lambda x: str(len(x)) if isinstance(x, list) else str(x))
def test_pivots_give_exact_quantiles(spark, table, tiny_bounds, monkeypatch, probs, accuracy, keys):
    monkeypatch.setattr(Q, "SKETCH_ACCURACY", accuracy)
    df, data = table
    got = {(r["k"] if keys else "all", r["signal"]): r["q"] for r in Q.pivot_quantiles(df, keys, ["smooth", "coarse", "gaps"], probs, "q").collect()}
    groups = {}
    for k, *values in data:
        for name, v in zip(("smooth", "coarse", "gaps"), values):
            if v is not None:
                groups.setdefault((k if keys else "all", name), []).append(v)
    assert set(got) == set(groups)
    for at, values in groups.items():
        assert got[at] == pytest.approx([plain(values, p) for p in probs], abs=1e-9)


def test_ranks_outside_a_wrong_sketch_are_sorted_out(spark, table, monkeypatch):
    monkeypatch.setattr(Q, "_brackets", lambda probs: [0.9, 0.95])  # no wanted rank lies there
    df, data = table
    got = {r["k"]: r["q"] for r in Q.pivot_quantiles(df, ["k"], ["smooth"], [0.5], "q").collect()}
    assert got == {k: pytest.approx([plain([x[1] for x in data if x[0] == k], 0.5)]) for k in {x[0] for x in data}}


def test_both_ways_agree_and_empty_tables_stay_empty(spark, table):
    df, _ = table
    args = ["k"], ["smooth", "gaps"], CURVE, "q"
    names = "k", "signal", "q"
    assert rows(Q.all_quantiles(df, *args), *names) == rows(Q.pivot_quantiles(df, *args), *names)
    for way in (Q.all_quantiles, Q.pivot_quantiles):
        assert way(df.limit(0), *args).count() == way(df.limit(0), [], *args[1:]).count() == 0


def test_large_columns_are_profiled_without_a_nested_loop(spark, table, tiny_bounds):
    df, data = table
    found = column_profile(df.drop("k"), exact=True)
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()
    got = {r["column_name"]: (r["q25"], r["q50"], r["q75"]) for r in found.collect()}
    for i, name in enumerate(("smooth", "coarse", "gaps"), 1):
        assert got[name] == pytest.approx([plain([x[i] for x in data], p) for p in (0.25, 0.5, 0.75)])


def test_the_counting_scan_shuffles_cells_only(spark, tiny_bounds):
    written = []
    keep = Q.materialize

    def counted(df):
        out = keep(df)
        written.append(out.count())
        return out

    Q.materialize, old = counted, Q.materialize
    try:
        df = spark.range(200_000).select(F.lit("x").alias("k"), F.hash("id").alias("v"))
        Q.pivot_quantiles(df, ["k"], ["v"], [0.5], "q").collect()
    finally:
        Q.materialize = old
    assert max(written) < 200_000 / 100


def test_cohorts_that_filters_empty_stay(spark, two_drives, ab_members):
    only_a = [{"column": "speed", "op": "ge", "value": 26}]
    assert rows(cohort_regression(two_drives, ab_members, "speed", "rpm", only_a), "cohort", "n", "slope") == [("A", 3, 20.0), ("B", 0, None)]
    pairs = rows(cohort_correlation(two_drives, ab_members, ["speed", "rpm"], only_a), "cohort", "a", "b", "r")
    assert ("A", "rpm", "speed", 1.0) in pairs and ("B", "rpm", "speed", None) in pairs and ("B", "rpm", "rpm", 1.0) in pairs
    cells = rows(cohort_histogram2d(two_drives, ab_members, "speed", "rpm", 5, 5, only_a), "cohort", "bin_x", "count", "mean_percent")
    assert ("B", None, 0, 0.0) in cells and sum(c[2] for c in cells) == 3
    spectrum = rows(cohort_spectrum(two_drives, ab_members, "speed", "time"), "cohort", "bin", "psd", "band_power")
    assert spectrum == [("A", None, None, None), ("B", None, None, None)]  # fewer than 32 rows
    labels = ab_members.withColumnRenamed("cohort", "label")
    assert rows(group_stats(two_drives, labels, "speed", only_a), "label", "count", "median") == [("A", 3, 40.0), ("B", 0, None)]


def test_padded_signals_are_one_signal(spark, two_drives, ab_members):
    found = cohort_summary(two_drives, ab_members, ["speed", " speed ", "rpm "])
    assert rows(found, "signal", "cohort", "n") == [("rpm", "A", 1), ("rpm", "B", 1), ("speed", "A", 1), ("speed", "B", 1)]
