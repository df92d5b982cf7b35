"""Answers that must not depend on caps, odd lengths, number formats or types."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from odolake.errors import RequestError
from odolake.operators import bins, cohorts, compare, filters, models, profile, sampling, sequences, spectrum
from odolake.operators.ordered import Ordered


def test_event_statistics_use_every_event(spark):
    rows = [("a", i, float(i), i % 2) for i in range(12_000)]
    df = spark.createDataFrame(rows, "dataset_id string, row_pos bigint, time double, state int")
    members = spark.createDataFrame([("A", "a")], "cohort string, dataset_id string")
    out = sequences.event_summary(df, members, "state", "1", "time").first()
    assert out["event_count"] == 6_000 and out["events_per_1k_rows"] == 500.0
    assert sequences.events(df, "state", "1", "time").count() == 5_000


@pytest.mark.parametrize("count", [99, 100, 333])
def test_spectrum_frequencies_of_any_length(spark, count):
    t = np.arange(count) / 10
    tone = 10 * (count // 5) / count
    data = [("a", i, float(s), float(np.sin(2 * np.pi * tone * s))) for i, s in enumerate(t)]
    df = spark.createDataFrame(data, "dataset_id string, row_pos bigint, time double, v double")
    members = spark.createDataFrame([("A", "a")], "cohort string, dataset_id string")
    out = spectrum.cohort_spectrum(df, members, "v", "time", band=(0.0, 5.0)).orderBy("bin").collect()
    got = spectrum.welch(df, "v", "time").first()
    own = np.arange(len(got["density"])) * got["rate"] / count
    assert abs(own[np.argmax(got["density"])] - tone) < 1e-6
    wanted = np.interp(np.linspace(0, got["rate"] / 2, len(out)), own, got["density"], right=0.0)
    assert np.allclose([r["psd"] for r in out], wanted, atol=1e-6)
    assert abs(max(out, key=lambda r: r["psd"])["freq"] - tone) < 0.03


def test_contains_reads_plain_digits(spark):
    df = spark.createDataFrame([("a", 0, 12345678.9), ("a", 1, 1.5), ("a", 2, None)], "dataset_id string, row_pos bigint, v double")
    assert [r["row_pos"] for r in filters.apply_filters(df, [{"column": "v", "op": "contains", "value": "12345"}]).collect()] == [0]


def test_labels_that_only_look_like_numbers(spark):
    labels = ["2F", "9D", "10D", "10D"]
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(labels)], "dataset_id string, row_pos bigint, m string")
    out = bins.top_labels(bins.label_counts(df, "m", name="label").withColumnRenamed("count", "total"), 5)
    assert [r["label"] for r in out.orderBy("axis").collect()] == ["10D", "2F", "9D"]
    numbers = spark.createDataFrame([("a", i, x) for i, x in enumerate(["10", "9", "-1.5e1"])], "dataset_id string, row_pos bigint, m string")
    out = bins.top_labels(bins.label_counts(numbers, "m", name="label").withColumnRenamed("count", "total"), 5)
    assert [r["label"] for r in out.orderBy("axis").collect()] == ["-1.5e1", "9", "10"]
    assert sampling is not None


def test_whole_number_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).selectExpr("id", "id AS v").coalesce(1).write.parquet(path)
    df = spark.read.parquet(path)
    wanted = {("ge", 10.5): 89, ("gt", 10.5): 89, ("le", 10.5): 11, ("lt", 10.5): 11, ("eq", 10.5): 0, ("ne", 10.5): 100, ("ge", 10): 90,
              ("gt", 10): 89, ("le", 10): 11, ("lt", 10): 10, ("eq", 10): 1, ("ne", 10): 99, ("lt", 1e300): 100}
    for (op, value), count in wanted.items():
        assert filters.apply_filters(df, [{"column": "v", "op": op, "value": value}]).count() == count, (op, value)
    plan = filters.apply_filters(df, [{"column": "v", "op": "ge", "value": 10.5}])._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(v,11)" in plan


def test_running_sums_with_nulls_are_equal_both_ways(spark):
    values = [3, None, None, None, None, None, 4, None, None]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)] + [("b", i, None) for i in range(5)], "k string, i int, v int")
    results = []
    for rows in (1_000, 2):
        spark.conf.set("spark.odolake.maxGroupRows", str(rows))
        try:
            out = Ordered(df, ["k"], ["i"]).running_sum({"s": F.col("v")}).df
            results.append(sorted((r["k"], r["i"], r["s"]) for r in out.collect() if r["k"] == "a") + [r["s"] for r in out.collect() if r["k"] == "b"])
        finally:
            spark.conf.unset("spark.odolake.maxGroupRows")
    assert results[0] == results[1]
    assert [s for *_, s in results[0][:9]] == [3, 3, 3, 3, 3, 3, 7, 7, 7] and results[0][9:] == [None] * 5


def test_components_use_all_rows(spark):
    draw = np.random.default_rng(1)
    x = draw.normal(size=7_000)
    y = 0.6 * x + 0.8 * draw.normal(size=7_000)
    df = spark.createDataFrame([("a", i, float(p), float(q)) for i, (p, q) in enumerate(zip(x, y))], "dataset_id string, row_pos bigint, x double, y double")
    members = spark.createDataFrame([("A", "a")], "cohort string, dataset_id string")
    projected, loadings = models.cohort_pca(df, members, ["x", "y"])
    r = np.corrcoef(x, y)[0, 1]
    first = loadings.filter("component = 1").collect()
    assert all(math.isclose(v["explained"], (1 + r) / 2, rel_tol=1e-6) and math.isclose(abs(v["loading"]), math.sqrt(0.5), rel_tol=1e-6) for v in first)
    assert projected.count() < 7_000  # only what is shown is thinned


def test_columns_are_never_cut_in_silence(spark):
    df = spark.range(4).selectExpr(*[f"cast(id * {i + 1} AS double) AS c{i}" for i in range(31)])
    with pytest.raises(RequestError):
        profile.correlation(df)
    assert profile.correlation(df, [f"c{i}" for i in range(3)]).count() == 9


def test_filters_never_lose_a_recording_or_cohort(spark):
    df = spark.createDataFrame([("a", i, float(i), "x") for i in range(6)] + [("b", i, float(10 + i), "y") for i in range(6)],
                               "dataset_id string, row_pos bigint, v double, m string")
    members = spark.createDataFrame([("A", 0, "a"), ("B", 1, "b")], "cohort string, position int, dataset_id string")
    high = [{"column": "v", "op": "ge", "value": 10}]
    summary = {r["dataset_id"]: (r["count"], r["avg"]) for r in compare.compare_summary(df, "v", high).collect()}
    assert summary == {"a": (0, None), "b": (6, 12.5)}
    labels = compare.compare_histogram(df, "m", filters=high).collect()
    assert {(r["dataset_id"], r["label"], r["count"]) for r in labels} == {("a", "y", 0), ("b", "y", 6)}
    cdf = compare.compare_cdf(df, "v", high).collect()
    assert len(cdf) == 202 and all(r["value"] is None for r in cdf if r["dataset_id"] == "a")
    for baseline in "ab":
        rows = compare.compare_diff(df, baseline, high, columns=["v"]).collect()
        assert [(r["signal"], r["ks"]) for r in rows] == [("v", None)]
    cohort = {r["cohort"]: (r["n"], r["mean"]) for r in cohorts.cohort_summary(df, members, ["v"], filters=high).collect()}
    assert cohort == {"A": (0, None), "B": (1, 12.5)}
