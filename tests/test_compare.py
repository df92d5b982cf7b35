from __future__ import annotations

import math

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from odolake import RequestError
from odolake.functions.distributions import rank_sum_two_sided, student_two_sided
from odolake.operators import charts, cohorts, compare, regression, sequences, stat_tests
from odolake.operators.quantiles import quantiles


def test_compare_histogram_shares_edges(two_drives):
    out = compare.compare_histogram(two_drives, "speed", 5)
    assert rows(out.filter("dataset_id = 'a'"), "bin", "count") == [(0, 1), (1, 1), (2, 1), (3, 1), (4, 2)]
    assert rows(out.filter("dataset_id = 'b'"), "bin", "count") == [(0, 2), (1, 2), (2, 2), (3, 0), (4, 0)]
    assert out.filter("dataset_id = 'b' and bin = 0").first()["percent"] == 33.333


def test_compare_histogram_keeps_recordings_the_filter_empties(two_drives):
    out = compare.compare_histogram(two_drives, "speed", 5, [{"column": "speed", "op": "gt", "value": 30}])
    assert out.filter("dataset_id = 'b'").agg(F.sum("count"), F.sum("percent")).first() == (0, 0.0)


def test_compare_categories_orders_by_total(log):
    a = log("a", "mode string", [("drive",)] * 5 + [("idle",)])
    b = log("b", "mode string", [("sport",)] * 5 + [("idle",)])
    out = compare.compare_histogram(a.unionByName(b), "mode").orderBy("axis", "dataset_id").collect()
    assert [r["label"] for r in out[::2]] == ["drive", "sport", "idle"]
    assert [r["count"] for r in out if r["dataset_id"] == "a"] == [5, 0, 1]
    assert [r["count"] for r in out if r["dataset_id"] == "b"] == [0, 5, 1]


def test_group_stats(two_drives):
    out = compare.compare_group_stats(two_drives, "speed", "mode")
    drive = out.filter("dataset_id = 'a' and `group` = 'drive'").first()
    assert (drive["count"], drive["avg"], drive["q1"], drive["median"], drive["q3"], drive["axis"]) == (5, 30.0, 20.0, 30.0, 40.0, 0)
    assert (drive["lowerfence"], drive["upperfence"]) == (10.0, 50.0)
    with pytest.raises(RequestError):
        compare.compare_group_stats(two_drives, "speed", "speed")


def test_group_stats_refuse_continuous_groups(spark):
    df = spark.range(250).select(F.lit("a").alias("dataset_id"), F.col("id").alias("g"), F.col("id").alias("v"))
    with pytest.raises(RequestError, match="too many"):
        compare.compare_group_stats(df, "v", "g")


@pytest.mark.parametrize("bounds", [False, True])
def test_summary_and_cdf_in_both_ways(two_drives, bounds, request):
    if bounds:
        request.getfixturevalue("tiny_bounds")
    out = {r["dataset_id"]: r for r in compare.compare_summary(two_drives, "speed").collect()}
    assert (out["a"]["avg"], out["b"]["avg"]) == (25.0, 12.5)
    assert (out["a"]["q25"], out["a"]["q50"], out["a"]["q75"]) == (12.5, 25.0, 37.5)
    cdf = {r["percent"]: r["value"] for r in compare.compare_cdf(two_drives, "speed").filter("dataset_id = 'a'").collect()}
    assert len(cdf) == 101 and all(math.isclose(v, 0.5 * p, abs_tol=1e-9) for p, v in cdf.items())


@pytest.mark.parametrize("probs", [[0.0, 0.1, 0.5, 0.77, 1.0], [i / 100 for i in range(1, 100)], [0.2, 0.5, 0.55, *[0.6 + i / 100 for i in range(12)]]])
def test_ranked_quantiles_equal_numpy(spark, probs):
    rng = np.random.default_rng(5)
    groups = {"a": rng.normal(size=101), "b": rng.integers(0, 4, 50).astype(float), "c": np.array([7.5]), "d": np.array([1.0, 2.0])}
    df = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs], "k string, v double")
    got = {r["k"]: r["q"] for r in quantiles(df, ["k"], "v", probs, "q", in_memory=False).collect()}
    for k, values in groups.items():
        assert np.allclose(got[k], np.quantile(values, probs), atol=1e-12), k


def test_curve(two_drives):
    out = compare.compare_curve(two_drives, "speed", "rpm", 5)
    a = {r["bin"]: r for r in out.filter("dataset_id = 'a'").collect()}
    assert (a[0]["center"], a[0]["mean"], a[4]["count"], a[4]["mean"]) == (5.0, 800.0, 2, 1700.0)
    b = {r["bin"]: r for r in out.filter("dataset_id = 'b'").collect()}
    assert (b[4]["count"], b[4]["mean"]) == (0, None)


def test_difference_scan(two_drives):
    out = compare.compare_diff(two_drives, "a", columns=["time", "speed", "rpm"])
    got = {r["signal"]: r for r in out.collect()}
    assert got["speed"]["delta_pct"] == -50.0 and got["time"]["ks"] == 0.0
    assert got["speed"]["max_ks"] > 0.3 and got["time"]["rank"] == 3


def test_exact_ks(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=60).round(1), rng.normal(0.5, 1.3, size=45).round(1)
    df = spark.createDataFrame([("a", float(v)) for v in a] + [("b", float(v)) for v in b], "dataset_id string, v double")
    at = np.unique(np.concatenate([a, b]))
    expected = np.abs((a[:, None] <= at).mean(axis=0) - (b[:, None] <= at).mean(axis=0)).max()
    assert math.isclose(compare.exact_ks(df, "v", "a").first()["ks"], expected, abs_tol=1e-12)


def test_bar_share_and_pooled_groups(log, spark):
    schema = "time bigint, speed bigint, gear bigint, mode string"
    a = log("a", schema, [(i, 10 * i, g, m) for i, (g, m) in enumerate(zip((1, 1, 2, 2, 2, 3), "xxyyyy"))])
    out = {r["category"]: r["value"] for r in charts.bar(a, "gear", None, None, "share").collect()}
    assert out == {"1": 33.333, "2": 50.0, "3": 16.667}
    inside = charts.bar(a, "gear", None, "mode", "share").groupBy("color").agg(F.sum("value").alias("s"))
    assert all(abs(r["s"] - 100) < 0.01 for r in inside.collect())
    twice = charts.group_members({"both": ["a", "b"], "one": ["a"]}, spark)
    b = a.withColumn("dataset_id", F.lit("b"))
    pooled = charts.group_bar(a.unionByName(b), twice, "gear", None, "count")
    assert {r["label"]: r["s"] for r in pooled.groupBy("label").agg(F.sum("n").alias("s")).collect()} == {"both": 12, "one": 6}
    heat = charts.group_heatmap(a.unionByName(b), twice, "time", "speed", 5).groupBy("label").agg(F.sum("percent").alias("s"))
    assert all(abs(r["s"] - 100) < 0.01 for r in heat.collect())
    with pytest.raises(RequestError):
        charts.group_members({str(i): ["a"] for i in range(9)}, spark)


def test_box_median_and_points(gears):
    out = charts.box(gears, "gear", "speed", keys=["dataset_id"]).filter("dataset_id = 'a' and category = '1'").first()
    assert (out["median"], out["count"], out["axis"]) == (5.0, 2, 0)
    bar = charts.bar(gears, "gear", "speed", None, "median", keys=["dataset_id"]).filter("dataset_id = 'b' and category = '3'").first()
    assert bar["value"] == 22.5
    line = charts.points(gears.filter("dataset_id = 'a'"), "line", "rpm", "speed", max_points=3)
    assert rows(line, "rpm") == [(1200,), (1600,), (800,)]


def test_null_colour_is_a_label_sorted_last(log):
    df = log("a", "x bigint, c string", [(1, "r"), (1, None), (2, None)])
    out = charts.histogram_by_color(df.withColumn("x", F.col("x").cast("string")), "x", "c")
    assert rows(out, "color", "label", "count", "percent") == sorted(
        [("r", "1", 1, 100.0), ("r", "2", 0, 0.0), (None, "1", 1, 50.0), (None, "2", 1, 50.0)], key=repr)
    assert charts.histogram_by_color(df, "x", "c", 5).filter("color is null").agg(F.sum("count")).first()[0] == 2


def test_membership_all_any_and_overlaps(spark):
    cat = spark.createDataFrame([("1", ["A", "s"], 6), ("2", ["B", "s"], 6), ("3", ["o"], 6)],
                                "dataset_id string, tags array<string>, row_count bigint")
    specs = [{"name": "AB", "tags": ["A", "B"], "match": "any"}, {"name": "S", "tags": ["s"]}, {"name": "AS", "tags": ["A", "s"]}]
    members = cohorts.membership(cat, specs)
    assert rows(members, "cohort", "dataset_id") == [("AB", "1"), ("AB", "2"), ("AS", "1"), ("S", "1"), ("S", "2")]
    assert rows(cohorts.overlaps(members), "dataset_id", "cohorts") == [("1", ["AB", "S", "AS"]), ("2", ["AB", "S"])]
    assert cohorts.resolve(cat, specs).filter("cohort = 'S'").first()["row_count"] == 12
    for bad in ([], [{"name": "", "tags": ["A"]}], [{"name": "x", "tags": []}], [{"name": "x", "tags": ["A"], "match": "some"}],
                [{"name": "x", "tags": ["A"]}] * 2, [{"name": "x", "tags": ["none"]}]):
        with pytest.raises(RequestError):
            cohorts.resolve(cat, bad)


@pytest.fixture(scope="module")
def weighted(log, spark):
    schema = "speed bigint, rpm bigint"
    a1 = log("a1", schema, [(10 * i, 800 + 200 * i) for i in range(6)])
    a2 = log("a2", schema, [(0, 800), (50, 1800)])
    b = log("b", schema, [(5 * i, 700 + 100 * i) for i in range(6)])
    members = spark.createDataFrame([("A", 0, "a1"), ("A", 0, "a2"), ("B", 1, "b")], "cohort string, position int, dataset_id string")
    return a1.unionByName(a2).unionByName(b), members


def test_cohort_histogram_weights(weighted):
    out = cohorts.cohort_histogram(*weighted, "speed", 5)
    a = out.filter("cohort = 'A'")
    assert a.first()["total_points"] == 8
    sums = a.agg(F.sum("pooled_percent"), F.sum("mean_percent"), F.sum("count")).first()
    assert abs(sums[0] - 100) < 1e-3 and abs(sums[1] - 100) < 1e-2 and sums[2] == 8
    last = a.filter("bin = 4").first()
    assert last["count"] == 3 and math.isclose(last["mean_percent"], round((33.333 + 50) / 2, 6))


def test_cohort_histogram2d(weighted):
    out = cohorts.cohort_histogram2d(*weighted, "speed", "rpm", 5, 5)
    assert rows(out.groupBy("cohort").agg(F.sum("count").alias("n")), "cohort", "n") == [("A", 8), ("B", 6)]
    assert abs(out.filter("cohort = 'A'").agg(F.sum("mean_percent")).first()[0] - 100) < 1e-3
    assert out.agg(F.min("lower_y")).first()[0] == 700.0
    with pytest.raises(RequestError):
        cohorts.cohort_histogram2d(*weighted, "speed", "speed")


@pytest.fixture(scope="module")
def samples(log, spark):
    logs = [("a1", 0), ("a2", 10), ("b1", 20), ("b2", 30), ("c1", 30), ("c2", 45)]
    df = None
    for name, low in logs:
        part = log(name, "speed bigint", [(low,), (low + 10,)])
        df = part if df is None else df.unionByName(part)
    members = spark.createDataFrame([(n[0].upper(), "ABC".index(n[0].upper()), n) for n, _ in logs],
                                    "cohort string, position int, dataset_id string")
    return df, members


def test_each_recording_is_one_sample(samples):
    values = cohorts.representative_values(*samples, ["speed"])
    assert rows(values.filter("cohort = 'A'"), "value") == [(15.0,), (5.0,)]
    out = {r["comparison"]: r for r in stat_tests.compare_cohorts(values).collect()}
    assert out["B"]["difference"] == 20.0 and out["B"]["cliffs_delta"] == 1.0 and out["C"]["difference"] == 32.5
    assert math.isclose(out["B"]["hedges_g"], (1 - 3 / 7) * 20 / math.sqrt(50)) and out["B"]["effect_size"] == "large"
    assert out["B"]["difference_percent"] == 200.0
    rng = np.random.default_rng(20260721)
    left, right = np.array([5.0, 15.0]), np.array([25.0, 35.0])
    boots = [rng.choice(v, size=(2000, 2), replace=True).mean(axis=1) for v in (left, right)]
    low, high = np.quantile(boots[1] - boots[0], [0.025, 0.975])
    assert math.isclose(out["B"]["ci95_low"], low) and math.isclose(out["B"]["ci95_high"], high)
    summary = cohorts.describe_values(values, ["signal", "cohort"]).filter("cohort = 'A'").first()
    assert (summary["n"], summary["mean"], summary["q25"]) == (2, 10.0, 7.5)


def test_metrics_and_multi_signal(samples, weighted):
    assert rows(cohorts.representative_values(*samples, ["speed"], "q75").filter("dataset_id = 'a1'"), "value") == [(7.5,)]
    assert rows(cohorts.representative_values(*samples, ["speed"], "max").filter("dataset_id = 'a1'"), "value") == [(10.0,)]
    many = cohorts.cohort_summary(*weighted, ["speed", "rpm", " speed "], "q50")
    assert rows(many, "signal", "cohort", "n") == [("rpm", "A", 2), ("rpm", "B", 1), ("speed", "A", 2), ("speed", "B", 1)]
    with pytest.raises(RequestError):
        cohorts.representative_values(*samples, ["speed"], "mode")


def test_bootstrap_blocks_give_the_same_interval(spark, monkeypatch):
    rng = np.random.default_rng(1)
    data = [("s", c, p, f"{c}{i}", float(v)) for c, p, mean in (("L", 0, 0.0), ("R", 1, 1.0))
            for i, v in enumerate(rng.normal(mean, 1, 80))]
    values = spark.createDataFrame(data, "signal string, cohort string, position int, dataset_id string, value double")
    pairs = stat_tests.sides(values)
    whole = stat_tests.bootstrap_interval(pairs).first()
    left, right = ([v[-1] for v in sorted((x for x in data if x[1] == c), key=lambda x: x[3])] for c in "LR")
    draws = np.random.default_rng(stat_tests.BOOTSTRAP_SEED)
    a, b = (draws.choice(v, size=(stat_tests.BOOTSTRAP_ROUNDS, len(v)), replace=True).mean(axis=1) for v in (left, right))
    plain = np.quantile(b - a, [0.025, 0.975])
    for blocks, at_once in ((10**6, 10**6), (40, 10**6), (299, 1_000), (7, 90)):
        monkeypatch.setattr(stat_tests, "BLOCK_VALUES", blocks)
        monkeypatch.setattr(stat_tests, "DRAWS_AT_ONCE", at_once)
        found = stat_tests.bootstrap_interval(pairs).first() if blocks < 10**6 else whole
        assert np.allclose([found["ci95_low"], found["ci95_high"]], plain, atol=1e-12)


def test_distribution_tails():
    assert math.isclose(student_two_sided(2.0, 10), 0.07338803477074037, rel_tol=1e-10)
    assert math.isclose(student_two_sided(-1.0, 1), 0.5, rel_tol=1e-10)
    assert math.isclose(student_two_sided(40.0, 3.5), 8.02e-06, rel_tol=0.2)
    # every order of 3 + 3 values is equally likely: the extreme one has probability 1/20 on each side
    assert math.isclose(rank_sum_two_sided(9, 3, 3, 0), 0.1, rel_tol=1e-12)
    assert rank_sum_two_sided(4.5, 3, 3, 6.0) <= 1.0


def test_rank_statistics_with_ties(spark):
    left, right = [1.0, 2.0, 2.0, 5.0], [2.0, 3.0, 5.0]
    data = [("s", c, p, f"{c}{i}", v) for c, p, vs in (("L", 0, left), ("R", 1, right)) for i, v in enumerate(vs)]
    values = spark.createDataFrame(data, "signal string, cohort string, position int, dataset_id string, value double")
    got = stat_tests.rank_statistics(stat_tests.sides(values)).first()
    u = sum((r > x) + 0.5 * (r == x) for r in right for x in left)
    assert got["u"] == u and math.isclose(got["cliffs_delta"], 2 * u / 12 - 1) and got["tie_term"] == 24 + 6


def test_significant_difference(spark):
    data = [("s", c, p, f"{c}{i}", v) for c, p, vs in (("A", 0, (10.0, 11.0, 12.0)), ("B", 1, (20.0, 21.0, 22.0))) for i, v in enumerate(vs)]
    values = spark.createDataFrame(data, "signal string, cohort string, position int, dataset_id string, value double")
    out = stat_tests.compare_cohorts(values, with_bootstrap=False).first()
    assert out["t_test_p"] < 0.05 and out["t_significant"] and math.isclose(out["mann_whitney_p"], 0.1)


@pytest.mark.parametrize("bounds", [False, True])
def test_transitions_and_rates(gears, ab_members, bounds, request):
    if bounds:
        request.getfixturevalue("tiny_bounds")
    out = sequences.transition_rates(gears, ab_members, "gear", "time")
    got = {(r["cohort"], r["transition"]): r for r in out.collect()}
    assert {k: r["count"] for k, r in got.items()} == {
        ("A", "1→2"): 1, ("A", "2→3"): 1, ("A", "2→1"): 0, ("B", "1→2"): 2, ("B", "2→3"): 1, ("B", "2→1"): 1}
    assert math.isclose(got["A", "1→2"]["pooled_rate"], 166.666667)
    timed = sequences.transition_rates(gears, ab_members, "gear", "time", denominator="time", scale=3600)
    assert {(r["cohort"], r["transition"]): r["mean_rate"] for r in timed.collect()} == {
        ("A", "1→2"): 720.0, ("A", "2→3"): 720.0, ("A", "2→1"): 0.0, ("B", "1→2"): 1440.0, ("B", "2→3"): 720.0, ("B", "2→1"): 720.0}


@pytest.fixture(scope="module")
def shifts(log):
    schema = "time bigint, shift bigint, rpm bigint"
    a = log("a", schema, [(0, 0, 800), (1, 1, 1000), (2, 0, 900), (3, 1, 1100), (4, 1, 1100), (5, 0, 900), (6, 0, 800)])
    b = log("b", schema, [(0, 0, 800), (1, 1, 900), (2, 1, 950), (3, 1, 990), (4, 0, 800)])
    return a.unionByName(b)


@pytest.mark.parametrize("bounds", [False, True])
def test_events(shifts, ab_members, bounds, request):
    if bounds:
        request.getfixturevalue("tiny_bounds")
    found = sequences.events(shifts, "shift", "1", "time", secondary="rpm")
    assert rows(found, "dataset_id", "duration", "rows", "secondary") == [("a", 0.0, 1, 1000.0), ("a", 1.0, 2, 1100.0), ("b", 2.0, 3, 946.6666666666666)]
    out = {r["cohort"]: r for r in sequences.event_summary(shifts, ab_members, "shift", "1", "time").collect()}
    assert (out["A"]["event_count"], out["A"]["mean"], out["B"]["p90"], out["B"]["events_per_1k_rows"]) == (2, 0.5, 2.0, 200.0)
    merged = sequences.events(shifts, "shift", "1", "time", filters=[{"column": "time", "op": "ne", "value": 2}])
    assert merged.filter("dataset_id = 'a'").count() == 1


@pytest.fixture(scope="module")
def lines(log):
    schema = "time bigint, x double, y double, z double"
    a = log("a", schema, [(i, float(i), 2.0 * i + 1, -3.0 * i) for i in range(1, 7)])
    b = log("b", schema, [(i, float(i), 1.0 * i + 5, -1.0 * i) for i in range(1, 7)])
    return a.unionByName(b)


def test_regression_and_correlation(lines, ab_members):
    out = {r["cohort"]: r for r in regression.cohort_regression(lines, ab_members, "x", "y").collect()}
    assert (out["A"]["slope"], out["A"]["intercept"], out["A"]["r2"], out["B"]["slope"]) == (2.0, 1.0, 1.0, 1.0)
    assert (out["A"]["min_x"], out["A"]["max_x"], out["A"]["fit_max_x"], out["A"]["n"]) == (1.0, 6.0, 13.0, 6)
    r = {(c["cohort"], c["a"], c["b"]): c["r"] for c in regression.cohort_correlation(lines, ab_members, ["x", "y", "z"]).collect()}
    assert r["A", "x", "y"] > 0.99 and r["A", "x", "z"] < -0.99 and r["B", "z", "z"] == 1.0
    flat = regression.cohort_regression(lines.withColumn("x", F.lit(1.0)), ab_members, "x", "y").first()
    assert flat["slope"] is None and flat["r2"] is None
    assert regression.regression_points(lines, ab_members, "x", "y").count() == 12


def test_pooled_regression_combines_recordings(spark, lines):
    members = spark.createDataFrame([("P", 0, "a"), ("P", 0, "b")], "cohort string, position int, dataset_id string")
    got = regression.cohort_regression(lines, members, "x", "y").first()
    data = [(r["x"], r["y"]) for r in lines.collect()]
    slope, intercept = np.polyfit(*np.array(data).T, 1)
    assert math.isclose(got["slope"], slope, abs_tol=1e-6) and math.isclose(got["intercept"], intercept, abs_tol=1e-6)
    r = regression.cohort_correlation(lines, members, ["x", "y"]).filter("a = 'x' and b = 'y'").first()["r"]
    assert math.isclose(r, np.corrcoef(*np.array(data).T)[0, 1], abs_tol=1e-6)


def test_ranked_quantiles_of_copies_are_exact(spark):
    """A copy must not pick up rounding noise: curves with plateaus are compared value by value."""
    df = spark.createDataFrame([(0.07,)] * 40 + [(0.02,)] * 59, "v double")
    q = quantiles(df, [], "v", [i / 100 for i in range(1, 100)], "q").first()["q"]
    assert set(q) <= {0.02, 0.07} or sum(v not in (0.02, 0.07) for v in q) <= 1
