"""Times in filters, profiles and elapsed axes; labels of extreme numbers; the exact rank test."""

from __future__ import annotations

import itertools
import math
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from odolake.functions.distributions import rank_sum_tail, rank_sum_two_sided
from odolake.functions.scalars import category
from odolake.operators import course, profile
from odolake.operators.filters import apply_filters

TIMES = ["0099-12-31 23:59:59", "2023-12-31 23:59:59.999999", "2024-01-01 00:00:00", "2024-01-05 09:59:59", "2024-01-05 10:00:00.5",
         "2024-01-05 10:00:00.55", "2024-01-05 19:00:00", "2024-02-29 12:30:00", "2024-12-31 23:59:59.9", "9999-12-31 23:59:59.999999"]
TEXTS = ["2024", "2024-01", "2024-13", "2024-01-05", "2024-01-05 1", "2024-01-05 10", "2024-01-05 10:00:00", "2024-01-05 10:00:00.5",
         "2024-01-05 10:00:00.50", "2024-02-30", "2024-12", "9999", "9999-12-31", "0000", "20", "", "x", "2024-1-5", "+10000", "-", "0099"]


@pytest.mark.parametrize("dtype", ["timestamp", "timestamp_ntz", "date"])
def test_ranges_of_times_keep_what_the_texts_keep(spark, dtype):
    df = spark.createDataFrame([(t,) for t in TIMES], "s string").select(F.col("s").cast(dtype).alias("t"))
    outside = spark.sql("SELECT CAST('+12000-05-06' AS DATE) AS t UNION ALL SELECT CAST('-0044-03-15' AS DATE) UNION ALL SELECT CAST(NULL AS DATE)")
    df = df.unionByName(outside.select(F.col("t").cast(dtype).alias("t"))).select("t", F.col("t").cast("string").alias("s")).cache()
    texts = [r["s"] for r in df.select("s").collect()]
    ops = {"eq": str.__eq__, "gt": str.__gt__, "ge": str.__ge__, "lt": str.__lt__, "le": str.__le__, "ne": str.__ne__}
    cells = [(op, v) for op in ops for v in [*TEXTS, *texts[:6]] if v is not None]
    kept = [F.count_if(F.coalesce(_condition_of(df, op, v), F.lit(False))) for op, v in cells]
    got = df.agg(*[c.alias(f"c{i}") for i, c in enumerate(kept)]).first()
    for i, (op, v) in enumerate(cells):
        assert got[i] == sum(1 for s in texts if s is not None and ops[op](s, v)), (op, v)


def _condition_of(df, op, value):
    from odolake.operators.filters import _condition

    return _condition(df, {"column": "t", "op": op, "value": value})


def test_a_range_of_times_reaches_the_scan(spark, tmp_path, capsys):
    path = str(tmp_path / "times")
    spark.sql("SELECT id, CAST('2024-01-01' AS TIMESTAMP) + make_interval(0, 0, 0, CAST(id AS INT)) AS ts FROM range(60)").write.parquet(path)
    only = [{"column": "ts", "op": "ge", "value": "2024-01-20"}, {"column": "ts", "op": "lt", "value": "2024-02-0"}]
    kept = apply_filters(spark.read.parquet(path), only)
    assert sorted(r["id"] for r in kept.collect()) == list(range(19, 31))
    kept.explain("formatted")
    pushed = next(line for line in capsys.readouterr().out.splitlines() if line.startswith("PushedFilters"))
    assert "GreaterThanOrEqual(ts,2024-01-20" in pushed and "LessThanOrEqual(ts,2024-03-01" in pushed


def test_profiles_of_times(spark):
    df = spark.createDataFrame([(f"2024-01-0{i}",) for i in (1, 2, 3, 4, 9)], "s string").select(
        F.col("s").cast("date").alias("day"), F.col("s").cast("timestamp").alias("at"), "s")
    day = 86_400.0
    first = 1_704_067_200.0
    for exact in (False, True):
        got = {r["column_name"]: r for r in profile.column_profile(df, exact=exact).collect()}
        for name in ("day", "at"):
            r = got[name]
            assert (r["q25"], r["q50"], r["q75"], r["avg"], r["std"]) == (first + day, first + 2 * day, first + 3 * day, first + 2.8 * day, None)
        assert got["s"]["avg"] is None and got["day"]["min"] == "2024-01-01"


def test_exact_profiles_of_times_beyond_one_task(spark, tiny_bounds):
    df = spark.range(101).select(F.timestamp_seconds(F.col("id") * 10).alias("t"), F.col("id").alias("v"))
    got = {r["column_name"]: r for r in profile.column_profile(df, exact=True).collect()}
    assert (got["t"]["q25"], got["t"]["q50"], got["t"]["q75"]) == (250.0, 500.0, 750.0) and got["v"]["q50"] == 50.0


def test_elapsed_seconds_of_texts(spark):
    runs = {"dash": ["2024-01-05 10:00:00", "2024-01-05T10:00:01.5Z", "2024-01-05 11:00:00+01:00"], "slash": ["2024/1/5 10:00", "2024/1/5 10:02", "2024/1/6"],
            "numbers": ["0", " 2000", "4000"], "small": ["1.5", "2", ""], "mixed": ["2024-01-05", "7", "8"], "words": ["a", "2", "3"],
            "clock": ["10:00", "10:01", "10:02"], "null": ["2024-01-05", None, "2024-01-06"]}
    data = [(k, i, v) for k, values in runs.items() for i, v in enumerate(values)]
    out = course.timeline(spark.createDataFrame(data, "run string, row_pos bigint, t string"), "t")
    got = {(r["run"], r["row_pos"]): r["seconds"] for r in out.collect()}
    wanted = {"dash": [0, 1.5, 0], "slash": [0, 120, 50_400], "numbers": [0, 2, 4], "small": [0, 0.5, -1.5], "mixed": [0, 1, 2], "words": [0, 1, 2],
              "clock": [0, 1, 2], "null": [0, 1, 2]}
    assert got == {(k, i): v for k, values in wanted.items() for i, v in enumerate(values)}


def test_labels_of_extreme_numbers(spark):
    values = [1e15, 1.5e15, 1e16, 1.5e-7, 1e-5, 1e-4, -2.5e300, 1e100, 0.0, 5e-324, float("nan"), float("-inf"), None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i")
    got = [r[0] for r in df.select(category(F.col("v"), df.schema["v"].dataType)).collect()]
    assert got[:9] == ["1000000000000000.0", "1500000000000000.0", "1e+16", "1.5e-07", "1e-05", "0.0001", "-2.5e+300", "1e+100", "0.0"]
    assert got[9].endswith("e-324") and got[10:] == ["nan", "-inf", None]


@pytest.mark.parametrize(("n", "m"), [(1, 1), (1, 6), (2, 3), (3, 3), (4, 5), (5, 3)])
def test_rank_tails_equal_a_count_of_all_arrangements(n, m):
    sums = [sum(a) - n * (n - 1) // 2 for a in itertools.combinations(range(n + m), n)]
    for most in range(n * m + 1):
        assert rank_sum_tail(n, m, most) == float(Fraction(sum(u <= most for u in sums), len(sums)))


def test_rank_tails_of_long_sides_are_whole_and_symmetric():
    n, m = 8, 3_000_001
    assert rank_sum_tail(n, m, n * m) == 1.0 and rank_sum_tail(n, m, 0) == pytest.approx(1 / math.comb(n + m, n))
    middle = n * m // 2  # an even number of cells: P(U <= middle) + P(U < middle) = 1
    assert rank_sum_tail(n, m, middle) + rank_sum_tail(n, m, middle - 1) == pytest.approx(1.0, abs=1e-15)
    normal = math.erfc(0.5 / math.sqrt(2))
    u = n * m / 2 + 0.5 * math.sqrt(n * m * (n + m + 1) / 12)
    assert rank_sum_two_sided(int(u), n, m, 0) == pytest.approx(normal, abs=0.02)
