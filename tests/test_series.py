from __future__ import annotations

import pytest
from conftest import rows
from pyspark.sql import functions as F

from odolake import RequestError
from odolake.functions.scalars import base_name, category, recording_start
from odolake.operators import bins, catalog, profile, sampling, schema
from odolake.operators.filters import apply_filters, resolvable_filters
from odolake.operators.ordered import Ordered
from odolake.sources.readers import stitch


def test_timeseries_filters_orders_and_thins(drive_a):
    out = sampling.timeseries(drive_a, "time", ["speed"], [{"column": "speed", "op": "ge", "value": 20}], 2)
    assert rows(out, "time", "total_rows", "stride") == [(2, 4, 2), (4, 4, 2)]


def test_timeseries_puts_null_times_last(log):
    df = log("n", "t bigint, y bigint", [(None, 1), (2, 2), (1, 3)])
    out = sampling.timeseries(df, "t", ["y"]).orderBy("rn")
    assert [r["y"] for r in out.collect()] == [3, 2, 1]


def test_timeseries_needs_a_signal_and_known_columns(drive_a):
    with pytest.raises(RequestError):
        sampling.timeseries(drive_a, "time", [])
    with pytest.raises(RequestError):
        sampling.timeseries(drive_a, "time", ["nothing"])


def test_scatter_keeps_recorded_order(drive_a):
    out = sampling.scatter(drive_a, "rpm", "speed", max_points=3).orderBy("rn")
    assert [r["speed"] for r in out.collect()] == [0, 20, 40]


def test_group_sample_uses_floor_stride(spark):
    df = spark.range(100).select(F.lit("g").alias("g"), F.col("id").alias("row_pos"))
    out = sampling.group_sample(df, ["g"], ["row_pos"], 30)
    assert out.count() == 34 and out.first()["stride"] == 3


@pytest.mark.parametrize("split", [False, True])
def test_ordered_operations_agree_in_both_ways(spark, split):
    data = [(k, i, (i * 7) % 5, None if i % 3 else i) for k, n in (("x", 40), ("y", 1), ("z", 7)) for i in range(n)]
    df = spark.createDataFrame(data, "k string, i int, v int, s int")
    o = Ordered(df, ["k"], ["v", "i"], split=split).row_number("rn", "n").lag({"pv": "v", "pi": "i"})
    o = o.running_sum({"cum": F.col("v")}).last_known({"last": F.col("s")}).next_known({"next": F.col("s")})
    o = o.last_known({"before": F.col("s")}, inclusive=False).totals({"top": F.max("i")})
    got = {(r["k"], r["i"]): r for r in o.df.collect()}
    assert len(got) == len(data)
    for key in "xyz":
        part = sorted((r for r in data if r[0] == key), key=lambda r: (r[2], r[1]))
        for at, (_, i, v, s) in enumerate(part):
            r = got[(key, i)]
            known = [p[3] for p in part]
            assert (r["rn"], r["n"], r["top"]) == (at + 1, len(part), max(p[1] for p in part))
            assert (r["pi"], r["pv"]) == ((part[at - 1][1], part[at - 1][2]) if at else (None, None))
            assert r["cum"] == sum(p[2] for p in part[:at + 1])
            assert r["last"] == next((x for x in reversed(known[:at + 1]) if x is not None), None)
            assert r["before"] == next((x for x in reversed(known[:at]) if x is not None), None)
            assert r["next"] == next((x for x in known[at:] if x is not None), None)


def test_large_recordings_are_split_by_the_bound(drive_a, tiny_bounds):
    assert Ordered(drive_a, ["dataset_id"], ["row_pos"]).split
    out = sampling.timeseries(drive_a, "time", ["speed"], None, 3)
    assert rows(out, "time", "total_rows", "stride") == [(0, 6, 2), (2, 6, 2), (4, 6, 2)]


def test_filters(drive_a):
    def kept(*f):
        return apply_filters(drive_a, [dict(zip(("column", "op", "value"), x)) for x in f]).count()

    assert kept() == 6
    assert kept(("speed", "gt", "20"), ("mode", "eq", "drive")) == 3
    assert kept(("mode", "contains", "d%e")) == 6 and kept(("mode", "contains", "DRIVE")) == 0
    assert kept(("mode", "ne", "idle")) == 5
    assert kept(("rpm", "isnull")) == 0 and kept(("rpm", "notnull")) == 6
    for bad in (("speed", "gt", "fast"), ("speed", "like", 1), ("nothing", "eq", 1)):
        with pytest.raises(RequestError):
            kept(bad)


def test_temporal_filter_compares_text(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-01-01 00:00:01.5' AS t UNION ALL SELECT timestamp_ntz'2024-01-02 00:00:00'")
    assert apply_filters(df, [{"column": "t", "op": "eq", "value": "2024-01-01 00:00:01.5"}]).count() == 1
    assert apply_filters(df, [{"column": "t", "op": "ge", "value": "2024-01-02"}]).count() == 1


def test_histogram_edges_and_counts(drive_a):
    out = bins.histogram(drive_a, "speed", 5).orderBy("bin").collect()
    assert [r["count"] for r in out] == [1, 1, 1, 1, 2]
    assert [r["lower"] for r in out] + [out[-1]["upper"]] == [0, 10, 20, 30, 40, 50]


def test_histogram_of_a_constant_and_of_nothing(log):
    one = log("c", "v double", [(3.0,), (3.0,), (None,)])
    out = bins.histogram(one, "v", 5).orderBy("bin").collect()
    assert [r["count"] for r in out] == [2, 0, 0, 0, 0] and out[-1]["upper"] == 4.0
    assert bins.histogram(log("e", "v double", [(None,)]), "v", 5).count() == 0


def test_histogram_needs_numbers(drive_a):
    with pytest.raises(RequestError):
        bins.histogram(drive_a, "mode")


def test_category_histogram_keeps_null(log):
    df = log("c", "m string", [("a",), ("a",), (None,)])
    assert [(r["label"], r["count"]) for r in bins.category_histogram(df, "m").orderBy("axis").collect()] == [("a", 2), (None, 1)]


def test_top_labels_order(spark):
    def axis(pairs, **kw):
        df = spark.createDataFrame(pairs, "label string, total bigint")
        return [r["label"] for r in bins.top_labels(df, 3, **kw).orderBy("axis").collect()]

    assert axis([("10", 5), ("9", 4), ("2", 3), ("1", 1)]) == ["2", "9", "10"]
    assert axis([("b", 5), ("a", 4), ("2", 3)]) == ["2", "a", "b"]
    assert axis([("b", 3), ("a", 4), ("c", 5)], numeric_order="count") == ["c", "a", "b"]
    assert axis([("10", 5), ("9", 4), ("2", 3)], numeric_order=None) == ["10", "9", "2"]


def test_correlation(drive_a, log):
    out = {(r["a"], r["b"]): r["r"] for r in profile.correlation(drive_a, ["speed", "rpm"]).collect()}
    assert out == {("speed", "rpm"): 1.0, ("rpm", "speed"): 1.0, ("speed", "speed"): 1.0, ("rpm", "rpm"): 1.0}
    flat = log("f", "x double, y double", [(1.0, 1.0), (2.0, 1.0), (None, 5.0)])
    assert {r["r"] for r in profile.correlation(flat).filter("a <> b").collect()} == {None}
    with pytest.raises(RequestError):
        profile.correlation(drive_a, ["speed"])


@pytest.mark.parametrize("exact", [False, True])
def test_column_profile(drive_a, exact):
    out = {r["column_name"]: r for r in profile.column_profile(drive_a, exact=exact, keys=["dataset_id"]).collect()}
    speed = out["speed"]
    assert (speed["min"], speed["max"], speed["avg"], speed["count"], speed["null_percentage"]) == ("0", "50", 25.0, 6, 0.0)
    assert out["mode"]["avg"] is None and out["mode"]["approx_unique"] == 2
    if exact:
        assert (speed["q25"], speed["q50"], speed["q75"]) == (12.5, 25.0, 37.5)


def test_exact_profile_of_large_groups(drive_a, tiny_bounds):
    out = {r["column_name"]: r for r in profile.column_profile(drive_a, exact=True).collect()}
    assert (out["speed"]["q25"], out["speed"]["q50"], out["speed"]["q75"]) == (12.5, 25.0, 37.5)


def test_stats_chip(drive_a):
    r = profile.stats_chip(drive_a, "speed").first()
    assert (r["count"], r["avg"], r["min"], r["max"], r["median"]) == (6, 25.0, 0.0, 50.0, 25.0)


def test_fold_colors(spark):
    data = [(str(c), i) for c in range(12) for i in range(12 - c)]
    df = spark.createDataFrame(data, "c string, i int")
    out = sampling.fold_colors(df, "c")
    assert {r["series"] for r in out.collect()} == {*map(str, range(8)), "other"}
    assert out.filter("series = 'other'").count() == 4 + 3 + 2 + 1
    kept = sampling.fold_colors(df.filter("cast(c as int) < 9"), "c", by_count=False)
    assert {r["series"] for r in kept.collect()} == set(map(str, range(9)))
    assert "other" in {r["series"] for r in sampling.fold_colors(df, "c", by_count=False).collect()}


def test_schema_kinds_and_heuristics(drive_a, spark):
    out = {r["name"]: r["kind"] for r in schema.describe(drive_a).collect()}
    assert out == {"time": "numeric", "speed": "numeric", "rpm": "numeric", "mode": "other"}

    def numeric(*names):
        return [(n, "numeric") for n in names]

    assert schema.coordinate_columns(numeric("latitude", "longitude")) == ("latlon", ["latitude", "longitude"])
    assert schema.coordinate_columns(numeric("GPS_z", "GPS_x")) == ("axes", ["GPS_x", "GPS_z"])
    assert schema.coordinate_columns(numeric("speed")) == ("none", [])
    assert schema.has_other_signals(numeric("latitude", "longitude", "speed"))
    assert not schema.has_other_signals(numeric("latitude", "longitude"))
    assert schema.speed_column(numeric("rpm", "vehicle_speed_kmh")) == "vehicle_speed_kmh"
    assert schema.common_columns([drive_a, drive_a.drop("rpm")], numeric_only=True) == ["time", "speed"]


def test_aliases_and_label_sets(drive_a):
    aliases = [("velocity", "v_kmh"), ("velocity", "speed")]
    assert schema.resolve_column("v_kmh", drive_a.columns, aliases) == "speed"
    assert schema.resolve_column("torque", drive_a.columns, aliases) is None
    assert resolvable_filters([{"column": "v_kmh", "op": "gt", "value": 1}, {"column": "torque", "op": "gt", "value": 1}],
                              drive_a.columns, aliases) == [{"column": "speed", "op": "gt", "value": 1}]
    chosen, missing = schema.use_label_set(drive_a, ["speed", "torque"])
    assert chosen.columns == ["dataset_id", "row_pos", "speed"] and missing == 1


def test_names(spark):
    names = ["260518_191805", "gps_2026-05-18_19-18-05.csv", "log 20260518T191805", "drive_a", "999999_999999"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", recording_start(F.col("n")).alias("t"))
    got = {r["n"]: str(r["t"]) for r in df.collect()}
    assert {got[n] for n in names[:3]} == {"2026-05-18 19:18:05"} and {got[n] for n in names[3:]} == {"None"}
    bases = spark.createDataFrame([("Drive_GPS.csv",), ("drive.parquet",), ("Drive 位置",)], "n string").select(base_name(F.col("n")))
    assert {r[0] for r in bases.collect()} == {"drive"}


def test_category_text_of_doubles(spark):
    df = spark.createDataFrame([(1e8,), (1.5,), (0.0001,), (123456789.25,)], "v double")
    got = [r[0] for r in df.select(category(F.col("v"), df.schema["v"].dataType)).collect()]
    assert got == ["100000000.0", "1.5", "0.0001", "123456789.25"]


def test_stitch_aligns_by_name(spark):
    a = spark.createDataFrame([(0, 0, 10), (1, 1, 11)], "row_pos bigint, time bigint, speed bigint")
    b = spark.createDataFrame([(0, 20, 2), (1, 21, 3)], "row_pos bigint, speed bigint, time bigint")
    c = spark.createDataFrame([(0, 4, 40.5)], "row_pos bigint, time bigint, speed double")
    out = stitch([a, b, c]).orderBy("row_pos").collect()
    assert [(r["row_pos"], r["time"], r["speed"]) for r in out] == [(0, 0, 10), (1, 1, 11), (2, 2, 20), (3, 3, 21), (4, 4, 40.5)]


def test_catalog_tags(spark):
    df = spark.createDataFrame([("a", ["x", "y"]), ("b", ["z"])], "dataset_id string, tags array<string>")
    edited = catalog.edit_tags(df, add=["z", " w ", ""], remove=["x"])
    assert {r["dataset_id"]: r["tags"] for r in edited.collect()} == {"a": ["y", "z", "w"], "b": ["z", "w"]}
    assert [r["tag"] for r in catalog.distinct_tags(df).collect()] == ["x", "y", "z"]
    assert catalog.filter_by_tags(df, ["z"]).count() == 1 and catalog.filter_by_tags(df, []).count() == 2
    assert catalog.without(df, ["a"]).count() == 1
    assert catalog.set_tags(df, [" q ", "q", ""]).first()["tags"] == ["q"]
