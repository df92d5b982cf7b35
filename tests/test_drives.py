from __future__ import annotations

import math

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from odolake import RequestError
from odolake.operators import asof, course, models, overlay, pairing, routes, spectrum, tracks
from odolake.plans import cohort_reports, drives


def pair_frame(spark, times, name="t"):
    return spark.createDataFrame([("p", i, t) for i, t in enumerate(times)], f"pair string, row_pos bigint, {name} double")


@pytest.mark.parametrize("bounds", [False, True])
def test_nearest_time_join(spark, bounds, request):
    if bounds:
        request.getfixturevalue("tiny_bounds")
    left = pair_frame(spark, [0.0, 1.5, 2.5, 9.0, None])
    right = pair_frame(spark, [1.0, 2.0, 3.0, None])
    assert rows(asof.nearest(left, right), "row_pos", "right_pos", "delta") == [(0, 0, 1.0), (1, 0, 0.5), (2, 1, 0.5), (3, 2, 6.0)]
    same = asof.nearest(left, left)
    assert rows(same.filter("row_pos = right_pos"), "delta") == [(0.0,)] * 4


def test_alignment_falls_back_to_positions(spark):
    near, far = pair_frame(spark, [0.0, 1.0, 2.0]), pair_frame(spark, [1e6, 1e6 + 1, 1e6 + 2])
    assert rows(asof.align(near, near), "row_pos", "right_pos", "align_mode") == [(i, i, "time") for i in range(3)]
    assert rows(asof.align(near, far), "row_pos", "right_pos", "align_mode") == [(i, i, "rowid") for i in range(3)]


def test_linked_cursor_stays_in_range(spark):
    left, right = pair_frame(spark, [0.0, 5.0, 9.0]), pair_frame(spark, [4.0, 6.0])
    assert rows(asof.nearest_in_range(left, right), "row_pos", "right_pos") == [(1, 0)]
    assert rows(asof.nearest_in_range(left, right, shift=4.0), "row_pos", "right_pos") == [(2, 0)]


def test_resample_holds_edges_and_interpolates(spark):
    df = spark.createDataFrame([("p", i, t, y) for i, (t, y) in enumerate([(0.0, 0.0), (2.0, 4.0), (2.0, 6.0), (3.0, 6.0)])],
                               "pair string, row_pos bigint, t double, y double")
    out = asof.resample(df, asof.uniform_grid(df, ["pair"], 1.0), ["pair"])
    assert rows(out, "g", "y") == [(0, 0.0), (1, 2.0), (2, 4.0), (3, 6.0)]


@pytest.fixture(scope="module")
def gps_logs(log):
    signal = log("s", "time bigint, speed bigint, rpm bigint", [(i, 10 * i, 800 + i) for i in range(5)])
    gps = log("g", "latitude double, longitude double", [(35 + i / 100, 139 + i / 100) for i in range(5)])
    return tuple(df.withColumn("pair", F.lit("p")).drop("dataset_id") for df in (signal, gps))


def test_track_by_position(gps_logs):
    out, roles = tracks.map_track(*gps_logs, ["speed"])
    assert (roles["mode"], roles["x"], roles["y"]) == ("geographic", "longitude", "latitude")
    assert rows(out, "row_pos", "latitude", "speed") == [(i, 35 + i / 100, 10 * i) for i in range(5)]
    kept, _ = tracks.map_track(*gps_logs, ["speed"], filters=[{"column": "speed", "op": "ge", "value": 30}])
    assert rows(kept, "track_y") == [(35.03,), (35.04,)]
    with pytest.raises(RequestError):
        tracks.map_track(gps_logs[0], gps_logs[0])


def test_track_by_time_when_clocks_are_shifted(spark):
    signal = pair_frame(spark, [0.0, 1.0, 2.0, 3.0, 4.0], "time").withColumn("speed", F.col("row_pos"))
    gps = pair_frame(spark, [0.0, 1.0, 2.0, 3.0, 4.0, 5.0], "time").withColumn("latitude", 35 + F.col("row_pos") / 100).withColumn(
        "longitude", F.lit(139.0))
    out, roles = tracks.map_track(signal, gps.withColumnRenamed("time", "gps_time"), ["speed"],
                                  signal_name="260518_191805", gps_name="gps_2026-05-18_19-18-08")
    got = out.orderBy("row_pos").collect()
    assert {r["align_mode"] for r in got} == {"time"} and [r["latitude"] for r in got] == [35.0, 35.0, 35.0, 35.0, 35.01]
    months, _ = tracks.map_track(signal, gps.withColumnRenamed("time", "gps_time"), ["speed"],
                                 signal_name="260118_191805", gps_name="gps_2026-05-18_19-18-08")
    assert {r["align_mode"] for r in months.collect()} == {"rowid"}


def test_long_tracks_are_thinned(spark):
    df = spark.range(2000).select(F.lit("p").alias("pair"), F.col("id").alias("row_pos"), F.col("id").alias("time"))
    gps = df.select("pair", "row_pos", (35 + F.col("row_pos") * 1e-5).alias("lat"), F.lit(139.0).alias("lon"))
    out, _ = tracks.map_track(df, gps, ["time"], max_points=500)
    assert out.first()["stride"] == 4 and out.count() == 500


def axes_frame(spark, xs, ys, zs):
    return spark.createDataFrame([("p", i, *v) for i, v in enumerate(zip(xs, ys, zs))],
                                 "pair string, row_pos bigint, GPS_x double, GPS_y double, GPS_z double")


def test_axis_choice(spark):
    n = range(5)
    signal = spark.createDataFrame([("p", i, i) for i in n], "pair string, row_pos bigint, speed bigint")
    degrees = axes_frame(spark, [139 + i / 100 for i in n], [35 + i / 100 for i in n], [float(i) for i in n])
    _, roles = tracks.map_track(signal, degrees, ["speed"])
    assert roles == {"mode": "geographic", "x": "GPS_x", "y": "GPS_y", "altitude": "GPS_z", "x_axis": None}
    meters = axes_frame(spark, [100.0 * i for i in n], [1.0] * 5, [50.0 * i for i in n]).drop("GPS_y")
    _, roles = tracks.map_track(signal, meters, ["speed"])
    assert (roles["mode"], roles["x"], roles["y"]) == ("planar", "GPS_x", "GPS_z")
    out, roles = tracks.map_track(signal, degrees, ["speed"], lat_col="GPS_x", lon_col="GPS_y")
    assert (roles["x"], roles["y"], roles["altitude"]) == ("GPS_x", "GPS_y", "GPS_z") and "altitude" in out.columns
    swapped, roles = tracks.map_track(signal, degrees.withColumnsRenamed({"GPS_x": "a", "GPS_y": "b"}), ["speed"], lat_col="a", lon_col="b")
    assert (roles["x"], roles["y"]) == ("a", "b")


def catalog(spark, entries):
    data = [(i, n, n, t, k, c, x) for k, (i, n, t, c, x) in enumerate(entries)]
    schema = "dataset_id string, name string, original_filename string, tags array<string>, at bigint, coord_kind string, extra_signals boolean"
    return spark.createDataFrame(data, schema).withColumn("created_at", F.timestamp_seconds("at"))


def test_pairing_order(spark):
    cat = catalog(spark, [
        ("s1", "drive.csv", [], "none", False), ("g1", "Drive_GPS.csv", [], "latlon", False),
        ("s2", "260518_191805", ["toyo"], "none", False), ("g2", "gps_2026-05-18_19-18-07", [], "latlon", False),
        ("g3", "gps_2026-05-18_19-18-06", [], "latlon", False), ("g4", "gps_2026-05-18_19-18-04x", ["TOYO_GPS"], "latlon", False),
        ("s3", "lonely", ["nis"], "none", False), ("g5", "other", ["nis gps"], "axes", False),
        ("w", "whole", [], "latlon", True), ("s4", "nothing", ["zzz"], "none", False)])
    got = {r["signal_id"]: (r["gps_id"], r["match"]) for r in pairing.gps_pairs(cat).collect()}
    assert got == {"s1": ("g1", "name"), "s2": ("g4", "timestamp"), "s3": ("g5", "tag"), "w": ("w", "self")}
    assert pairing.list_gps(cat).count() == 6
    two = catalog(spark, [("s", "a", ["x"], "none", False), ("g1", "b", ["x_gps"], "latlon", False), ("g2", "c", ["x_gps"], "latlon", False)])
    assert pairing.gps_pairs(two).count() == 0
    same = catalog(spark, [("s", "a", [], "none", False)] + [(f"g{i}", "a_gps", [], "latlon", True) for i in range(6)])
    got = {r["signal_id"]: r["gps_id"] for r in pairing.gps_pairs(same).collect()}
    assert got == {"s": "g5", **{f"g{i}": "g5" for i in range(5)}, "g5": "g4"}


def test_similar_runs(spark, log):
    def track(name, lat, lon, shift=0.0):
        return log(name, "lon double, lat double", [(lon + shift + i / 100, lat + i / 100) for i in range(3)])

    df = track("tokyo", 35.0, 139.0).unionByName(track("tokyo2", 35.0, 139.005)).unionByName(track("beside", 35.0, 139.03)).unionByName(
        track("osaka", 34.7, 135.5))
    ids = [("tokyo", ["x"]), ("tokyo2", []), ("beside", []), ("osaka", ["x"])]
    cat = spark.createDataFrame(ids, "dataset_id string, tags array<string>")
    runs = cat.select(F.col("dataset_id").alias("signal_id"), F.col("dataset_id").alias("gps_id"), F.lit("self").alias("match"))
    extents = routes.route_extents(df, "lon", "lat", geographic=True)
    out = routes.similar_runs(runs, extents, cat, "tokyo").collect()
    assert [r["signal_id"] for r in out] == ["tokyo2", "beside", "osaka"]
    assert [r["overlaps"] for r in out] == [True, False, False] and out[1]["nearby"] and out[1]["relative_distance"] <= 1.5
    assert out[2]["same_tag"] and out[2]["recommended"] and not out[2]["nearby"] and 300 < out[2]["distance"] < 500
    unknown = routes.similar_runs(runs.filter("signal_id <> 'tokyo'"), extents, cat, "tokyo").collect()
    assert len(unknown) == 3 and {r["distance"] for r in unknown} == {None}


def test_timeline_scales(spark):
    def seconds(values, dtype):
        df = spark.createDataFrame([("r", i, v) for i, v in enumerate(values)], f"run string, row_pos bigint, t {dtype}")
        return [r["seconds"] for r in course.timeline(df, "t").orderBy("row_pos").collect()]

    assert seconds([5.0, 6.0, 8.0], "double") == [0.0, 1.0, 3.0]
    assert seconds([0.0, 2000.0, 4000.0], "double") == [0.0, 2.0, 4.0]
    assert seconds([2e11, 2e11 + 500, 2e11 + 900], "double") == [0.0, 0.5, 0.9]
    assert seconds(["a", "b", "c"], "string") == [0.0, 1.0, 2.0]


def reference_axis(x, y, t, v):
    """Row-by-row rules of gap filling on plain lists, as the brute-force check."""
    ok = [a is not None and b is not None for a, b in zip(x, y)]
    last = None
    for i in range(len(x)):
        if not ok[i]:
            continue
        if last is not None and x[i] == x[last] and y[i] == y[last] and v[i] > 0.5:
            ok[i] = False
        else:
            last = i
    good = [i for i, k in enumerate(ok) if k]
    fx, fy = list(x), list(y)
    for i in range(len(x)):
        if ok[i]:
            continue
        a, b = max((g for g in good if g < i), default=None), min((g for g in good if g > i), default=None)
        if a is None or b is None:
            fx[i], fy[i] = (x[b], y[b]) if a is None else (x[a], y[a])
            continue
        w = [max(0.0, (v[j - 1] + v[j]) / 2) * (t[j] - t[j - 1]) or (t[j] - t[j - 1]) for j in range(a + 1, b + 1)]
        f = sum(w[:i - a]) / sum(w)
        fx[i], fy[i] = x[a] + (x[b] - x[a]) * f, y[a] + (y[b] - y[a]) * f
    steps = [0.0] + [math.hypot(fx[i] - fx[i - 1], fy[i] - fy[i - 1]) for i in range(1, len(fx))]
    total = np.cumsum(steps)
    return [not k for k in ok], fx, fy, total / total[-1]


@pytest.mark.parametrize("bounds", [False, True])
def test_course_axis_against_brute_force(spark, bounds, request):
    if bounds:
        request.getfixturevalue("tiny_bounds")
    rng = np.random.default_rng(11)
    n = 40
    x = [None, *map(float, range(0, 10)), *[9.0] * 6, None, None, *map(float, range(18, n))][:n]
    y = [2.0 * a if a is not None else None for a in x]
    v = [float(s) for s in rng.integers(0, 4, n)]
    t = [float(s) for s in np.cumsum(rng.integers(1, 4, n))]
    df = spark.createDataFrame([("r", i, *r) for i, r in enumerate(zip(x, y, t, v))],
                               "run string, row_pos bigint, x double, y double, seconds double, v double")
    out = course.course_axis(df, "x", "y", speed="v", geographic=False).orderBy("row_pos").collect()
    bad, fx, fy, progress = reference_axis(x, y, t, v)
    assert [r["estimated"] for r in out] == bad and out[0]["estimated_count"] == sum(bad) and out[0]["usable"]
    assert np.allclose([r["filled_x"] for r in out], fx) and np.allclose([r["filled_y"] for r in out], fy)
    assert np.allclose([r["progress"] for r in out], progress)


def test_course_axis_rejects_zero_and_out_of_range(spark):
    spots = [(139.0, 35.0), (0.0, 0.0), (139.2, 35.0), (500.0, 35.0), (139.4, 35.0)]
    df = spark.createDataFrame([("r", i, float(i), *s) for i, s in enumerate(spots)], "run string, row_pos bigint, seconds double, x double, y double")
    out = course.course_axis(df, "x", "y").orderBy("row_pos").collect()
    assert [r["estimated"] for r in out] == [False, True, False, True, False]
    assert np.allclose([r["filled_x"] for r in out], [139.0, 139.1, 139.2, 139.3, 139.4])
    none = course.course_axis(df.withColumn("x", F.lit(None).cast("double")), "x", "y").orderBy("row_pos").collect()
    assert [r["progress"] for r in none] == [0.0, 0.25, 0.5, 0.75, 1.0] and not none[0]["usable"]


def test_course_matching_is_monotone(spark):
    def run(points):
        return spark.createDataFrame([("p", i, float(x), 0.0, i / (len(points) - 1)) for i, x in enumerate(points)],
                                     "pair string, row_pos bigint, filled_x double, filled_y double, progress double")

    there_and_back = [*range(0, 50), *range(50, -1, -1)]
    out = course.match_course(run(there_and_back), run(there_and_back[::2]), geographic=False).orderBy("row_pos").collect()
    got = [r["progress"] for r in out]
    assert got == sorted(got) and np.allclose(got, [i / 100 for i in range(0, 101, 2)])


def _plain_match(course_rows, run_rows, geographic):
    """Every row sought in turn, from the place before it."""
    ahead = max(40, math.ceil(max(1.0, len(course_rows) / len(run_rows)) * 30))
    at, out = 0, []
    for i, (x, y, _) in enumerate(run_rows):
        stop = len(course_rows) if i == 0 else min(len(course_rows), at + ahead + 1)
        scale = math.cos(math.radians(y)) if geographic else 1.0
        at = min(range(at, stop), key=lambda j: (((course_rows[j][0] - x) * scale) ** 2 + (course_rows[j][1] - y) ** 2, j))
        out.append(course_rows[at][2])
    return out


@pytest.mark.parametrize("geographic", [False, True])
@pytest.mark.parametrize("bounds", [None, "batches", "chunks"])
def test_runs_of_any_length_are_matched_row_by_row(spark, bounds, geographic, request):
    if bounds == "chunks":
        request.getfixturevalue("tiny_bounds")
    rng = np.random.default_rng(8)

    def run(n, slow=1.0):
        at = np.sort(rng.random(n)) ** slow
        return [(float(139 + math.sin(6 * a) + rng.normal(0, 1e-3)), float(35 + a), float(a)) for a in at]

    way = [100 - abs(i - 100) for i in range(201)]
    pairs = {"even": (run(900), run(700)), "late": (run(60, 0.2), run(1_500)), "early": (run(2_000, 5.0), run(50)), "one": (run(1), run(3)),
             "turn": ([(float(x), 0.0, i / 200) for i, x in enumerate(way)], [(100 - abs(i / 5 - 100), 0.0, 0.5) for i in range(1_001)]),
             None: (run(30), run(30)), "alone": ([], run(5)), "unmet": (run(5), [])}

    def frame(side):
        data = [(p, 10 * i, *v) for p, both in pairs.items() for i, v in enumerate(both[side])]
        return spark.createDataFrame(data, "pair string, row_pos int, filled_x double, filled_y double, progress double").repartition(3)

    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        if bounds == "batches":
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        found = course.match_course(frame(0), frame(1), geographic=geographic).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    for p, (course_rows, run_rows) in pairs.items():
        got = [r["progress"] for r in sorted((r for r in found if r["pair"] == p), key=lambda r: r["row_pos"])]
        assert got == (_plain_match(course_rows, run_rows, geographic) if course_rows and run_rows else [v[2] for v in run_rows])


def test_the_query_matches_runs_above_the_bound(spark, monkeypatch):
    drive = spark.range(51_000).selectExpr("explode(array('u2', 'u3')) AS run", "id AS row_pos", "id").selectExpr(
        "run", "row_pos", "timestamp_seconds(id) AS ts", "1.0D AS speed", "139 + id / 1e5D AS x", "35.0D AS y")
    monkeypatch.setattr(drives, "_course_rows", lambda *_: drive)
    out = drives.matched_course(spark, "").orderBy("row_pos").toPandas()
    assert len(out) == 51_000 and np.allclose(out["progress"], np.arange(51_000) / 50_999, atol=1e-4)


def brute_offset(t, ya, shift):
    """Every lag of the two resampled runs, summed with plain loops."""
    dt = (t[-1] - t[0]) / 600
    grid = t[0] + dt * np.arange(601)
    a = np.interp(grid, t, ya)
    b = a.copy()
    busy = np.flatnonzero(b >= b.min() + 0.1 * (b.max() - b.min()))
    part = b[busy[0]:busy[-1] + 1]
    a, part = a - a.mean(), part - part.mean()
    need, best = max(8, int(len(part) * 0.85)), (-9.0, 0)
    for lag in range(-(len(part) - need), len(a) - need + 1):
        both = [(a[m + lag], part[m]) for m in range(len(part)) if 0 <= m + lag < len(a)]
        if len(both) >= need:
            x, y = np.array(both).T
            best = max(best, (float((x * y).sum() / np.sqrt((x * x).sum() * (y * y).sum())), -lag))
    return t[0] - (t[0] - shift + busy[0] * dt) - best[1] * dt, best[0]


@pytest.mark.parametrize("shift", [12.5, -7.0])
def test_offset_of_a_shifted_run(spark, shift):
    t = np.arange(0, 300, 0.5)
    y = np.exp(-((t - 120) / 15) ** 2) * 50 + np.exp(-((t - 180) / 8) ** 2) * 80
    a = spark.createDataFrame([(1, i, float(a), float(b)) for i, (a, b) in enumerate(zip(t, y))], "pair int, row_pos bigint, t double, y double")
    b = a.withColumn("t", F.col("t") - shift)
    got = overlay.best_offset(a, b).first()
    offset, score = brute_offset(t, y, shift)
    assert abs(got["offset"] - shift) <= 0.5 and not got["weak"]
    assert abs(got["offset"] - offset) < 2e-3 and math.isclose(got["score"], score, rel_tol=1e-6)
    assert overlay.best_offset(a, b.filter("row_pos < 3")).count() == 0
    assert overlay.offset_signal(["gear", "engine_rpm"]) == "engine_rpm" and overlay.offset_signal(["x", "y"]) == "x"


def test_overlay_uses_aliases_and_drops_unknown_filters(drive_a, drive_b):
    b = drive_b.withColumnsRenamed({"speed": "v_kmh", "rpm": "engine"})
    aliases = [("velocity", "speed"), ("velocity", "v_kmh")]
    only = [{"column": "speed", "op": "ge", "value": 10}, {"column": "rpm", "op": "ge", "value": 0}]
    out = overlay.overlay_runs(drive_a, b, "time", ["speed"], only, aliases, offset=100.0)
    assert rows(out.filter("run = 'b'"), "time", "speed") == sorted([(100.0 + i, 5 * i) for i in range(2, 6)], key=repr)
    assert overlay.overlay_runs(drive_a, b.drop("v_kmh"), "time", ["speed"], None, aliases).filter("run = 'b'").count() == 0


def test_spectrum_peaks(spark, ab_members):
    t = np.arange(1000) / 100
    data = [(k, i, float(s), float(np.sin(2 * np.pi * f * s))) for k, f in (("a", 6.0), ("b", 2.0)) for i, s in enumerate(t)]
    df = spark.createDataFrame(data, "dataset_id string, row_pos bigint, time double, accel double")
    out = spectrum.cohort_spectrum(df, ab_members, "accel", "time")
    peak = {c: max(out.filter(f"cohort = '{c}'").collect(), key=lambda r: r["psd"]) for c in "AB"}
    assert abs(peak["A"]["freq"] - 6) < 1 and abs(peak["B"]["freq"] - 2) < 1
    assert peak["A"]["band_power"] > peak["B"]["band_power"] and peak["A"]["band_ratio"] > 0.9
    short = spectrum.welch(df.filter("row_pos < 31"), "accel", "time")
    assert short.count() == 0


def test_welch_equals_a_plain_average_of_segments(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=2600)
    df = spark.createDataFrame([("a", i, i * 0.01, float(x)) for i, x in enumerate(v)], "dataset_id string, row_pos bigint, time double, v double")
    got = spectrum.welch(df, "v", "time").first()
    taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(1024) / 1024)
    parts = []
    for at in range(0, 2600 - 1024 + 1, 512):
        s = v[at:at + 1024]
        p = np.abs(np.fft.rfft((s - s.mean()) * taper)) ** 2 / (got["rate"] * (taper ** 2).sum())
        p[1:-1] *= 2
        parts.append(p)
    assert math.isclose(got["rate"], 100.0, rel_tol=1e-9) and np.allclose(got["density"], np.mean(parts, axis=0))


def test_the_spectra_query_keeps_long_recordings(spark, monkeypatch):
    rng = np.random.default_rng(5)
    logs = {f"u{n}": rng.normal(size=n) for n in (31, 45, 1_023, 1_024, 2_600)}
    df = spark.createDataFrame([(k, i, float(x)) for k, v in logs.items() for i, x in enumerate(v)], "dataset_id string, row_pos bigint, value double")
    monkeypatch.setattr(cohort_reports.tables, "events", lambda *_: df)
    out = cohort_reports.recording_spectra(spark, "").toPandas()
    assert set(out["dataset_id"]) == {"u45", "u1023", "u1024", "u2600"}
    for key, mine in out.groupby("dataset_id"):
        v, mine = logs[key], mine.sort_values("bin")
        n = min(len(v), 1_024)
        taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
        waves = np.exp(-2j * np.pi * np.outer(np.arange(n // 2 + 1), np.arange(n)) / n)
        parts = []
        for at in range(0, len(v) - n + 1, n - n // 2):
            s = v[at:at + n]
            p = np.abs(waves @ ((s - s.mean()) * taper)) ** 2 / (taper ** 2).sum()
            p[1:(n + 1) // 2] *= 2
            parts.append(p)
        assert mine["bin"].tolist() == list(range(n // 2 + 1)) and np.allclose(mine["freq"], np.arange(n // 2 + 1) / n, atol=1e-6)
        assert np.allclose(mine["density"], np.mean(parts, axis=0), atol=0.0051)


def test_clusters(log):
    df = log("a", "speed double, rpm double", [(1.0, 100.0), (1.1, 101.0), (0.9, 99.0), (1.0, 100.5), (9.0, 900.0), (9.1, 905.0), (None, 1.0)])
    out = models.cluster_rows(df, ["speed", "rpm"], 2)
    assert out.columns[-1] == "cluster" and dict(out.dtypes)["cluster"] == "bigint" and out.count() == 7
    assert rows(out.filter("speed < 2"), "cluster") == [(0,)] * 4 and rows(out.filter("speed > 2"), "cluster") == [(1,)] * 2
    assert out.filter("speed is null").first()["cluster"] is None
    profile = {r["cluster"]: r for r in models.cluster_profile(out, ["speed", "rpm"]).collect()}
    assert (profile[0]["count"], profile[0]["speed"], profile[0]["percent"]) == (4, 1.0, 66.67)
    again = models.cluster_rows(out, ["speed"], 2)
    assert again.columns == out.columns
    for bad in ({"features": []}, {"features": ["speed"], "k": 1}, {"features": ["speed"], "k": 7}, {"features": ["speed"], "column_name": "a;b"}):
        with pytest.raises(RequestError):
            models.cluster_rows(df, **{"k": 2, **bad})


def test_components(spark, log, ab_members):
    rng = np.random.default_rng(4)
    base = rng.normal(size=60)
    part = [log(k, "x double, y double, z double", [(float(b), float(2 * b + e), float(-b)) for b, e in zip(base, rng.normal(0, .1, 60))]) for k in "ab"]
    points, loadings = models.cohort_pca(part[0].unionByName(part[1]), ab_members, ["x", "y", "z"])
    assert points.count() == 120
    got = loadings.collect()
    explained = {r["component"]: r["explained"] for r in got}
    assert explained[1] > 0.9 and sum(explained.values()) <= 1.0 + 1e-9
    for c in (1, 2):
        assert max((r["loading"] for r in got if r["component"] == c), key=abs) > 0
    with pytest.raises(RequestError):
        models.cohort_pca(part[0], ab_members, ["x"])
