from __future__ import annotations

import pytest
from conftest import rows
from pyspark.sql import functions as F

from odolake import RequestError
from odolake.workspace import Workspace

CSV_A = "time,speed,rpm,mode\n" + "".join(f"{i},{10 * i},{800 + 200 * i},{'drive' if i else 'idle'}\n" for i in range(6))
CSV_B = "time,speed,rpm,mode\n" + "".join(f"{i},{5 * i},{700 + 100 * i},{'drive' if i else 'idle'}\n" for i in range(6))
CSV_GPS = "latitude,longitude\n" + "".join(f"{35 + i / 100},{139 + i / 100}\n" for i in range(6))


@pytest.fixture(scope="module")
def ws(spark, tmp_path_factory):
    return Workspace(spark, str(tmp_path_factory.mktemp("store")))


@pytest.fixture(scope="module")
def ids(ws, tmp_path_factory):
    folder = tmp_path_factory.mktemp("files")

    def ingest(name, text, tags):
        path = folder / name
        path.write_text(text)
        return ws.store.ingest(str(path), tags=tags)

    return {"a": ingest("drive_a.csv", CSV_A, ["maker", " maker ", ""]), "b": ingest("drive_b.csv", CSV_B, ["other"]),
            "g": ingest("drive_a_GPS.csv", CSV_GPS, [])}


def test_ingest_types_positions_and_catalog(ws, ids, spark, tmp_path):
    row = ws.store.get(ids["a"])
    assert (row["name"], row["row_count"], row["column_count"], row["tags"]) == ("drive_a", 6, 4, ["maker"])
    assert row["file_size"] == len(CSV_A)
    assert rows(ws.schema(ids["a"]), "name", "type") == [("mode", "string"), ("rpm", "bigint"), ("speed", "bigint"), ("time", "bigint")]
    assert rows(ws.store.dataset(ids["a"]), "row_pos", "speed") == [(i, 10 * i) for i in range(6)]
    path = str(tmp_path / "p.parquet")
    spark.range(10).select((F.col("id") * 2).alias("v")).repartition(1).sortWithinPartitions("v").write.parquet(path)
    other = ws.store.ingest(path)
    assert rows(ws.store.dataset(other), "row_pos", "v") == [(i, 2 * i) for i in range(10)]
    assert ws.store.delete([other]) == 1
    with pytest.raises(RequestError):
        ws.store.get(other)
    with pytest.raises(RequestError):
        ws.store.ingest(str(tmp_path / "x.txt"))


def test_requests_about_one_recording(ws, ids):
    a = ids["a"]
    assert ws.preview(a, 3).columns == ["time", "speed", "rpm", "mode"] and ws.preview(a, 3).count() == 3
    assert ws.timeseries(a, "time", ["speed"], [{"column": "rpm", "op": "gt", "value": 900}]).count() == 5
    assert rows(ws.histogram(a, "mode"), "label", "count") == [("drive", 5), ("idle", 1)]
    assert ws.histogram(a, "speed", 5).agg(F.sum("count")).first()[0] == 6
    assert ws.correlation(a, ["speed", "rpm"]).filter("a <> b").first()["r"] == 1.0
    assert ws.scatter(a, "rpm", "speed", "mode").count() == 6 and ws.summary(a).count() == 4
    for kind in ("bar", "box", "histogram", "heatmap", "scatter", "line"):
        x = "mode" if kind in ("bar", "box") else "speed"
        assert ws.chart(a, kind, x, "rpm").count() > 0
    assert ws.chart_stats(a, "mode", "speed").first()["avg"] == 25.0
    with pytest.raises(RequestError):
        ws.timeseries(a, "time", ["nothing"])
    with pytest.raises(RequestError):
        ws.chart(a, "pie", "speed")


def test_requests_about_several_recordings(ws, ids):
    two = [ids["a"], ids["b"]]
    assert rows(ws.compare_summary(two, "speed"), "avg") == [(12.5,), (25.0,)]
    assert ws.compare_diff(two).count() == 3
    assert ws.common_columns(two, numeric_only=True) == ["time", "speed", "rpm"]
    assert ws.chart_groups({"x": two, "y": [ids["a"]]}, "bar", "mode", "speed").count() == 4
    with pytest.raises(RequestError):
        ws.compare_summary([ids["a"]], "speed")
    with pytest.raises(RequestError):
        ws.compare_summary([ids["a"], ids["g"]], "speed")


def test_cohort_requests(ws, ids):
    specs = [{"name": "A", "tags": ["maker"]}, {"name": "B", "tags": ["other"]}]
    assert rows(ws.resolve_cohorts(specs), "cohort", "dataset_count", "row_count") == [("A", 1, 6), ("B", 1, 6)]
    assert rows(ws.cohort_summary(specs, ["speed"]), "cohort", "mean") == [("A", 25.0), ("B", 12.5)]
    assert ws.cohort_histogram(specs, "speed", 5).count() == 10
    assert ws.cohort_transitions(specs, "mode", "time").count() == 2
    assert ws.cohort_overlaps(specs).count() == 0
    assert ws.cohort_correlation(specs).filter("a <> b").count() == 12
    with pytest.raises(RequestError):
        ws.cohort_members([{"name": "A", "tags": ["nobody"]}])


def test_track_from_the_paired_log(ws, ids):
    assert rows(ws.gps_pairs(), "signal_id", "gps_id", "match") == [(ids["a"], ids["g"], "name")]
    out, roles = ws.map_track(ids["a"], ["speed"])
    assert rows(out, "speed", "latitude") == sorted([(10 * i, 35 + i / 100) for i in range(6)], key=repr) and roles["mode"] == "geographic"
    done = ws.course(ids["a"], ["speed"]).orderBy("row_pos").collect()
    assert done[0]["progress"] == 0.0 and done[-1]["progress"] == 1.0
    assert ws.gps_datasets().count() == 1
    assert ws.match_courses(ids["a"], ids["a"]).count() == 6
    with pytest.raises(RequestError):
        ws.map_track(ids["b"])


def test_stitch_tags_labels_aliases_and_write_back(ws, ids):
    both = ws.store.stitch([ids["a"], ids["b"]])
    row = ws.store.get(both)
    assert row["row_count"] == 12 and row["tags"] == ["maker", "other"] and row["name"] == "joined_drive_a+drive_b"
    ws.store.bulk_update_tags([both], add=["new"], remove=["maker"])
    assert ws.store.get(both)["tags"] == ["other", "new"]
    ws.store.update_tags(both, ["only", "only"])
    assert ws.store.get(both)["tags"] == ["only"]
    assert rows(ws.store.all_tags(), "tag") == [("maker",), ("only",), ("other",)]
    assert ws.store.with_any_tag(["only"]).count() == 1
    assert ws.cluster(both, ["speed", "rpm"], 2).agg(F.sum("count")).first()[0] == 12
    assert ws.store.dataset(both).columns[-1] == "cluster" and ws.store.get(both)["column_count"] == 5
    assert ws.cluster(both, ["speed"], 3).count() == 3
    ws.store.delete([both])
    label_set = ws.store.create_label_set("mine", ["speed", "torque"])
    assert rows(ws.store.label_sets(), "id", "name", "columns") == [(label_set, "mine", ["speed", "torque"])]
    alias = ws.store.create_alias(" velocity ", "speed")
    assert ws.store.create_alias("velocity", "speed") == alias and ws.store.alias_pairs() == [("velocity", "speed")]
    assert ws.overlay(ids["a"], ids["b"], "time", ["speed"]).count() == 12
    assert ws.best_offset(ids["a"], ids["b"], "time", ["speed"]).count() <= 1
    ws.store.delete_alias(alias)
    ws.store.delete_label_set(label_set)
    assert ws.store.aliases().count() == 0 and ws.store.label_sets().count() == 0


def test_similar_runs_and_delete_all(ws, ids):
    assert ws.similar_runs(ids["a"]).count() == 0
    assert ws.store.delete_all(include_label_sets=True) == 3
    assert ws.store.list_datasets().count() == 0


def test_shared_tables(spark, tmp_path, monkeypatch):
    from odolake import session

    df = session.materialize(spark.range(5))
    assert df.count() == 5 and session.release_tables(spark) >= 1 and session.release_tables(spark) == 0
    monkeypatch.setattr(session, "CHECKPOINT_CONF", "spark.odolake.unset")
    assert session.shared_dir(spark) == session.shared_dir(spark) != ""


def test_task_functions_need_no_package_on_executors(spark):
    """What a task runs is pickled by value: an interpreter without this package can load it."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    from odolake.operators import compare, course, overlay, spectrum, stat_tests

    functions = [course._match_rows(True), overlay._fit_batches, stat_tests._resample, stat_tests.welch_p.func,
                 stat_tests.rank_sum_p.func, compare.ks_of_quantiles.func, spectrum.segment_power.func, spectrum.on_grid.func]
    load = "import sys, pickle; pickle.loads(sys.stdin.buffer.read()); assert not any(m.startswith('odolake') for m in sys.modules)"
    subprocess.run([sys.executable, "-I", "-c", load], input=cloudpickle.dumps(functions), cwd="/", check=True)
