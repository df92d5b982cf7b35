"""Bulk ingest: dialects, headers, types, positions, one catalog file, and scans of own folders only."""

from __future__ import annotations

import datetime

import pandas as pd
import pytest

from conftest import rows
from odolake.errors import RequestError
from odolake.sources.bulk import BOM, dialect_of, read_csv_files
from odolake.sources.store import RecordingStore


@pytest.fixture
def store(spark, tmp_path):
    return RecordingStore(spark, str(tmp_path / "store"))


def test_a_folder_of_mixed_logs_is_stored_in_one_go(spark, store, tmp_path):
    logs = tmp_path / "logs"
    (logs / "sub dir").mkdir(parents=True)
    files = {
        "comma.csv": "time,speed,name\n1,2.5,a\n2,,\"b,c\"\n",
        "semi colon.csv": "time;speed;name\n1;2,5;a\n2;3,5;b\n",
        "tabs.csv": "time\tspeed\n2024-01-05 10:00:00\t1\n2024-01-05 10:00:01\t2\n",
        "sub dir/plain.csv": "1,2.5\n3,4.5\n\n5,6.5\n",
        "sub dir/mark.csv": f"{BOM}time,speed,name\n7,8.5,z\n",
        "sub dir/mark plain.csv": f"{BOM}1,2.5\n3,x\n",
        "flags.csv": "day,on\n2024-01-05,true\n,false\n",
        "only header.csv": "time,speed,name\n",
        "ignored.txt": "a,b\n",
    }
    for name, text in files.items():
        (logs / name).write_text(text, encoding="utf-8")
    pd.DataFrame({"time": [1, 2, 3], "rpm": [800.0, None, 900.0]}).to_parquet(logs / "rec.parquet")
    ids = {p.rsplit("/", 1)[1]: i for p, i in store.ingest_many(str(logs), tags=[" t ", "t"]).items()}
    assert set(ids) == {n.rsplit("/", 1)[-1] for n in files if not n.endswith(".txt")} | {"rec.parquet"}
    catalog = {r["dataset_id"]: r for r in store.catalog().collect()}
    assert len(catalog) == 9 and all(r["tags"] == ["t"] for r in catalog.values())
    assert catalog[ids["semi colon.csv"]]["name"] == "semi colon" and catalog[ids["only header.csv"]]["row_count"] == 0
    assert catalog[ids["comma.csv"]]["file_size"] == len(files["comma.csv"])

    def stored(name):
        df = store.dataset(ids[name]).drop("dataset_id")
        return [c for c, _ in df.dtypes[1:]], [t for _, t in df.dtypes[1:]], sorted(tuple(r) for r in df.collect())

    assert stored("comma.csv") == (["time", "speed", "name"], ["bigint", "double", "string"], [(0, 1, 2.5, "a"), (1, 2, None, "b,c")])
    assert stored("semi colon.csv") == (["time", "speed", "name"], ["bigint", "string", "string"], [(0, 1, "2,5", "a"), (1, 2, "3,5", "b")])
    assert stored("tabs.csv")[1:] == (["timestamp", "bigint"], [(0, datetime.datetime(2024, 1, 5, 10), 1), (1, datetime.datetime(2024, 1, 5, 10, 0, 1), 2)])
    assert stored("plain.csv") == (["column0", "column1"], ["bigint", "double"], [(0, 1, 2.5), (1, 3, 4.5), (2, 5, 6.5)])
    assert stored("mark.csv") == (["time", "speed", "name"], ["bigint", "double", "string"], [(0, 7, 8.5, "z")])
    assert stored("mark plain.csv") == (["column0", "column1"], ["bigint", "string"], [(0, 1, "2.5"), (1, 3, "x")])
    assert stored("flags.csv")[1:] == (["date", "boolean"], [(0, datetime.date(2024, 1, 5), True), (1, None, False)])
    assert stored("rec.parquet")[1:] == (["bigint", "double"], [(0, 1, 800.0), (1, 2, None), (2, 3, 900.0)])
    assert stored("only header.csv")[2] == []
    changes = [p.name for p in (tmp_path / "store" / "catalog").glob("*.parquet")]
    assert len(changes) == 1  # all recordings became known at once


def test_rows_keep_their_places_over_many_blocks(spark, store, tmp_path):
    for name, n in (("a.csv", 3_000), ("b.csv", 5), ("c.csv", 4_000)):
        (tmp_path / name).write_text("i,v\n" + "".join(f"{i},{'x' if name == 'c.csv' and i == 9 else i * 2}\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        ids = store.ingest_many([str(tmp_path / f"{x}.csv") for x in "abc"])
        found = store.load(list(ids.values()))
        assert found.filter("row_pos != i").count() == 0 and found.count() == 7_005
        texts = read_csv_files(spark, [str(tmp_path / "a.csv")])
        assert next(texts).rows.rdd.getNumPartitions() > 3
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_nothing_is_stored_after_an_error(spark, store, tmp_path):
    (tmp_path / "good.csv").write_text("a,b\n1,2\n")
    (tmp_path / "void.csv").write_text("\n \n")
    with pytest.raises(RequestError, match="no rows"):
        store.ingest_many([str(tmp_path / "good.csv"), str(tmp_path / "void.csv")])
    with pytest.raises(RequestError, match="cannot read"):
        store.ingest_many([str(tmp_path / "good.csv"), str(tmp_path / "absent.csv")])
    assert store.catalog().count() == 0 and not list((tmp_path / "store").rglob("*.parquet"))


def test_a_cohort_lists_only_its_own_folders(spark, store, tmp_path):
    for i in range(40):
        (tmp_path / f"r{i}.csv").write_text(f"a,b\n{i},2\n")
    ids = store.ingest_many([str(tmp_path / f"r{i}.csv") for i in range(40)])
    chosen = sorted(ids.values())[:3]
    by_frame = store.load(spark.createDataFrame([(i,) for i in chosen], "dataset_id string"), ["a"])
    for df in (store.load(chosen, ["a"]), by_frame):
        assert {f.split("dataset_id=")[1].split("/")[0] for f in df.inputFiles()} == set(chosen) and df.count() == 3
    assert rows(store.load(None, ["b"]).groupBy("b").count(), "count") == [(40,)]


@pytest.mark.parametrize(("line", "ranges", "expected"), [
    ("a;b,c", {",": (0, 3), ";": (1, 1), "\t": (0, 0), "|": (0, 0)}, (";", True, ("a", "b,c"))),
    ("a|b|a", {",": (0, 0), ";": (0, 0), "\t": (0, 0), "|": (2, 3)}, ("|", True, ("a", "b", "a_1"))),
    ("one", {",": (0, 0), ";": (0, 0), "\t": (0, 0), "|": (0, 0)}, (",", True, ("one",))),
    ("x,,z", {",": (2, 2), ";": (0, 0), "\t": (0, 0), "|": (0, 0)}, (",", False, ("column0", "column1", "column2"))),
    ("2024-01-05,x", {",": (1, 1), ";": (0, 0), "\t": (0, 0), "|": (0, 0)}, (",", False, ("column0", "column1"))),
])
def test_dialects(line, ranges, expected):
    d = dialect_of(line, ranges)
    assert (d.separator, d.header, d.names) == expected
