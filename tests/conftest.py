from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from odolake import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "odolake-tests", "local[4]", 3,  # tiny inputs: compiling each plan would take most of the time
        {"spark.ui.showConsoleProgress": "false", "spark.sql.codegen.wholeStage": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def log(spark):
    """Builder of a recording frame: log(dataset_id, 'time bigint, speed bigint', rows)."""

    def build(dataset_id, schema, rows):
        data = [(dataset_id, i, *r) for i, r in enumerate(rows)]
        return spark.createDataFrame(data, f"dataset_id string, row_pos bigint, {schema}")

    return build


@pytest.fixture(scope="session")
def drive_a(log):
    return log("a", "time bigint, speed bigint, rpm bigint, mode string",
               [(i, 10 * i, 800 + 200 * i, "idle" if i == 0 else "drive") for i in range(6)])


@pytest.fixture(scope="session")
def drive_b(log):
    return log("b", "time bigint, speed bigint, rpm bigint, mode string",
               [(i, 5 * i, 700 + 100 * i, "idle" if i == 0 else "drive") for i in range(6)])


@pytest.fixture(scope="session")
def two_drives(drive_a, drive_b):
    return drive_a.unionByName(drive_b)


@pytest.fixture(scope="session")
def gears(log):
    schema = "time bigint, speed bigint, rpm bigint, gear bigint"
    a = log("a", schema, [(i, 10 * i, 800 + 200 * i, g) for i, g in enumerate((1, 1, 2, 2, 3, 3))])
    b = log("b", schema, [(i, 5 * i, 700 + 100 * i, g) for i, g in enumerate((1, 2, 1, 2, 3, 3))])
    return a.unionByName(b)


@pytest.fixture(scope="session")
def ab_members(spark):
    return spark.createDataFrame([("A", 0, "a"), ("B", 1, "b")], "cohort string, position int, dataset_id string")


@pytest.fixture
def tiny_bounds(spark):
    """Force the ways for large groups: range chunks, ranked quantiles, joins without broadcast."""
    keys = {"spark.odolake.maxGroupRows": "3", "spark.odolake.maxGroupDistinct": "2", "spark.odolake.maxBroadcastRows": "0",
            "spark.odolake.maxSortedValues": "0"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k in keys:
        spark.conf.unset(k)


def rows(df, *columns):
    """Rows as sorted tuples of the columns."""
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
