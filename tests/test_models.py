"""K-means: bounded starts, centres of all rows, labels and profiles."""

from __future__ import annotations

import random

import numpy as np
import pytest

from conftest import rows
from odolake.operators import models


@pytest.fixture(scope="module")
def blobs(spark):
    rng = random.Random(4)
    means = [(0, 0), (10, 0), (0, 10)]
    data = [(i, means[i % 3 if i % 7 else 0][0] + rng.gauss(0, 0.5), means[i % 3 if i % 7 else 0][1] + rng.gauss(0, 0.5)) for i in range(600)]
    return spark.createDataFrame(data + [(1000, None, 1.0), (1001, float("nan"), 2.0)], "id long, x double, y double").repartition(4), data


def test_clusters_are_the_known_groups_largest_first(blobs):
    df, data = blobs
    got = {r["id"]: r["cluster"] for r in models.cluster_rows(df, ["x", "y"], 3).collect()}
    group = {i: (0 if y < 5 else 2) if x < 5 else 1 for i, x, y in data}
    sizes = sorted({g: sum(v == g for v in group.values()) for g in group.values()}.items(), key=lambda x: -x[1])
    rank = {g: i for i, (g, _) in enumerate(sizes)}
    assert sizes[1][1] == sizes[2][1] or all(got[i] == rank[g] for i, g in group.items())
    assert len({(got[i], g) for i, g in group.items()}) == 3
    assert got[1000] is None and got[1001] is None


@pytest.mark.parametrize("points", [30, 10_000])
def test_centres_stand_still_over_all_rows_whatever_the_draw(blobs, monkeypatch, points):
    monkeypatch.setattr(models, "START_POINTS", points)
    df, data = blobs
    centres, scale = models.fit_clusters(models._complete(df, ["x", "y"]), ["x", "y"], 3)
    z = np.array([[(v - s["mean"]) / s["std"] for v, s in zip(d[1:], scale)] for d in data])
    nearest = ((z[:, None, :] - np.array(centres)) ** 2).sum(axis=2).argmin(axis=1)
    means = np.array([z[nearest == c].mean(axis=0) for c in range(3)])
    assert np.abs(means - centres).max() < 1e-3


def test_a_hot_point_reaches_the_driver_once(spark, monkeypatch):
    monkeypatch.setattr(models, "START_POINTS", 5)
    df = spark.createDataFrame([(1.0,)] * 500 + [(float(i),) for i in range(2, 40)], "z_0 double")
    points, weights = models._start_points(df, ["z_0"])
    assert len(points) < 40 and len({tuple(p) for p in points}) == len(points) and weights.sum() <= 538


def test_fewer_different_points_than_clusters_leave_empty_ones_in_the_profile(spark):
    df = spark.createDataFrame([(1.0, 2.0)] * 5 + [(3.0, 4.0)] * 4, "x double, y double")
    labelled = models.cluster_rows(df, ["x", "y"], 4)
    found = rows(models.cluster_profile(labelled, ["x", "y"], k=4), "cluster", "count", "percent", "x")
    assert found == [(0, 5, 55.56, 1.0), (1, 4, 44.44, 3.0), (2, 0, 0.0, None), (3, 0, 0.0, None)]
    assert models.cluster_profile(labelled, ["x", "y"]).count() == 2
