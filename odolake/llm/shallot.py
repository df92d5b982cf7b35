"""Exact k-means of integer vectors: Shallot search with bounds kept between the rounds.

Every vector keeps its centroid, the one that was second nearest, an upper bound of its distance to the first and a lower bound
of the distance to all others. A round first moves the bounds by the shifts of the centroids; a vector whose upper bound is
below its lower bound, or below half the way to the next centroid, stays. The others measure both remembered centroids,
and scan the neighbours of the closer one in the order of their distance from it. The ball that can hold one of the two
nearest has the radius d(closer) + d(second best so far), so it shrinks during the scan. What is inside is compared by
exact integer distances, ties going to the smaller number.

Vectors travel as blocks of rows, one row of a table per block, with their state. A round reads the blocks of the round
before, writes new ones and adds up one row of sums per task; the blocks before are then deleted. Only centroids, k times the
components, reach the driver.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir
from .tables import column, delete

COMPONENTS = 64
CLUSTERS = 40
ROUNDS = 5
SCALE = 256
LARGEST = 1 << 26  # of a component after scaling, so that squared distances of vectors of 64 to 1,024 components fit 63 bits
_SLACK = 1e-9  # bounds are doubles: they are widened by this share at each step
_STATE = "ids binary, width int, vectors binary, nearest binary, second binary, upper binary, lower binary, sums array<bigint>"
_FIELDS = [f.split()[0] for f in _STATE.split(", ")]


def squared(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Row by row squared distances, exact."""
    gap = vectors.astype(np.int64) - centroids
    return np.einsum("ij,ij->i", gap, gap)


def neighbours(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every centroid the others by distance, and these distances, never too large."""
    gaps = np.stack([squared(centroids, c[None, :]) for c in centroids])
    np.fill_diagonal(gaps, -1)
    order = np.argsort(gaps, axis=1, kind="stable")[:, 1:]
    return order, np.sqrt(np.take_along_axis(gaps, order, axis=1).astype(float)) * (1 - _SLACK)


def assign(vectors: np.ndarray, centroids: np.ndarray, near: tuple[np.ndarray, np.ndarray], nearest: np.ndarray, second: np.ndarray,
           upper: np.ndarray, lower: np.ndarray) -> int:
    """Bring the state to the nearest centroids, in place. Returns how many distances were computed."""
    order, gaps = near
    if len(centroids) == 1:
        nearest[:], second[:], upper[:], lower[:] = 0, 0, np.sqrt(squared(vectors, centroids[nearest]).astype(float)) * (1 + _SLACK), np.inf
        return len(vectors)
    safe = np.maximum(lower, gaps[nearest, 0] / 2)
    open_ = np.flatnonzero(~(upper < safe))
    first_d = squared(vectors[open_], centroids[nearest[open_]])
    computed = open_.size
    upper[open_] = np.sqrt(first_d.astype(float)) * (1 + _SLACK)
    still = ~(upper[open_] < safe[open_])
    open_, first_d = open_[still], first_d[still]
    if not open_.size:
        return computed
    rows = vectors[open_]
    a, b = nearest[open_].copy(), second[open_].copy()
    second_d = squared(rows, centroids[b])
    computed += open_.size
    swap = (second_d < first_d) | (second_d == first_d) & (b < a)
    a[swap], b[swap] = b[swap], a[swap].copy()
    first_d[swap], second_d[swap] = second_d[swap], first_d[swap].copy()
    centre, reach = a.copy(), np.sqrt(first_d.astype(float)) * (1 + _SLACK)
    remembered = b.copy()
    going = np.arange(open_.size)
    for rank in range(order.shape[1]):
        radius = reach[going] + np.sqrt(second_d[going].astype(float)) * (1 + _SLACK)
        going = going[gaps[centre[going], rank] <= radius]
        if not going.size:
            break
        other = order[centre[going], rank]
        at = going[other != remembered[going]]
        other = other[other != remembered[going]]
        d = squared(rows[at], centroids[other])
        computed += at.size
        wins = (d < first_d[at]) | (d == first_d[at]) & (other < a[at])
        follows = ~wins & ((d < second_d[at]) | (d == second_d[at]) & (other < b[at]))
        w, f = at[wins], at[follows]
        b[w], second_d[w] = a[w], first_d[w]
        a[w], first_d[w] = other[wins], d[wins]
        b[f], second_d[f] = other[follows], d[follows]
    nearest[open_], second[open_] = a, b
    upper[open_] = np.sqrt(first_d.astype(float)) * (1 + _SLACK)
    lower[open_] = np.sqrt(second_d.astype(float)) * (1 - _SLACK)
    return computed


def shift_bounds(nearest: np.ndarray, upper: np.ndarray, lower: np.ndarray, old: np.ndarray, new: np.ndarray) -> None:
    """Widen the bounds by how far the centroids moved: the lower one by the largest move of another centroid."""
    moved = np.sqrt(squared(old, new).astype(float)) * (1 + _SLACK)
    upper += moved[nearest]
    if len(moved) > 1:
        top = np.argsort(moved)[::-1]
        lower -= np.where(nearest == top[0], moved[top[1]], moved[top[0]])
    upper *= 1 + _SLACK
    lower *= 1 - _SLACK * np.sign(lower)


def _sums(vectors: np.ndarray, nearest: np.ndarray, distances: np.ndarray | None, k: int) -> np.ndarray:
    """k rows: count, distance (where given) and component sums."""
    out = np.zeros((k, vectors.shape[1] + 2), dtype=np.int64)
    order = np.argsort(nearest, kind="stable")
    found, first = np.unique(nearest[order], return_index=True)
    out[:, 0] = np.bincount(nearest, minlength=k)
    if found.size:
        out[found, 2:] = np.add.reduceat(vectors[order].astype(np.int64), first, axis=0)
        if distances is not None:
            out[found, 1] = np.add.reduceat(distances[order], first)
    return out


def _scaled(values: np.ndarray, scale: int) -> np.ndarray:
    scaled = np.floor(scale * values)
    if np.abs(scaled).max() > LARGEST:
        raise ValueError(f"a component is beyond {LARGEST // scale}: squared distances would not fit a long")
    return scaled.astype(np.int64)


def _small(values: np.ndarray) -> np.ndarray:
    """The values in the narrowest integer type that holds them."""
    top = int(np.abs(values).max()) if values.size else 0
    return values.astype(np.int16 if top < 1 << 15 else np.int32 if top < 1 << 31 else np.int64)


def _blocks(dims: int, k: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dims)
            ids = np.array(batch.column("key").to_numpy(zero_copy_only=False), dtype="<i8")
            nulls = batch.column("unnumbered").to_numpy(zero_copy_only=False).astype(np.uint8)
            n = len(ids)
            vectors = _small(_scaled(values, scale))
            row = (ids.tobytes() + nulls.tobytes(), vectors.itemsize, vectors.tobytes(), np.zeros(n, np.int32).tobytes(),
                   np.full(n, min(1, k - 1), np.int32).tobytes(), np.full(n, np.inf).tobytes(), np.zeros(n).tobytes(), None)
            yield pa.RecordBatch.from_pylist([dict(zip(_FIELDS, row, strict=True))], schema=_SCHEMA)
    return run


_SCHEMA = pa.schema([("ids", pa.binary()), ("width", pa.int32()), ("vectors", pa.binary()), ("nearest", pa.binary()), ("second", pa.binary()),
                     ("upper", pa.binary()), ("lower", pa.binary()), ("sums", pa.list_(pa.int64()))])


def _unpacked(row: dict, dims: int) -> tuple[np.ndarray, list[np.ndarray]]:
    vectors = np.frombuffer(row["vectors"], dtype=f"<i{row['width']}").reshape(-1, dims)
    return vectors, [np.frombuffer(row[f], t).copy() for f, t in (("nearest", np.int32), ("second", np.int32), ("upper", float), ("lower", float))]


def _round(dims: int, old: np.ndarray | None, new: np.ndarray):
    """New state of every block after the centroids moved from `old` to `new`, and one row of sums per task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, total = neighbours(new), np.zeros((len(new), dims + 2), dtype=np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["ids"] is None:
                    continue
                vectors, (nearest, second, upper, lower) = _unpacked(row, dims)
                if old is not None:
                    shift_bounds(nearest, upper, lower, old, new)
                assign(vectors, new, near, nearest, second, upper, lower)
                total += _sums(vectors, nearest, squared(vectors, new[nearest]), len(new))
                row |= {"nearest": nearest.tobytes(), "second": second.tobytes(), "upper": upper.tobytes(), "lower": lower.tobytes()}
                yield pa.RecordBatch.from_pylist([row], schema=_SCHEMA)
        yield pa.RecordBatch.from_pylist([dict.fromkeys(_FIELDS) | {"sums": total.ravel().tolist()}], schema=_SCHEMA)
    return run


def _add_up(blocks: DataFrame, k: int, dims: int) -> list[list[int]]:
    """k rows of exact totals; only the tasks' sums are read."""
    sums = blocks.filter("sums IS NOT NULL").select(F.posexplode("sums").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"))
    flat = [0] * (k * (dims + 2))
    for r in sums.collect():
        flat[r["i"]] = r["x"]
    return [flat[i * (dims + 2):(i + 1) * (dims + 2)] for i in range(k)]


def _rows_of(dims: int, centroids: np.ndarray, inertias: list[int]):
    total = sum(inertias)
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                vectors, (nearest, *_) = _unpacked(row, dims)
                n = len(nearest)
                ids = pd.array(np.frombuffer(row["ids"], "<i8", n), dtype="Int64")
                ids[np.frombuffer(row["ids"], np.uint8, n, 8 * n).astype(bool)] = pd.NA
                yield pd.DataFrame({"vec_id": ids, "cluster": nearest, "distance": squared(vectors, centroids[nearest]),
                                    "cluster_inertia": np.array(inertias, dtype=np.int64)[nearest], "inertia": total,
                                    "centroid_sha256": np.array(names, dtype=object)[nearest]})
    return run


def cluster_vectors(vectors: DataFrame, *, dims: int = COMPONENTS, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept row of (vec_id, embedding).

    Vectors with another number of components, or one that is null or not finite, are left out. Components become
    floor(scale * x). The first centroids are those of the ids with the least sha256 of `2:<vec_id>` (null ids, after all others,
    of `2:`), equal ids in the order of their components; fewer vectors than clusters give as many centroids as vectors.
    Empty clusters keep their centroid. Repeated rows count each. A component beyond LARGEST after scaling raises ValueError, since
    its distances need not fit a long. An empty table, or one without kept rows, gives an empty result.
    """
    spark = vectors.sparkSession
    vector = column(vectors, "embedding")
    fits = (F.size(vector) == dims) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.filter(vector.isNotNull() & fits).select(column(vectors, "vec_id").cast("bigint").alias("vec_id"),
                                                            vector.cast("array<double>").alias("vector"))
    draw = F.sha2(F.concat(F.lit("2:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = kept.select(F.col("vec_id").isNull().alias("last"), draw.alias("draw"), "vector").orderBy("last", "draw", "vector").limit(clusters).collect()
    if not first:
        return spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    centroids = _scaled(np.array([r["vector"] for r in first]), scale)
    k = len(centroids)
    keyed = kept.select(F.coalesce("vec_id", F.lit(0)).alias("key"), F.col("vec_id").isNull().alias("unnumbered"), "vector")
    blocks, old, totals = keyed.mapInArrow(_blocks(dims, k, scale), _STATE), None, []
    folder = f"{shared_dir(spark)}/vectors-{uuid.uuid4().hex}"
    for step in range(rounds + 1):
        blocks.mapInArrow(_round(dims, old, centroids), _STATE).write.parquet(f"{folder}/{step}")
        blocks = spark.read.schema(_STATE).parquet(f"{folder}/{step}")
        totals = _add_up(blocks, k, dims)
        if step:
            delete(spark, f"{folder}/{step - 1}")
        if step < rounds:
            old, centroids = centroids, np.array([[s // t[0] for s in t[2:]] if t[0] else c.tolist() for t, c in zip(totals, centroids, strict=True)])
    final = blocks.filter("ids IS NOT NULL").select("ids", "width", "vectors", "nearest", "second", "upper", "lower")
    return final.mapInPandas(_rows_of(dims, centroids, [t[1] for t in totals]),
                             "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
