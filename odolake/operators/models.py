"""K-means labels with cluster profiles, and principal components across cohorts."""

from __future__ import annotations

import re
from collections.abc import Sequence as Seq
from functools import reduce
from operator import add, and_

import numpy as np
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fixed_values import CLUSTER_COLUMN_NAME, CLUSTER_RESTARTS, CLUSTER_SEED
from ..limits import CLUSTER_ITERATIONS, PCA_SIGNALS, require
from ..session import materialize
from .charts import pooled
from .filters import apply_filters
from .sampling import group_sample
from .schema import require_numeric

START_POINTS = 100_000  # points that the starts of K-means are fitted on, at most about; the final centres come from all rows
STILL = 1e-4  # centres that move less, in deviations, stand still


def _is_complete(columns: Seq[str]) -> Column:
    return reduce(and_, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in columns])


def _complete(df: DataFrame, columns: Seq[str]) -> DataFrame:
    return df.filter(_is_complete(columns))


def standard_scale(df: DataFrame, columns: Seq[str]) -> tuple[list[dict], int]:
    """Mean and population deviation per column (1 for a constant one) and the row count. One scan, one row back."""
    row = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m_{i}") for i, c in enumerate(columns)],
                 *[F.stddev_pop(F.col(c).cast("double")).alias(f"s_{i}") for i, c in enumerate(columns)],
                 F.count(F.lit(1)).alias("n")).first()
    return [{"mean": row[f"m_{i}"] or 0.0, "std": row[f"s_{i}"] or 1.0} for i in range(len(columns))], row["n"]


def scaled(df: DataFrame, columns: Seq[str], scale: list[dict]) -> DataFrame:
    """Adds z_i = (value - mean) / deviation."""
    return df.select("*", *[((F.col(c).cast("double") - F.lit(s["mean"])) / F.lit(s["std"])).alias(f"z_{i}")
                            for i, (c, s) in enumerate(zip(columns, scale))])


def _assemble(df: DataFrame, n: int) -> DataFrame:
    return VectorAssembler(inputCols=[f"z_{i}" for i in range(n)], outputCol="features").transform(df)


def _start_points(z: DataFrame, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """About START_POINTS different points (all, where there are fewer) with how many rows have them.

    Points are drawn by a hash of their values, so rows that repeat one point come as one weight.
    """
    different = z.agg(F.approx_count_distinct(F.xxhash64(*names), 0.02)).first()[0]
    drawn = z
    if different > START_POINTS:
        share = int(START_POINTS / different * (1 << 30))
        drawn = z.filter(F.pmod(F.xxhash64(F.lit(CLUSTER_SEED), *names), F.lit(1 << 30)) < share)
    found = drawn.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).orderBy(*names).toPandas()  # bounded by the draw
    return found[names].to_numpy(float), found["n"].to_numpy(float)


def _lloyd(points: np.ndarray, weights: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, float]:
    """Centres and cost of weighted points, iterated until the centres stand still."""
    for _ in range(CLUSTER_ITERATIONS):
        gaps = (centres ** 2).sum(axis=1) - 2 * points @ centres.T
        nearest = gaps.argmin(axis=1)
        size = np.bincount(nearest, weights, len(centres))
        sums = np.stack([np.bincount(nearest, weights * x, len(centres)) for x in points.T], axis=1)
        moved = np.where(size[:, None] > 0, sums / np.maximum(size, 1e-300)[:, None], centres)
        shift, centres = np.sqrt(((moved - centres) ** 2).sum(axis=1)).max(), moved
        if shift <= STILL:
            break
    return centres, float(((gaps.min(axis=1) + (points ** 2).sum(axis=1)) * weights).sum())


def _spread_centres(points: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k different points, each drawn in proportion to its squared distance from those before."""
    chosen = [points[rng.choice(len(points), p=weights / weights.sum())]]
    far = np.full(len(points), np.inf)
    for _ in range(k - 1):
        far = np.minimum(far, ((points - chosen[-1]) ** 2).sum(axis=1))
        pull = far * weights if (far > 0).any() else weights
        chosen.append(points[rng.choice(len(points), p=pull / pull.sum())])
    return np.array(chosen)


def nearest_centre(names: Seq[str], centres: Seq[Seq[float]]) -> Column:
    """Index of the nearest centre, the first of equal ones, in generated code."""
    gaps = [reduce(add, [(F.col(n) - F.lit(float(x))) * (F.col(n) - F.lit(float(x))) for n, x in zip(names, c)]) for c in centres]
    return F.array_position(F.array(*gaps), F.array_min(F.array(*gaps))) - 1


def fit_clusters(complete: DataFrame, features: Seq[str], k: int) -> tuple[list[list[float]], list[dict]]:
    """Centres of all complete rows, in scaled units, and the scale.

    The best of four seeded starts on a bounded draw of points gives first centres; they are then moved over all rows until they
    stand still, one scan of the written features and k rows of sums each time.
    """
    scale, _ = standard_scale(complete, features)
    names = [f"z_{i}" for i in range(len(features))]
    z = materialize(scaled(complete.select(*features), features, scale).select(*names))
    points, weights = _start_points(z, names)
    starts = [_lloyd(points, weights, _spread_centres(points, weights, k, np.random.default_rng(CLUSTER_SEED + i)))
              for i in range(CLUSTER_RESTARTS)]
    centres = min(starts, key=lambda s: s[1])[0].tolist()
    for _ in range(CLUSTER_ITERATIONS):
        means = z.groupBy(nearest_centre(names, centres).alias("c")).agg(*[F.avg(n).alias(n) for n in names])
        moved = list(centres)
        for r in means.collect():  # at most k rows
            moved[r["c"]] = [r[n] for n in names]
        shift = max(sum((x - y) ** 2 for x, y in zip(a, b)) for a, b in zip(centres, moved)) ** 0.5
        centres = moved
        if shift <= STILL:
            break
    return centres, scale


def cluster_rows(df: DataFrame, features: Seq[str], k: int = 4, column_name: str = "cluster") -> DataFrame:
    """The input with a BIGINT label column (replaced when it exists, last): 0 is the largest cluster.

    Rows with a missing feature get null. Labelling is a narrow map over the rows: no join by row key.
    """
    require(bool(features), "choose at least one signal")
    require_numeric(df, *features)
    require(2 <= int(k) <= 20, "k must be between 2 and 20")
    column_name = column_name.strip() or "cluster"
    require(re.fullmatch(CLUSTER_COLUMN_NAME, column_name) is not None, "the column name has characters not allowed")
    complete = _complete(df, features)
    require(len(complete.limit(int(k)).take(int(k))) >= int(k), f"fewer than {k} complete rows")
    centres, scale = fit_clusters(complete, features, int(k))
    raw = scaled(complete, features, scale).withColumn("__raw", nearest_centre([f"z_{i}" for i in range(len(features))], centres))
    sizes = {r["__raw"]: r["count"] for r in raw.groupBy("__raw").count().collect()}  # at most 20 rows
    rank = {c: i for i, c in enumerate(sorted(range(int(k)), key=lambda c: (-sizes.get(c, 0), c)))}
    relabel = F.element_at(F.create_map(*[F.lit(v) for pair in rank.items() for v in pair]), F.col("__raw"))
    base = [c for c in df.columns if c != column_name]
    labelled = raw.select(*base, relabel.cast("long").alias(column_name))
    missing = df.filter(~F.coalesce(_is_complete(features), F.lit(False)))
    return labelled.unionByName(missing.select(*base, F.lit(None).cast("long").alias(column_name)))


def cluster_profile(df: DataFrame, features: Seq[str], column_name: str = "cluster", k: int | None = None) -> DataFrame:
    """count, percent and the mean of each feature per cluster, in original units; with `k`, clusters without rows too."""
    rows = df.filter(F.col(column_name).isNotNull())
    out = rows.groupBy(column_name).agg(
        F.count(F.lit(1)).alias("count"), *[F.round(F.avg(F.col(f).cast("double")), 4).alias(f) for f in features])
    if k:
        every = df.sparkSession.range(int(k)).select(F.col("id").cast(df.schema[column_name].dataType).alias(column_name))
        out = every.join(F.broadcast(out), column_name, "left").withColumn("count", F.coalesce("count", F.lit(0)))  # k rows
    total = F.sum("count").over(Window.partitionBy(F.lit(0)))  # one row per cluster
    return out.withColumn("percent", F.round(F.col("count") * 100 / total, 2))


def cohort_pca(df: DataFrame, members: DataFrame, columns: Seq[str], filters: list[dict] | None = None, *,
               key: str = "dataset_id", tie: str = "row_pos") -> tuple[DataFrame, DataFrame]:
    """Two components fitted once on all complete rows of the cohorts; about 3000 rows of each are projected for display.

    Gives (projections: cohort, dataset, row, pc1, pc2) and (loadings: component, explained, column, loading).
    The sign is fixed: the loading of largest size is positive.
    """
    columns = list(dict.fromkeys(c for c in columns if c))
    require(2 <= len(columns) <= PCA_SIGNALS, f"choose 2 to {PCA_SIGNALS} numeric signals")
    require_numeric(df, *columns)
    named = members.select(key, F.col("cohort").alias("label"))
    rows = apply_filters(pooled(df, named, [*columns, tie, *[f["column"] for f in filters or []]], key), filters)
    complete = _complete(rows, columns)
    scale, count = standard_scale(complete, columns)
    require(count >= 3, "too few complete rows for principal components")
    model = PCA(k=2, inputCol="features", outputCol="pc").fit(_assemble(scaled(complete, columns, scale), len(columns)))
    ready = _assemble(scaled(group_sample(complete, ["label"], [key, tie]), columns, scale), len(columns))
    axes = model.pc.toArray()  # columns x 2, a model parameter
    signs = [1.0 if axes[abs(axes[:, j]).argmax(), j] >= 0 else -1.0 for j in range(2)]
    pc = vector_to_array("pc")
    projected = model.transform(ready).select(
        F.col("label").alias("cohort"), key, tie,
        *[(F.get(pc, F.lit(j)) * F.lit(signs[j])).alias(f"pc{j + 1}") for j in range(2)])
    ratio = [float(v) for v in model.explainedVariance.toArray()]
    loadings = df.sparkSession.createDataFrame(
        [(j + 1, ratio[j], c, float(axes[i, j] * signs[j])) for j in range(2) for i, c in enumerate(columns)],
        "component int, explained double, column string, loading double")
    return projected, loadings
