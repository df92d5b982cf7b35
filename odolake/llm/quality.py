"""Quality scores: ridge regression on random Fourier features of document statistics, with isotonic calibration.

The cosine features approximate a Gaussian kernel over standardised statistics of the whole text. Every partition sums
its part of the normal equations, a reducer per matrix row adds the parts, and the driver solves one small system.
Calibration pools adjacent violators over a fixed number of score bins. All labelled rows outside the held-out fold count.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .sums import add_up
from .tables import column, fold, small_batches

HELD_OUT = (3, 1)  # folds, fold that is never learned from
FEATURES = 192
RIDGE = 1e-3
BINS = 2_000
_SCORE_SPAN = (-1.0, 2.0)  # of the raw scores; what lies beyond shares the outermost bins


def _codes(*groups) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    for group in groups:
        out[list(group)] = True
    return out


_CLASSES = [
    _codes(range(65, 91), range(97, 123), range(128, 256)),  # letters
    _codes(range(65, 91)), _codes(range(48, 58)), _codes(b" \t\r\n"), _codes(b".,;:"), _codes(b"!?"),
    _codes(b"#$%&*+=@^_|~<>{}[]\\/"), _codes(b"'\"()-"), _codes(range(128, 256)), _codes(range(9), range(14, 32)),
]
_CLASS_MATRIX = np.stack(_CLASSES, axis=1).astype(float)
STATISTICS = len(_CLASSES) + 13


def statistics(text: str | None) -> np.ndarray:
    """Statistics of a whole text; those of the empty text for null."""
    text = text if isinstance(text, str) else ""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    counts = np.bincount(data, minlength=256).astype(float)
    total = max(1, data.size)
    shares = counts / total
    words, lines = text.split(), text.split("\n")
    lengths = np.fromiter(map(len, words), dtype=float, count=len(words)) if words else np.zeros(1)
    n = max(1, len(words))
    seen = Counter(words)
    used = shares[shares > 0]
    return np.array([
        *(shares @ _CLASS_MATRIX), np.log1p(data.size), np.log1p(len(words)), lengths.mean(), lengths.std(), np.log1p(lengths.max()),
        len(seen) / n, max(seen.values(), default=0) / n, sum(map(str.isupper, words)) / n, sum(map(str.isalpha, words)) / n,
        np.log1p(len(lines)), np.log1p(total / len(lines)), len(set(lines)) / len(lines), -float(used @ np.log(used))])


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def raw(self, rows: np.ndarray) -> np.ndarray:
        return fourier(rows, self.mean, self.scale) @ self.weights

    def score(self, rows: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(rows), self.knots, self.values), 0.0, 1.0)


def fourier(rows: np.ndarray, mean: np.ndarray, scale: np.ndarray, count: int = FEATURES) -> np.ndarray:
    """Cosine features of standardised rows, and a constant."""
    draw = np.random.RandomState(41)
    # the Gaussian kernel's width is the root of the number of statistics, the usual distance of two standardised rows
    directions = draw.normal(0, 1 / np.sqrt(mean.size), (mean.size, count))
    offsets = draw.uniform(0, 2 * np.pi, count)
    standard = np.clip((rows - mean) / scale, -6, 6)
    return np.hstack([np.sqrt(2 / count) * np.cos(standard @ directions + offsets), np.ones((len(rows), 1))])


def isotonic(scores: np.ndarray, means: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres and values of the blocks of the best nondecreasing fit to `means` at the ascending `scores`."""
    blocks: list[list[float]] = []
    for x, y, w in zip(scores, means, weights, strict=True):
        blocks.append([x * w, y * w, w])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    table = np.array(blocks)
    return table[:, 0] / table[:, 2], table[:, 1] / table[:, 2]


def _matrix(batch: pd.Series) -> np.ndarray:
    return np.stack(batch.to_numpy()).astype(float) if len(batch) else np.empty((0, STATISTICS))


def _summed(rows: DataFrame, part) -> np.ndarray:
    """Sum over all partitions of the matrices that `part(features, labels)` gives, added up row by row."""

    def partials(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            if len(batch):
                matrix = part(_matrix(batch["stats"]), batch["label"].to_numpy(float))
                total = matrix if total is None else total + matrix
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total)), "sums": list(total)})

    found = add_up(rows.mapInPandas(partials, "i int, sums array<double>")).orderBy("i").collect()
    return np.array([r["sums"] for r in found])


def fit(rows: DataFrame) -> Model | None:
    """A model of the labelled rows (stats, label); None if there are none."""
    moments = _summed(rows, lambda x, y: np.stack([np.full(x.shape[1], len(x)), x.sum(axis=0), (x * x).sum(axis=0)]))
    if not moments.size:
        return None
    count = moments[0, 0]
    mean = moments[1] / count
    scale = np.sqrt(np.maximum(moments[2] / count - mean * mean, 1e-12))
    scale[scale < 1e-5] = 1.0

    def normal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = fourier(x, mean, scale)
        return z.T @ np.hstack([z, y[:, None]])

    system = _summed(rows, normal)
    penalty = np.full(FEATURES + 1, RIDGE * count / FEATURES)
    penalty[-1] = 0
    weights = np.linalg.solve(system[:, :-1] + np.diag(penalty) + 1e-9 * np.eye(FEATURES + 1), system[:, -1])
    low, high = _SCORE_SPAN

    def binned(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        raw = np.clip(fourier(x, mean, scale) @ weights, low, high)
        at = np.minimum(((raw - low) / (high - low) * BINS).astype(int), BINS - 1)
        return np.stack([np.bincount(at, w, BINS) for w in (np.ones_like(raw), raw, y)])

    n, raw, positive = _summed(rows, binned)
    used = n > 0
    return Model(mean, scale, weights, *isotonic(raw[used] / n[used], positive[used] / n[used], n[used]))


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of `docs`, from its whole text alone.

    `labels` has doc_id and quality (0 or 1); null ids and qualities teach nothing, and repeated labels count as often as they
    stand there. Null and empty texts get the score of the empty text's statistics. Without any label every score is 0.5.
    Repeated rows give repeated rows; a null id is not held out; other columns are not read.
    """
    small_batches(docs.sparkSession)

    @F.pandas_udf("array<float>")
    def stats(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([statistics(t).astype(np.float32) for t in batch], dtype=object)

    rows = materialize(docs.select(column(docs, "doc_id").alias("doc_id"), stats(column(docs, "text")).alias("stats")))
    marks = labels.select(column(labels, "doc_id").alias("doc_id"), column(labels, "quality").cast("double").alias("label")).filter(
        F.col("label").isNotNull() & (fold("doc_id", HELD_OUT[0]) != HELD_OUT[1]))
    model = fit(materialize(rows.join(marks, "doc_id").select("stats", "label")))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(np.round(model.score(_matrix(batch)), 9) if model else np.full(len(batch), 0.5))

    scored = rows.select("doc_id", (fold("doc_id", HELD_OUT[0]) == HELD_OUT[1]).alias("held_out"), score("stats").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
