"""Masked pseudo-likelihood: a window network predicts every word from the words on both of its sides.

Word counts over the whole corpus give the vocabulary: the `HEAD` most frequent words have embeddings of their own, all others are
`rare`. The network predicts one of `CLASSES` classes: the most frequent words alone, bins of the other head words, and
rare words. A head word then has its corpus share of its class, and a rare word the probability of its spelling
by byte pairs, also counted over the corpus. A text's score is the sum of the log-probabilities of all its words.

The network is trained in numpy: on the driver on a bounded sample for a start, then in every partition on all words of all
its texts; the partitions' parameters are averaged by their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sums import add_up
from .tables import column, small_batches
from .text import as_long, word_chunks

HEAD = 4_096
CLASSES = 64
SINGLE = 48  # words that are a class of their own
REACH = 2  # words on either side
WIDTH, HIDDEN = 12, 24
SAMPLE_TEXTS, SAMPLE_CHARS = 1_000, 4_000  # of the first training
_BATCH = 2_048
_LARGE_BATCH = 8_192  # of the training in the partitions
_PIECE = 64  # parts that parameters are averaged in
_END = 0  # byte that ends a spelling; no word holds it


class Vocabulary:
    """Head words, their classes and shares, and byte-pair log-probabilities, from counts over the whole corpus."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, total: int, pairs: np.ndarray) -> None:
        by_rank = np.argsort(-counts, kind="stable")
        mass = np.cumsum(counts[by_rank[SINGLE:]], dtype=float)
        bins = CLASSES - SINGLE - 1
        rank_class = np.arange(words.size)
        if mass.size:
            rank_class[SINGLE:] = SINGLE + np.minimum((mass - 1e-9) / mass[-1] * bins, bins - 1).astype(int)
        classes = np.empty(words.size, dtype=np.int64)
        classes[by_rank] = rank_class
        order = np.argsort(words)
        self.words, counts, classes = words[order], counts[order].astype(float), classes[order]
        self.rare, self.edge = words.size, words.size + 1
        self.classes = np.append(classes, CLASSES - 1)
        sums = np.bincount(classes, counts, CLASSES)
        self.share = np.append(np.log(counts / sums[classes]), 0.0)
        smooth = pairs + 0.01
        self.pairs = np.log(smooth / smooth.sum(axis=1, keepdims=True)).astype(np.float32)
        self.total = total

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        if not self.words.size:
            return np.full(hashes.size, self.rare)
        at = np.minimum(np.searchsorted(self.words, hashes), self.words.size - 1)
        return np.where(self.words[at] == hashes, at, self.rare)

    def spelling(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Log-probability of the bytes of each word and of its end."""
        if not starts.size:
            return np.empty(0)
        values = self.pairs[np.append(_END, data[:-1]), data]
        values[starts] = self.pairs[_END, data[starts]]
        sums = np.concatenate([[0.0], np.cumsum(values, dtype=float)])
        return sums[ends] - sums[starts] + self.pairs[data[ends - 1], _END]


def _contexts(ids: np.ndarray, bounds: np.ndarray, edge: int) -> np.ndarray:
    """(words, 2 * REACH) ids around each word of a chunk; positions outside its text are `edge`."""
    owner = np.repeat(np.arange(bounds.size - 1), np.diff(bounds))
    place = np.arange(ids.size) + REACH * (2 * owner + 1)
    padded = np.full(ids.size + 2 * REACH * (bounds.size - 1), edge)
    padded[place] = ids
    return np.stack([padded[place + d] for d in range(-REACH, REACH + 1) if d], axis=1)


def first_parameters(size: int, seed: int = 3) -> dict[str, np.ndarray]:
    draw = np.random.RandomState(seed)
    return {"embed": draw.normal(0, 0.3, (size + 2, WIDTH)), "inner": draw.normal(0, 0.15, (2 * REACH * WIDTH, HIDDEN)),
            "inner_bias": np.zeros(HIDDEN), "outer": draw.normal(0, 0.2, (HIDDEN, CLASSES)), "outer_bias": np.zeros(CLASSES)}


def train(p: dict[str, np.ndarray], contexts: np.ndarray, targets: np.ndarray, rate: float, state: dict, epochs: int = 1,
          batch: int = _BATCH) -> float:
    """Adam over the windows in random order; changes `p` and `state`. Returns the mean loss of the last epoch."""
    draw = np.random.RandomState(len(targets) % 1000)
    losses = [0.0]
    for _ in range(epochs):
        order, losses = draw.permutation(len(targets)), []
        for begin in range(0, len(order), batch):
            some = order[begin:begin + batch]
            ids, wanted = contexts[some], targets[some]
            x = p["embed"][ids].reshape(len(some), -1)
            hidden = np.tanh(x @ p["inner"] + p["inner_bias"])
            scores = hidden @ p["outer"] + p["outer_bias"]
            scores = np.exp(scores - scores.max(axis=1, keepdims=True))
            probs = scores / scores.sum(axis=1, keepdims=True)
            rows = np.arange(len(some))
            losses.append(float(-np.log(probs[rows, wanted] + 1e-12).mean()))
            probs[rows, wanted] -= 1
            probs /= len(some)
            d_hidden = (probs @ p["outer"].T) * (1 - hidden * hidden)
            d_x = (d_hidden @ p["inner"].T).reshape(-1, WIDTH)
            flat = ids.ravel()
            grads = {"outer": hidden.T @ probs, "outer_bias": probs.sum(axis=0), "inner": x.T @ d_hidden, "inner_bias": d_hidden.sum(axis=0),
                     "embed": np.stack([np.bincount(flat, d_x[:, j], len(p["embed"])) for j in range(WIDTH)], axis=1).astype(p["embed"].dtype)}
            state["step"] = step = state.get("step", 0) + 1
            for key, grad in grads.items():
                m, v = state.setdefault(key, (np.zeros_like(grad), np.zeros_like(grad)))
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                p[key] = p[key] - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return float(np.mean(losses)) if losses else 0.0


def _windows(vocabulary: Vocabulary, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(contexts, targets) of the texts by chunks, so that long texts are never held together."""
    for _, bounds, hashes, _ in word_chunks(texts):
        ids = vocabulary.ids(hashes)
        yield _contexts(ids, bounds, vocabulary.edge), vocabulary.classes[ids]


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(kind, key, n): words by hash (0) and byte pairs (1) of the texts."""
    pairs = np.zeros(65_536, dtype=np.int64)

    def spell(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        nonlocal pairs
        before = np.append(_END, data[:-1]).astype(np.int64)
        before[starts] = _END
        word = np.zeros(data.size + 1, dtype=np.int8)
        word[starts] += 1
        word[ends] -= 1
        inside = np.cumsum(word[:-1]) > 0
        pairs += np.bincount((before * 256 + data)[inside], minlength=65_536)
        pairs += np.bincount(data[ends - 1].astype(np.int64) * 256 + _END, minlength=65_536)
        return np.empty(0)

    for batch in batches:
        found = [hashes for _, _, hashes, _ in word_chunks(batch["text"].tolist(), spell)]
        words, counts = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0), np.empty(0))
        yield pd.DataFrame({"kind": np.zeros(words.size, dtype=np.int32), "key": as_long(words), "n": counts.astype(np.int64)})
    used = np.flatnonzero(pairs)
    yield pd.DataFrame({"kind": np.ones(used.size, dtype=np.int32), "key": used, "n": pairs[used]})


def corpus_vocabulary(rows: DataFrame) -> Vocabulary:
    """Vocabulary of all words of all rows. The driver gets the head words, at most 65,536 byte pairs and one total."""
    counts = rows.mapInPandas(_counts, "kind int, key bigint, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    head = counts.filter("kind = 0").orderBy(F.desc("n"), "key").limit(HEAD).toPandas()
    pairs = np.zeros(65_536)
    spelled = counts.filter("kind = 1").toPandas()
    pairs[spelled["key"].to_numpy(int)] = spelled["n"]
    pairs = pairs.reshape(256, 256)
    return Vocabulary(head["key"].to_numpy(np.int64).view(np.uint64), head["n"].to_numpy(), int(pairs[_END].sum()), pairs)


def _refine(shared):
    """Trains a copy of the parameters on all texts of this partition; gives weighted parameters and the weight in words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary, start = shared
        p, state, weight = {k: v.astype(np.float32) for k, v in start.items()}, {}, 0
        for batch in batches:
            for contexts, targets in _windows(vocabulary, batch["text"].tolist()):
                train(p, contexts, targets, 0.002, state, batch=_LARGE_BATCH)
                weight += targets.size
        if weight:
            flat = np.concatenate([p[k].ravel() for k in sorted(p)]).astype(float) * weight
            pieces = np.array_split(flat, _PIECE)
            yield pd.DataFrame({"i": np.arange(_PIECE + 1, dtype=np.int32), "sums": [*pieces, np.array([float(weight)])]})

    return run


class MaskedLM:
    def __init__(self, vocabulary: Vocabulary, params: dict[str, np.ndarray]) -> None:
        self.vocabulary = vocabulary
        p = {k: v.astype(np.float32) for k, v in params.items()}
        self.tables = [p["embed"] @ p["inner"][k * WIDTH:(k + 1) * WIDTH] for k in range(2 * REACH)]  # embedding and first layer in one
        self.inner_bias, self.outer, self.outer_bias = p["inner_bias"], p["outer"], p["outer_bias"]

    def word_scores(self, ids: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        """log P(class | both sides) + log P(word | class); for rare words the class alone."""
        out = np.empty(ids.size)
        for begin in range(0, ids.size, 4 * _BATCH):
            some = slice(begin, begin + 4 * _BATCH)
            hidden = self.tables[0][contexts[some, 0]]
            for k in range(1, 2 * REACH):
                hidden += self.tables[k][contexts[some, k]]
            hidden += self.inner_bias
            np.tanh(hidden, out=hidden)
            scores = hidden @ self.outer
            scores += self.outer_bias
            scores -= scores.max(axis=1, keepdims=True)
            wanted = scores[np.arange(len(scores)), self.vocabulary.classes[ids[some]]]
            out[some] = wanted - np.log(np.exp(scores, out=scores).sum(axis=1))
        return out + self.vocabulary.share[ids]

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of words and summed log-probabilities of the texts."""
        count, total = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts))
        for first, bounds, hashes, spelled in word_chunks(texts, self.vocabulary.spelling):
            ids = self.vocabulary.ids(hashes)
            values = self.word_scores(ids, _contexts(ids, bounds, self.vocabulary.edge))
            values += np.where(ids == self.vocabulary.rare, spelled, 0.0)
            sums = np.concatenate([[0.0], np.cumsum(values)])
            n = bounds.size - 1
            count[first:first + n] = np.diff(bounds)
            total[first:first + n] = sums[bounds[1:]] - sums[bounds[:-1]]
        return count, total


def train_masked_lm(docs: DataFrame, text: str = "text") -> MaskedLM:
    rows = docs.select(column(docs, text).alias("text")).filter(F.col("text").isNotNull())
    vocabulary = corpus_vocabulary(rows)
    place = F.pmod(F.xxhash64("text"), F.lit(1_000_000))
    share = 1.5e6 * SAMPLE_TEXTS / max(1, rows.count())
    begin = F.pmod(F.xxhash64("text", F.lit(1)), F.greatest(F.lit(1), F.length("text") - SAMPLE_CHARS + 1)).cast("int") + 1
    sample = rows.filter(place < share).select(F.substring("text", begin, F.lit(SAMPLE_CHARS)).alias("text"), F.xxhash64("text").alias("h"))
    texts = [r["text"] for r in sample.distinct().orderBy("h", "text").limit(SAMPLE_TEXTS).collect()]
    params = first_parameters(vocabulary.words.size)
    windows = list(_windows(vocabulary, texts))
    if windows:
        train(params, *map(np.concatenate, zip(*windows)), 0.01, {}, epochs=2)
    shared = (vocabulary, params)
    found = {r["i"]: r["sums"] for r in add_up(rows.mapInPandas(_refine(shared), "i int, sums array<double>")).collect()}
    if found:
        flat, at = np.concatenate([found[i] for i in range(_PIECE)]) / found[_PIECE][0], 0
        for key in sorted(params):
            params[key] = flat[at:at + params[key].size].reshape(params[key].shape)
            at += params[key].size
    return MaskedLM(vocabulary, params)


def score_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, log_prob, mean_log_prob) of every row: all words of its whole text count.

    A null text, or one without words, has no tokens, log_prob 0 and a null mean. Equal texts have equal scores; repeated rows
    give repeated rows; null ids are kept; other columns are not read.
    """
    small_batches(docs.sparkSession)
    model = train_masked_lm(docs)

    @F.pandas_udf("n_tokens bigint, log_prob double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            count, total = model.score(batch.tolist())
            yield pd.DataFrame({"n_tokens": count, "log_prob": np.round(total, 4)})  # the same wherever a text stands in a batch

    rows = docs.select(column(docs, "doc_id").alias("doc_id"), score(column(docs, "text")).alias("s")).select("doc_id", "s.*")
    return rows.withColumn("mean_log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")))
