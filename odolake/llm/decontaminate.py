"""Benchmark decontamination: n-gram seeds lead from texts to test items, Smith-Waterman alignment scores the passage.

All word pairs of an item are its seeds, whatever their number in the corpus. Between two matches that are no shared pair lies
a miss or a gap, so a score of at least the threshold needs a number of different shared pairs that follows from the item's length:
stretches of text with fewer are passed over, and no copy above the threshold is among them. The others are aligned with the item
word by word. Items are held in blocks of bounded size; the texts never leave their rows.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import column, free_name, small_batches
from .text import shingle_hashes, word_hashes

THRESHOLD = 0.6
MIN_WORDS = 2  # an item of one word stands in too many texts to tell anything
MATCH, MISS, GAP = 2, -1, 1
BLOCK_CHARS = 4_000_000  # of items that are worked on together
_CELLS = 1_000_000
_FOUND = "array<struct<item_id: bigint, score: double, end_word: int>>"


class Item(NamedTuple):
    item_id: int | None
    words: np.ndarray


class Seeds(NamedTuple):
    """n-grams of one length: sorted hashes, and for each the items and places in them that it stands at."""

    size: int
    hashes: np.ndarray
    places: list[list[tuple[int, int]]]


def _seed_need(words: int, threshold: float) -> tuple[int, int]:
    """(seed length, how many different seeds of the item a passage has at least) for scores of `threshold` or more.

    A path of m matches with b breaks between them scores at most MATCH * m - b and keeps m - 1 - b pairs; m is at most `words`.
    Where that leaves no sure pair (items of a few words, low thresholds), single words are the seeds.
    """
    wanted = MATCH * threshold * words
    pairs = math.ceil(wanted - (MATCH - 1) * words - 1 - 1e-9)
    return (2, pairs) if pairs > 0 else (1, max(1, math.ceil(wanted / MATCH - 1e-9)))


def _seeds(items: list[Item], threshold: float) -> list[Seeds]:
    grams: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
    for i, item in enumerate(items):
        size = _seed_need(item.words.size, threshold)[0]
        for place, h in enumerate(shingle_hashes(item.words, size).tolist()):
            grams[size][h].append((i, place))
    return [Seeds(size, np.array(sorted(found), dtype=np.uint64), [found[h] for h in sorted(found)]) for size, found in grams.items()]


def _hits(words: np.ndarray, size: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the text and numbers of the seeds that stand there."""
    if words.size < size or not hashes.size:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    grams = shingle_hashes(words, size)
    at = np.minimum(np.searchsorted(hashes, grams), hashes.size - 1)
    places = np.flatnonzero(hashes[at] == grams)
    return places, at[places]


def local_scores(item: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best Smith-Waterman score of the item in each row of `windows` (linear gaps), and the column where it ends.

    A gap in the item's direction is taken row by row; along the text all gap lengths are taken at once by a running maximum.
    """
    count, width = windows.shape
    ramp = GAP * np.arange(width, dtype=np.int32)
    before = np.zeros((count, width + 1), dtype=np.int32)
    best, end = np.zeros(count, dtype=np.int32), np.zeros(count, dtype=np.int64)
    rows = np.arange(count)
    for word in item:
        now = np.maximum(before[:, :-1] + np.where(windows == word, MATCH, MISS).astype(np.int32), before[:, 1:] - GAP)
        np.maximum(now, 0, out=now)
        now = np.maximum.accumulate(now + ramp, axis=1) - ramp
        at = now.argmax(axis=1)
        top = now[rows, at]
        end = np.where(top > best, at, end)
        best = np.maximum(best, top)
        before[:, 1:] = now
    return best, end


class Finder:
    def __init__(self, items: list[Item], seeds: list[Seeds], threshold: float) -> None:
        self.items, self.seeds, self.threshold = items, seeds, threshold
        self.need = np.array([_seed_need(item.words.size, threshold)[1] for item in items])
        self.owners = [np.array([i for found in s.places for i, _ in found]) for s in seeds]
        self.bounds = [np.cumsum([0, *map(len, s.places)]) for s in seeds]

    def _wanted(self, which: int, numbers: np.ndarray) -> set[int]:
        """Items with enough different seeds among those of a text."""
        used = np.unique(numbers)
        begin, count = self.bounds[which][used], np.diff(self.bounds[which])[used]
        at = np.repeat(begin - np.cumsum(count) + count, count) + np.arange(count.sum())
        seen, n = np.unique(self.owners[which][at], return_counts=True)
        return set(seen[n >= self.need[seen]].tolist())

    def windows(self, words: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, begin, end) of the stretches of a text around the seeds of an item, overlapping ones joined.

        A seed that stands at several places of an item opens one window for all of them, so the work follows the seeds that a text
        holds, however often text and item repeat themselves.
        """
        for which, seeds in enumerate(self.seeds):
            places, numbers = _hits(words, seeds.size, seeds.hashes)
            wanted = self._wanted(which, numbers) if numbers.size else set()
            if not wanted:
                continue
            order = np.argsort(numbers, kind="stable")
            used, firsts = np.unique(numbers[order], return_index=True)
            met: dict[int, list[tuple[int, int, int, np.ndarray]]] = defaultdict(list)
            for number, at in zip(used.tolist(), np.split(places[order], firsts[1:]), strict=True):
                offsets: dict[int, list[int]] = defaultdict(list)
                for i, offset in seeds.places[number]:
                    if i in wanted:
                        offsets[i].append(offset)
                for i, found in offsets.items():
                    met[i].append((min(found), max(found), len(found), at))
            for i, found in met.items():
                yield from self._stretches(i, words, found)

    def _stretches(self, i: int, words: np.ndarray, found: list[tuple[int, int, int, np.ndarray]]) -> Iterator[tuple[int, int, int]]:
        item = self.items[i].words
        slack = 4 + math.ceil(max(0.5, MATCH * (1 - self.threshold)) * item.size)  # more gaps cost more than is left
        begins = np.concatenate([at - high - slack for _, high, _, at in found])
        ends = np.concatenate([at - low + item.size + slack for low, _, _, at in found])
        seed = np.repeat(np.arange(len(found)), [at.size for *_, at in found])
        weight = np.array([n for _, _, n, _ in found])
        order = np.argsort(begins, kind="stable")
        begins, ends, seed = np.maximum(begins[order], 0), np.minimum(np.maximum.accumulate(ends[order]), words.size), seed[order]
        opens = np.flatnonzero(np.r_[True, begins[1:] > ends[:-1]])
        stretch = np.cumsum(np.isin(np.arange(begins.size), opens)) - 1
        pairs = np.unique(stretch * len(found) + seed)
        seeds_in = np.bincount(pairs // len(found), weight[pairs % len(found)], opens.size)
        closes = np.r_[opens[1:], begins.size] - 1
        for k in np.flatnonzero(seeds_in >= self.need[i]).tolist():
            begin, end = int(begins[opens[k]]), int(ends[closes[k]])
            if np.isin(item, words[begin:end]).mean() >= self.threshold - 1e-9:
                yield i, begin, end

    def find(self, texts: list[str | None]) -> list[list[dict]]:
        """For each text the items it contains, by the best passage of each."""
        jobs: dict[int, list[tuple[int, int, np.ndarray]]] = defaultdict(list)
        for number, words in word_hashes(texts):
            for i, begin, end in self.windows(words):
                jobs[i].append((number, begin, words[begin:end]))
        found: list[dict] = [{} for _ in texts]
        for i, all_jobs in jobs.items():
            item = self.items[i]
            all_jobs.sort(key=lambda job: job[2].size)
            while all_jobs:
                width = all_jobs[-1][2].size
                some = [all_jobs.pop() for _ in range(min(len(all_jobs), max(1, _CELLS // width)))]
                matrix = np.zeros((len(some), width), dtype=np.uint64)
                for row, (_, _, window) in enumerate(some):
                    matrix[row, :window.size] = window
                for (number, begin, _), best, end in zip(some, *local_scores(item.words, matrix), strict=True):
                    score = float(best) / (MATCH * item.words.size)
                    known = found[number].get(i)
                    if score >= self.threshold and (known is None or score > known["score"]):
                        found[number][i] = {"item_id": item.item_id, "score": score, "end_word": begin + int(end) + 1}
        return [[row[i] for i in sorted(row)] for row in found]


def short_items(benchmark: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(item_id, text) of the items that are left out because they have fewer words, or none."""

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        sizes = {i: words.size for i, words in word_hashes(texts.tolist())}
        return pd.Series([sizes.get(i, 0) for i in range(len(texts))], dtype="int32")

    items = benchmark.select(column(benchmark, "item_id").cast("bigint").alias("item_id"), column(benchmark, "text").alias("text"))
    return items.filter(count("text") < min_words)


def _blocks(benchmark: DataFrame, min_words: int) -> Iterator[list[Item]]:
    """Items of at least `min_words` words, in blocks of about BLOCK_CHARS characters."""
    items = benchmark.select(column(benchmark, "item_id").cast("bigint").alias("item_id"), column(benchmark, "text").alias("text")).filter(
        F.col("text").isNotNull())
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    count = -(-total // BLOCK_CHARS)
    for number in range(count):
        block = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == number)
        rows = sorted(block.distinct().collect(), key=lambda r: (r["item_id"] is None, r["item_id"], r["text"]))
        words = dict(word_hashes([r["text"] for r in rows]))
        held = [Item(r["item_id"], words[i]) for i, r in enumerate(rows) if words[i].size >= max(1, min_words)]
        if held:
            yield held


def _find_udf(shared, threshold: float):
    """`shared` has the items and seeds of one block."""

    @F.pandas_udf(_FOUND)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        items, seeds = shared.value
        finder = Finder([Item(*x) for x in items], [Seeds(*x) for x in seeds], threshold)
        for batch in batches:
            yield pd.Series(finder.find(batch.tolist()), dtype=object)

    return find


def contained_items(docs: DataFrame, benchmark: DataFrame, text: str = "text", threshold: float = THRESHOLD,
                    min_words: int = MIN_WORDS) -> Column:
    """array(struct(item_id, score, end_word)) of the items that a text of `docs` contains.

    The score is the alignment's share of the score of a whole copy: 1 for the item word for word.
    """
    small_batches(docs.sparkSession)
    parts = []
    for items in _blocks(benchmark, min_words):
        seeds = _seeds(items, threshold)
        plain = ([tuple(x) for x in items], [tuple(x) for x in seeds])  # tasks have no package to read its classes from
        shared = docs.sparkSession.sparkContext.broadcast(plain)
        parts.append(_find_udf(shared, threshold)(column(docs, text)))
    return F.concat(*parts) if parts else F.array().cast(_FOUND)


def contaminations(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, item_id, score, end_word) for every row and every item that its text contains.

    Items of fewer than `min_words` words are left out; `short_items` names them. Words are compared without case and punctuation. Null and empty texts and items contain nothing and are nowhere; items that
    repeat count once; repeated rows give repeated results; null ids are kept. Of passages with equal scores the first found stands.
    Other columns are not read, and an empty table on either side gives an empty result.
    """
    found = contained_items(docs, benchmark, **options)
    rows = docs.select(column(docs, "doc_id").cast("bigint").alias("doc_id"), found.alias("found"))
    return rows.select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.item_id", "f.score", "f.end_word")


def keep_clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Rows of `docs`, all columns unchanged, whose text contains no item. Rows with a null text stay."""
    name = free_name(docs, "items")
    judged = docs.withColumn(name, contained_items(docs, benchmark, **options))
    return judged.filter(F.size(name) == 0).drop(name)
