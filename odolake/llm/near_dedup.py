"""Near duplicates by Order MinHash, verified by banded alignment.

A text is the sequence of its runs of five words. Each run is labelled with how often it stood before, so repeated runs
differ. A sketch takes the `width` least labelled runs under one hash function and keeps them in text order; equal
sketches need the same runs in the same order, so their chance follows edit similarity. Candidates share a sketch; they
are linked if an alignment within the diagonal band that the threshold leaves keeps at least `threshold` of their runs:
kept / (runs of both - kept), over labelled runs, so a text is not like itself written twice.

Equal texts are one class by their digest and take part once. The members of a bucket of equal sketches are compared with
one leader, the text that meets the most others, which settles most buckets at a cost that follows their size. In a bucket
that still holds more than one class every pair of different classes is judged: its texts meet in pairs of blocks of bounded
size, a task each, that give links only. No bucket, text or partner is left out for its number, so the classes are those of all
candidate pairs.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .components import components
from .tables import column, free_name, small_batches
from .text import as_long, mix, occurrence, shingle_hashes, word_hashes

SHINGLE_WORDS = 5
THRESHOLD = 0.8
SKETCHES = 12
WIDTH = 2
BLOCK_TEXTS = 512  # of a bucket that meet another block in one task
BLOCK_CHARS = 8 << 20
_JUDGED = "member string, leader string, similar boolean"
_SEEDS = np.random.RandomState(29).randint(1, 2**63 - 1, 256).astype(np.uint64)


def labelled_runs(words: np.ndarray, shingle: int) -> np.ndarray:
    """Hashes of the runs in text order, each with how often it stood before: no two of a text are equal."""
    runs = shingle_hashes(words, shingle)
    return mix(runs + occurrence(runs).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) if runs.size else runs


def order_sketches(words: np.ndarray, shingle: int, sketches: int, width: int) -> np.ndarray:
    """One hash per sketch of the `width` least labelled runs in text order; empty for a text without words."""
    labelled = labelled_runs(words, shingle)
    if not labelled.size:
        return labelled
    width = min(width, labelled.size)
    out = np.empty(sketches, dtype=np.uint64)
    block = max(1, 2_000_000 // labelled.size)
    for begin in range(0, sketches, block):
        seeds = _SEEDS[begin:min(begin + block, sketches)]
        values = mix(labelled[None, :] ^ seeds[:, None])
        least = np.sort(np.argpartition(values, width - 1, axis=1)[:, :width], axis=1)
        total = np.zeros(seeds.size, dtype=np.uint64)
        for j in range(width):
            total = mix(total * np.uint64(31) + np.take_along_axis(values, least[:, j:j + 1], axis=1)[:, 0])
        out[begin:begin + seeds.size] = total
    return out


def aligned_similarity(a: np.ndarray, b: np.ndarray, threshold: float) -> float:
    """Share of the labelled runs that an order-keeping alignment within the band keeps; 0 outside the band."""
    if not a.size or not b.size or min(a.size, b.size) < threshold * max(a.size, b.size):
        return 0.0
    _, in_a, in_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    order = np.argsort(in_a)
    in_a, in_b = in_a[order], in_b[order]
    band = (a.size + b.size) * (1 - threshold) / (1 + threshold)  # more runs than this cannot be left out
    path = in_b[np.abs(in_a - in_b) <= band]
    if path.size > 1 and np.any(np.diff(path) < 0):
        tails: list[int] = []
        for x in path.tolist():
            at = bisect_left(tails, x)
            tails[at:at + 1] = [x]
        kept = len(tails)
    else:
        kept = path.size
    return kept / (a.size + b.size - kept)


def _sketch_rows(shingle: int, sketches: int, width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [as_long(order_sketches(words, shingle, sketches, width)) for _, words in word_hashes(batch["text"].tolist())]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text_key": batch["text_key"], "sketch": rows})
    return run


def _judge_rows(shingle: int, threshold: float):
    def runs(texts: list[str]) -> list[np.ndarray]:
        return [labelled_runs(words, shingle) for _, words in word_hashes(texts)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            known = list(dict.fromkeys(batch["leader_text"]))
            leaders = dict(zip(known, runs(known), strict=True))
            members = runs(batch["member_text"].tolist())
            similar = [aligned_similarity(x, leaders[t], threshold) >= threshold
                       for x, t in zip(members, batch["leader_text"], strict=True)]
            yield batch[["member", "leader"]].assign(similar=similar)
    return run


def block_links(runs: list[np.ndarray], labels: np.ndarray, sketch: np.ndarray, start: int, left: np.ndarray, right: np.ndarray | None,
                threshold: float) -> list[tuple[int, int]]:
    """Links that join the classes of the texts at `left` and at `right`, or of all pairs at `left` without `right`.

    Every pair of different labels is judged in the bucket of the first sketch that it shares; labels that a link joins are one from then on.
    Common runs are counted for all partners of a text at once, and only pairs that could reach the threshold are aligned.
    """
    sizes, labels = np.array([r.size for r in runs]), labels.copy()
    ids = np.split(np.unique(np.concatenate(runs), return_inverse=True)[1], np.cumsum(sizes)[:-1])
    marked, found = np.zeros(int(sizes.sum()), dtype=np.uint8), []
    for at, i in enumerate(left.tolist()):
        asked = left[at + 1:] if right is None else right
        asked = asked[labels[asked] != labels[i]]
        asked = asked[np.minimum(sizes[asked], sizes[i]) >= threshold * np.maximum(sizes[asked], sizes[i])]
        asked = asked[~(sketch[asked, :start] == sketch[i, :start]).any(axis=1)]
        if not asked.size:
            continue
        marked[ids[i]] = 1
        ends = np.cumsum(sizes[asked])
        common = np.add.reduceat(marked[np.concatenate([ids[j] for j in asked.tolist()])], ends - sizes[asked], dtype=np.int64)
        marked[ids[i]] = 0
        for j in asked[common / (sizes[i] + sizes[asked] - common) >= threshold].tolist():
            if labels[j] != labels[i] and aligned_similarity(runs[i], runs[j], threshold) >= threshold:
                found.append((i, j))
                labels[labels == labels[j]] = labels[i]
    return found


def _block_rows(shingle: int, threshold: float):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        first, last, start = (int(group[c].iloc[0]) for c in ("first_block", "last_block", "start"))
        runs = [labelled_runs(words, shingle) for _, words in word_hashes(group["text"].tolist())]
        own = group["block"].to_numpy()
        links = block_links(runs, pd.factorize(group["label"])[0], np.stack(group["sketch"].tolist()), start,
                            np.flatnonzero(own == first), None if first == last else np.flatnonzero(own == last), threshold)
        keys = group["text_key"].tolist()
        return pd.DataFrame([(keys[i], keys[j]) for i, j in links], columns=["member", "leader"])
    return run


def _rest_links(rest: DataFrame, reps: DataFrame, texts: DataFrame, shingle: int, threshold: float) -> DataFrame | None:
    """(member, leader) links between the classes that (bucket, start, text_key, label) still holds in one bucket; None if there are none."""
    rest = materialize(rest.join(texts.select("text_key", "chars"), "text_key"))
    blocks = materialize(rest.groupBy("bucket").agg(
        F.min("label").alias("a"), F.max("label").alias("b"), F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars")).filter("a != b").select(
        "bucket", F.ceil(F.greatest(F.col("n") / BLOCK_TEXTS, F.col("chars") / BLOCK_CHARS)).cast("int").alias("blocks")))
    if blocks.isEmpty():
        return None
    dealt = (rest.drop("chars").join(blocks, "bucket").withColumn("block", F.expr("cast(pmod(xxhash64(text_key, bucket), blocks) as int)"))
             .join(reps.select("text_key", "sketch"), "text_key").join(texts.select("text_key", "text"), "text_key")
             .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
             .withColumn("first_block", F.least("block", "other")).withColumn("last_block", F.greatest("block", "other")).drop("blocks", "other"))
    return materialize(dealt.groupBy("bucket", "first_block", "last_block").applyInPandas(
        _block_rows(shingle, threshold), "member string, leader string"))


def _roots(reps: DataFrame, rows: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """(node, root) of the digests that are linked to another one."""
    entries = materialize(reps.select("text_key", F.posexplode("sketch").alias("start", "value")).select(
        F.xxhash64("start", "value").alias("bucket"), "start", "text_key"))
    sizes = materialize(entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    met = materialize(entries.join(sizes, "bucket"))
    # the original of many copies agrees with most of them: it meets the most texts, and leads
    rank = materialize(met.groupBy("text_key").agg(F.sum("n").alias("rank")))
    met = materialize(met.join(rank, "text_key").select("bucket", "start", "text_key", "rank"))
    leaders = materialize(met.groupBy("bucket").agg(F.max(F.struct("rank", "text_key")).alias("top")).select("bucket", F.col("top.text_key").alias("leader")))
    members = materialize(met.join(leaders, "bucket").filter("text_key != leader").select("bucket", "start", F.col("text_key").alias("member"), "leader"))
    wanted = materialize(reps.select("text_key", F.col("rep_id").alias("doc_id")).join(rank.select("text_key"), "text_key"))
    same = (rows["text_key"] == wanted["text_key"]) & rows["doc_id"].eqNullSafe(wanted["doc_id"])
    texts = materialize(rows.join(wanted, same).select(rows["text_key"], rows["text"], F.length(rows["text"]).alias("chars")).dropDuplicates(["text_key"]))
    sided = (members.select("member", "leader").distinct()
             .join(texts.select(F.col("text_key").alias("member"), F.col("text").alias("member_text")), "member")
             .join(texts.select(F.col("text_key").alias("leader"), F.col("text").alias("leader_text")), "leader"))
    links = materialize(sided.mapInPandas(_judge_rows(shingle, threshold), _JUDGED)).filter("similar").select("member", "leader")
    roots = materialize(components(links, "member", "leader"))
    # the leaders have met all of their bucket and are done with; what else it holds is one class, or meets in blocks
    rest = members.join(roots.withColumnRenamed("node", "member"), "member", "left").select(
        "bucket", "start", F.col("member").alias("text_key"), F.coalesce("root", "member").alias("label"))
    more = _rest_links(rest, reps, texts, shingle, threshold)
    if more is None:
        return roots
    return components(roots.select(F.col("node").alias("member"), F.col("root").alias("leader")).unionByName(more), "member", "leader")


def _classed(docs: DataFrame, shingle: int, threshold: float, sketches: int, width: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_key) of all rows with a text, and (text_key, rep_id, root) of the different texts."""
    small_batches(docs.sparkSession)
    rows = docs.select(column(docs, "doc_id").cast("bigint").alias("doc_id"), column(docs, "text").alias("text"),
                       F.md5(column(docs, "text")).alias("text_key")).filter(F.col("text").isNotNull())
    keyed = materialize(rows.mapInPandas(_sketch_rows(shingle, sketches, width),
                                         "doc_id bigint, text_key string, sketch array<bigint>"))
    reps = materialize(keyed.groupBy("text_key").agg(F.min("doc_id").alias("rep_id"), F.first("sketch").alias("sketch")))
    roots = _roots(reps, rows, shingle, threshold)
    texts = reps.select("text_key", "rep_id").join(roots.withColumnRenamed("node", "text_key"), "text_key", "left")
    return keyed.select("doc_id", "text_key"), materialize(texts.withColumn("root", F.coalesce("root", "text_key")))


def near_classes(docs: DataFrame, *, shingle: int = SHINGLE_WORDS, threshold: float = THRESHOLD,
                 sketches: int = SKETCHES, width: int = WIDTH) -> DataFrame:
    """(doc_id, class_id) of every row; class_id is the least doc_id of the class.

    Classes are the connected components of links between texts. Equal texts, empty ones too, are one class; a text
    without words equals only itself, and a null text is a class of its own. Rows that repeat give repeated rows. Null
    ids are kept and never become a class id unless all ids of the class are null. An empty table gives an empty result.
    Other columns are not read.
    """
    rows, texts = _classed(docs, shingle, threshold, sketches, width)
    least = texts.groupBy("root").agg(F.min("rep_id").alias("class_id"))
    known = materialize(texts.join(least, "root").select("text_key", "class_id"))
    alone = docs.filter(column(docs, "text").isNull()).select(column(docs, "doc_id").cast("bigint").alias("doc_id"))
    return rows.join(known, "text_key").select("doc_id", "class_id").unionByName(
        alone.select("doc_id", F.col("doc_id").alias("class_id")))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """Rows of `docs`, all columns unchanged, with one row of each class: that of the least doc_id.

    Null texts are all kept. Of rows that repeat one id and text, one is kept.
    """
    spec = {"shingle": SHINGLE_WORDS, "threshold": THRESHOLD, "sketches": SKETCHES, "width": WIDTH} | options
    rows, texts = _classed(docs, **spec)
    chosen = (texts.groupBy("root").agg(F.min(F.struct(F.col("rep_id").isNull().alias("last"), "rep_id", "text_key")).alias("kept"))
              .select("kept.text_key", "kept.rep_id"))
    key, left, id_ = free_name(docs, "key"), free_name(docs, "kept_key"), free_name(docs, "kept_id")
    chosen = materialize(chosen.select(F.col("text_key").alias(left), F.col("rep_id").alias(id_)))
    keyed = docs.withColumn(key, F.md5(column(docs, "text")))
    same = (F.col(key) == F.col(left)) & column(keyed, "doc_id").cast("bigint").eqNullSafe(F.col(id_))
    kept = keyed.join(chosen, same).drop(left, id_)
    repeated = materialize(rows.groupBy("text_key", "doc_id").count().filter("count > 1").select(F.col("text_key").alias(left)).distinct())
    if not repeated.isEmpty():
        kept = (kept.join(repeated, F.col(key) == F.col(left), "left_anti")
                .unionByName(kept.join(repeated, F.col(key) == F.col(left), "left_semi").dropDuplicates([key])))
    return kept.drop(key).unionByName(docs.filter(column(docs, "text").isNull()))
