"""I-Match fingerprints: hashes of the terms in a band of inverse document frequency, for random parts of that lexicon.

The lexicon holds the terms whose document frequency lies in [LOW, HIGH] of all rows. It has at most (mean distinct terms
of a text / LOW) terms whatever the number of texts, so it is broadcast. A fingerprint is the hash of a text's sorted distinct
terms of the lexicon, followed by the hashes of what is left of them in random subsets of the lexicon. Subsets keep 1/16,
1/64, 1/256 and 1/1024 of it, so long and short texts each have subsets that a few edits leave untouched.
"""

from __future__ import annotations

import bisect
import hashlib
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import column, small_batches
from .text import as_long, mix, word_hashes

LOW, HIGH = 0.002, 0.2
SCALES = (1 / 1024, 1 / 256, 1 / 64, 1 / 16)  # shares of the lexicon, sparsest first
SUBSETS = 24  # of each share
ENOUGH = 12  # subsets with a term on either side that a likeness rests on, where there are so many
_DIGITS = 6
_SEEDS = np.random.RandomState(53).randint(1, 2**63 - 1, SUBSETS).astype(np.uint64)
_OUT = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double")
_FIRST = -(1 << 63)


class Print(NamedTuple):
    whole: str
    parts: np.ndarray  # (scales, subsets), 0 for a subset without a term

    def __str__(self) -> str:
        return self.whole + "".join(f"{x:0{_DIGITS}x}" for x in self.parts.ravel().tolist())


def fingerprint(words: np.ndarray, lexicon: np.ndarray) -> Print:
    """Fingerprint of a text's word hashes; a text without a term of the (sorted) lexicon is taken with all its terms."""
    terms = np.unique(words)
    if terms.size and lexicon.size:
        at = np.minimum(np.searchsorted(lexicon, terms), lexicon.size - 1)
        known = terms[lexicon[at] == terms]
        terms = known if known.size else terms
    whole = hashlib.sha1(terms.tobytes()).hexdigest()[:16]
    draws = mix(terms[None, :] ^ _SEEDS[:, None])
    values = mix(terms + np.uint64(1))
    parts = np.zeros((len(SCALES), SUBSETS), dtype=np.uint64)
    for i, share in enumerate(SCALES):
        kept = draws < np.uint64(int(share * 2.0**64))
        total = mix(np.where(kept, values, np.uint64(0)).sum(axis=1, dtype=np.uint64)) >> np.uint64(64 - 4 * _DIGITS)
        parts[i] = np.where(kept.any(axis=1), np.maximum(total, np.uint64(1)), np.uint64(0))
    return Print(whole, parts)


def likeness(a: Print, b: Print) -> float:
    """Share of equal hashes among the sparsest subsets that hold a term of either text; 1 for equal term sets."""
    if a.whole == b.whole:
        return 1.0
    equal = seen = 0
    for x, y in zip(a.parts, b.parts, strict=True):
        used = (x != 0) | (y != 0)
        equal += int((x[used] == y[used]).sum())
        seen += int(used.sum())
        if seen >= ENOUGH:
            break
    return equal / seen if seen else 0.0


def _term_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [np.unique(words) for _, words in word_hashes(batch["text"].tolist())]
        terms, counts = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0), np.empty(0))
        yield pd.DataFrame({"term": as_long(terms), "n": counts.astype(np.int64)})


def lexicon(docs: DataFrame, text: str = "text", low: float = LOW, high: float = HIGH) -> np.ndarray:
    """Sorted hashes of the terms that stand in `low` to `high` of all rows, counted over the whole texts of all rows."""
    rows = docs.select(column(docs, text).alias("text"))
    total = rows.count()
    counts = rows.mapInPandas(_term_counts, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    band = counts.filter((F.col("n") >= low * total) & (F.col("n") <= high * total)).select("term").toPandas()
    return np.sort(band["term"].to_numpy(np.int64).view(np.uint64))


def _edited_rows(terms):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = terms.value

        def prints(texts: list[str]) -> list[Print]:
            return [fingerprint(words, known) for _, words in word_hashes(texts)]

        held = None  # the last row of the batch before: chunk, doc_id, text, fingerprint
        for batch in batches:
            texts = [zlib.decompress(bytes(x)).decode("utf-8", "surrogatepass") for x in batch["packed"]]
            rows = list(zip(batch["chunk"], batch["doc_id"], texts, prints(texts), batch["ends"], strict=True))
            rows = ([held] if held else []) + rows
            held = rows[-1]
            pairs = [(a, b) for a, b in zip(rows, rows[1:]) if a[0] == b[0] and not a[4]]
            edited = [a[2][:len(a[2]) - len(a[2]) // 4] + b[2][:len(a[2]) // 4] for a, b in pairs]
            out = [(a[1], len(a[2]), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), str(a[3]), str(p),
                    likeness(a[3], p), likeness(a[3], b[3]))
                   for (a, b), e, p in zip(pairs, edited, prints(edited), strict=True)]
            yield pd.DataFrame(out, columns=[f.split()[0] for f in _OUT.split(", ")]).astype({"doc_id": "Int64", "n_chars": "int64"})
    return run


def fingerprints(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """A row per document with the fingerprints of its text and of its edited text, and their likeness.

    The edited text has the last quarter of the code points (rounded down) replaced by as many first ones of the next document in
    ascending doc_id, or all it has; after the last comes the first. Null texts count as empty. Repeated ids follow each
    other in the order of their text's hash, null ids come first. Texts without words have the fingerprint of no terms. An
    empty table gives an empty result; other columns are not read.

    Documents are dealt into chunks of consecutive ids. Each chunk also gets the first document of the next one, so one shuffle
    brings every text beside its successor, packed, and no task holds more than a batch.
    """
    spark = docs.sparkSession
    small_batches(spark)
    terms = spark.sparkContext.broadcast(lexicon(docs, low=low, high=high))
    rows = docs.select(column(docs, "doc_id").cast("bigint").alias("doc_id"), F.coalesce(column(docs, "text"), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.coalesce("doc_id", F.lit(_FIRST)))
    chunks = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = F.array(*[F.lit(i / chunks) for i in range(1, chunks)])
    bounds = sorted(set(rows.agg(F.percentile_approx("key", shares, 20 * chunks)).first()[0] or []))

    @F.pandas_udf("int")
    def chunk_of(keys: pd.Series) -> pd.Series:
        return pd.Series([bisect.bisect_left(bounds, x) for x in keys], dtype="int32")

    @F.pandas_udf("binary")
    def pack(texts: pd.Series) -> pd.Series:
        return pd.Series([zlib.compress(t.encode("utf-8", "surrogatepass"), 1) for t in texts], dtype=object)

    firsts = sorted((r["chunk"], r["key"]) for r in
                    rows.select("key", chunk_of("key").alias("chunk")).groupBy("chunk").agg(F.min("key").alias("key")).collect())
    after = [(key, firsts[i - 1][0]) for i, (_, key) in enumerate(firsts)]  # a chunk's first document ends the chunk before
    ends = spark.createDataFrame(after, "key bigint, chunk int")  # one row per chunk
    heads = rows.join(F.broadcast(ends), "key").groupBy("key", "chunk").agg(
        F.min_by("doc_id", F.xxhash64("text")).alias("doc_id"), F.min_by("text", F.xxhash64("text")).alias("text"))
    columns = ["chunk", "ends", "key", "doc_id", F.xxhash64("text").alias("h"), pack("text").alias("packed")]
    every = rows.withColumn("chunk", chunk_of("key")).withColumn("ends", F.lit(False)).select(*columns).unionByName(
        heads.withColumn("ends", F.lit(True)).select(*columns))
    dealt = every.repartition("chunk").sortWithinPartitions("chunk", "ends", "key", "h")
    return dealt.select("chunk", "ends", "doc_id", "packed").mapInPandas(_edited_rows(terms), _OUT)
