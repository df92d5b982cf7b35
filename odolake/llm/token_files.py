"""Token files: the ids of all documents in directly addressable codes, written and read by Spark.

A file is a row of segments, each a magic word, its length, its place (part and number), a directory of its documents (id, first
place) and the codes of their ids. Segments hold whole documents and end once they have `segment_ids` ids; a file holds
at most SEGMENTS_PER_FILE of them, so the memory of a reading task is bounded by that and the longest document. Parts are
ranges of ascending document ids, and the number of ids before a segment comes from the directory of all segments.
"""

from __future__ import annotations

import os
import re
import string
import struct
import zlib
from array import array
from codecs import charmap_decode
from collections import deque
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.frames import lookup
from ..session import materialize
from .direct_codes import Codes, encode
from .tables import column, small_batches

END_ID = 2
SEGMENT_IDS = 1 << 20
SEGMENTS_PER_FILE = 16
CACHED_PIECES = 500_000  # pieces with other characters than letters whose ids a task remembers at a time
CACHED_CHARS = 40  # longer pieces are encoded where they stand
CHARS_AT_ONCE = 16 << 20  # of texts that are held together
WORDS_AT_ONCE = 10_000
PIECES_AT_ONCE = 100_000
_MAGIC = b"ODTK\x01\0\0\0"
_HEAD = "<8sQqqqq"  # magic, bytes, part, number, documents, ids
_HEAD_BYTES = struct.calcsize(_HEAD)
# fixed values of byte-level tokenizers: the words of a text, and the letters that stand for bytes
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_HIDDEN = [b for b in range(256) if b not in _SHOWN]
_BYTE_LETTERS = "".join(chr(b if b in _SHOWN else 256 + _HIDDEN.index(b)) for b in range(256))
_ENDS = string.punctuation.replace("'", "")  # after letters they are one word, which has no apostrophe
# letters in every version of Unicode, and what ends them
_LETTERS_AND_ENDS = f"^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+[{re.escape(_ENDS)}]*$"
_INNER_SPACE = re.compile(r"(?<=\S) (?=\S)")
_ROWS = "part int, number bigint, place bigint, doc_id bigint, first bigint, n_tokens bigint, ids_crc32 bigint, last_id bigint"


def _taken(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The runs of `ids` with the wanted numbers, one after the other."""
    counts = sizes[wanted]
    ends = np.cumsum(counts)
    return ids[np.repeat(starts[wanted] - ends + counts, counts) + np.arange(int(ends[-1]) if ends.size else 0)]


class PieceEncoder:
    """Ids of whole texts, with every different piece of the texts that are held together encoded by the library once.

    A text is cut at each single space between two characters that are no white space. A byte-level pre-tokenizer always
    begins a token with such a space, and merges stay inside its tokens, so the ids of the pieces are the ids of the text. Words of
    letters go to the library many at a time, behind a pre-tokenizer that cuts at spaces alone; other pieces are cut into words
    here and remembered. Tokenizers of another kind get whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        kind = repr(self.tokenizer.pre_tokenizer)
        self.cuts = kind.startswith("ByteLevel(") and "add_prefix_space=False" in kind and self.tokenizer.normalizer is None
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if self.cuts and hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # words are asked once, and the library never frees the cache of a tokenizer that has gone
        vocabulary = self.tokenizer.get_vocab()
        self.spaces = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)  # ids that begin with a space
        self.spaces[[i for token, i in vocabulary.items() if token.startswith(_BYTE_LETTERS[32])]] = True
        self.spaced = Tokenizer(self.tokenizer.model)
        self.spaced.pre_tokenizer = pre_tokenizers.Split(_BYTE_LETTERS[32], "merged_with_next")
        self.known: dict[str, bytes] = {}  # ids of pieces that follow a space and are no word of letters
        self.words: dict[str, bytes] = {}  # ids of words in them
        self.splits = regex.compile(WORD_PATTERN).findall

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            letters = charmap_decode(word.encode("utf-8", "surrogatepass"), "strict", _BYTE_LETTERS)[0]
            ids = self.words[word] = array("I", [t.id for t in self.tokenizer.model.tokenize(letters)]).tobytes()
        return ids

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece that follows a space."""
        ids = self.known.get(piece)
        if ids is None:
            if len(piece) > CACHED_CHARS:
                return self._whole(f" {piece}")
            ids = b"".join(map(self._word, self.splits(f" {piece}")))
            if piece and piece.strip() == piece:
                self.known[piece] = ids
        return ids

    def _letter_words(self, words: pa.Array) -> tuple[list[bytes], np.ndarray]:
        """Ids of words of letters that follow a space, and how many each has."""
        steps = np.append(np.arange(0, len(words), WORDS_AT_ONCE), len(words))
        joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(steps), words), pa.scalar(" ", pa.large_string()))
        ids, sizes = [], [np.empty(0, dtype=np.int64)]
        for text, count in zip(joined.to_pylist(), np.diff(steps).tolist(), strict=True):
            letters = charmap_decode(f" {text}".encode(), "strict", _BYTE_LETTERS)[0]
            (found,) = self.spaced.encode_batch_fast([letters], add_special_tokens=False)
            ids.append(np.array(found.ids, dtype=np.uint32))
            begins = np.flatnonzero(self.spaces[ids[-1]])  # a word's only space is its first letter
            if begins.size != count:
                raise ValueError("the tokenizer gives no id to a space")
            sizes.append(np.diff(begins, append=ids[-1].size))
        return [x.tobytes() for x in ids], np.concatenate(sizes)

    def _pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """(bounds of the texts, number of each piece, the different pieces)."""
        cut = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        bounds, pieces = np.asarray(cut.offsets), cut.flatten().dictionary_encode()
        numbers, names = np.asarray(pieces.indices), pieces.dictionary
        odd = np.flatnonzero(~np.asarray(pc.match_substring_regex(names, _LETTERS_AND_ENDS)))
        loose = np.zeros(len(names), dtype=bool)
        loose[odd] = [p.strip() != p or not p for p in names.take(pa.array(odd)).to_pylist()]
        if not loose.any():
            return bounds, numbers, names
        # a space beside other white space: such a text is cut at the single spaces only
        held = np.add.reduceat(loose[numbers], bounds[:-1], dtype=np.int64).tolist()
        parts = [_INNER_SPACE.split(text) if n else [] for text, n in zip(texts, held, strict=True)]
        more = pa.array(chain.from_iterable(parts), pa.large_string()).dictionary_encode()
        added = np.split(np.asarray(more.indices) + len(names), np.cumsum([len(p) for p in parts])[:-1])
        all_numbers = [new if new.size else numbers[a:b] for new, a, b in zip(added, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        return np.cumsum([0, *map(len, all_numbers)]), np.concatenate(all_numbers), pa.concat_arrays([names, more.dictionary])

    def _together(self, texts: list[str]) -> Iterator[np.ndarray]:
        whole = [not self.cuts or any(t in text for t in self.added) for text in texts]
        bounds, numbers, names = self._pieces(["" if w else text for w, text in zip(whole, texts, strict=True)])
        firsts = bounds[:-1]  # no space stands before the first piece of a text
        own = [self._whole(text if w else first) for w, text, first in zip(whole, texts, names.take(pa.array(numbers[firsts])).to_pylist(), strict=True)]
        numbers = numbers.astype(np.int64)
        numbers[firsts] = np.arange(len(names), len(names) + len(texts))
        used = np.bincount(numbers, minlength=len(names))[:len(names)] > 0
        letters = used & np.asarray(pc.match_substring_regex(names, _LETTERS_AND_ENDS))
        odd = np.flatnonzero(used & ~letters)
        plain = names.filter(pa.array(letters))
        words, ends = pc.utf8_rtrim(plain, _ENDS).dictionary_encode(), pc.replace_substring_regex(plain, f"[^{re.escape(_ENDS)}]+", "").dictionary_encode()
        if len(self.known) > CACHED_PIECES:
            self.known, self.words = {}, {}
        data, sizes = self._letter_words(words.dictionary)
        rest = [*map(self._word, ends.dictionary.to_pylist()), *map(self._piece, names.take(pa.array(odd)).to_pylist()), *own, b""]
        sizes = np.concatenate([sizes, np.array([*map(len, rest)]) // 4])
        # a piece is a run of ids and one that ends it: the last one is empty
        runs = np.full((len(names) + len(texts), 2), sizes.size - 1)
        at = len(words.dictionary)
        runs[:len(names)][letters] = np.column_stack([np.asarray(words.indices), np.asarray(ends.indices) + at])
        at += len(ends.dictionary)
        runs[odd, 0] = np.arange(at, at + odd.size)
        runs[len(names):, 0] = np.arange(at + odd.size, sizes.size - 1)
        ids = _taken(np.frombuffer(b"".join([*data, *rest]), np.uint32), np.cumsum(sizes) - sizes, sizes, runs.ravel())
        sizes = sizes[runs].sum(axis=1)
        starts = np.cumsum(sizes) - sizes
        begin = 0
        while begin < len(texts):  # a bounded number of pieces at a time, or one text
            end = max(begin + 1, int(np.searchsorted(bounds, bounds[begin] + PIECES_AT_ONCE, "right")) - 1)
            some = numbers[bounds[begin]:bounds[end]]
            places = np.append(0, np.cumsum(sizes[some]))[bounds[begin + 1:end] - bounds[begin]]
            yield from np.split(_taken(ids, starts, sizes, some), places)
            begin = end

    def encode(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """Ids of each text."""
        held, chars = [], 0
        for text in texts:
            held.append(text)
            chars += len(text)
            if chars >= CHARS_AT_ONCE:
                yield from self._together(held)
                held, chars = [], 0
        if held:
            yield from self._together(held)


class Segment:
    """Documents and codes of one segment. `token` reads a single id without decoding others."""

    def __init__(self, data: bytes, at: int):
        magic, size, self.part, self.number, documents, self.ids = struct.unpack_from(_HEAD, data, at)
        if magic != _MAGIC or at + size > len(data):
            raise ValueError("not a whole segment of a token file")
        at += _HEAD_BYTES
        self.doc_ids = np.frombuffer(data, "<i8", documents, at)
        self.firsts = np.frombuffer(data, "<u8", documents + 1, at + 8 * documents).astype(np.int64)
        at += 8 * (2 * documents + 1)
        self.null_ids = np.frombuffer(data, np.uint8, documents, at).astype(bool)
        self.codes = Codes(data, at + documents + -documents % 8)
        self.end = self.codes.end

    def token(self, document: int, place: int) -> int:
        """The id at `place` of the document with that index."""
        if not 0 <= place < self.firsts[document + 1] - self.firsts[document]:
            raise IndexError("place out of the document")
        return self.codes[int(self.firsts[document]) + place]


def segment_bytes(part: int, number: int, doc_ids: list[int | None], arrays: list[np.ndarray]) -> bytes:
    n = len(doc_ids)
    firsts = np.cumsum([0, *(a.size for a in arrays)])
    nulls = bytes(x is None for x in doc_ids)
    codes = encode(np.concatenate(arrays) if arrays else np.empty(0, dtype=np.uint64))
    body = (np.array([x or 0 for x in doc_ids], dtype="<i8").tobytes() + firsts.astype("<u8").tobytes() + nulls + b"\0" * (-n % 8) + codes)
    return struct.pack(_HEAD, _MAGIC, _HEAD_BYTES + len(body), part, number, n, int(firsts[-1])) + body


def open_segments(data: bytes) -> Iterator[Segment]:
    """Segments of a file's bytes; each is followed by one line end."""
    at = 0
    while at < len(data):
        segment = Segment(data, at)
        yield segment
        at = segment.end + 1


def _segment_rows(path: str, end_id: int, segment_ids: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        encoder, part, number = PieceEncoder(path), TaskContext.get().partitionId(), 0
        keys, doc_ids, arrays, held = deque(), [], [], 0

        def texts() -> Iterator[str]:
            for batch in batches:
                keys.extend(None if null else key for key, null in zip(batch["key"].tolist(), batch["unnumbered"], strict=True))
                yield from batch["text"].tolist()

        for ids in encoder.encode(texts()):
            doc_ids.append(keys.popleft())
            arrays.append(np.append(ids, np.uint32(end_id)))
            held += ids.size + 1
            if held >= segment_ids:
                yield pd.DataFrame({"value": [segment_bytes(part, number, doc_ids, arrays)]})
                doc_ids, arrays, held, number = [], [], 0, number + 1
        if doc_ids:
            yield pd.DataFrame({"value": [segment_bytes(part, number, doc_ids, arrays)]})
    return run


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, segment_ids: int = SEGMENT_IDS) -> None:
    """Write the ids of every whole text of (doc_id, text), each followed by `end_id`, as token files in `folder`.

    Documents follow each other in ascending doc_id; null ids come first and repeated ids are in the order of their text's hash.
    A null text is empty and has the end id alone. An empty table gives files without segments. A special token's string in a text
    gets the special token's id, as the library does by default. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(column(docs, "doc_id").cast("bigint").alias("doc_id"), F.coalesce(column(docs, "text"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", F.xxhash64("text").alias("tie"))
    dealt = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    keyed = dealt.select(F.coalesce("doc_id", F.lit(0)).alias("key"), F.col("doc_id").isNull().alias("unnumbered"), "text")
    (keyed.mapInPandas(_segment_rows(tokenizer, end_id, segment_ids), "value binary").select(F.col("value").cast("string").alias("value"))
     .write.option("lineSep", "\n").option("maxRecordsPerFile", SEGMENTS_PER_FILE).text(folder))


def _document_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [field.split()[0] for field in _ROWS.split(", ")]
    for batch in batches:
        for data in batch["content"]:
            for s in open_segments(bytes(data)):
                ids = s.codes.decode().astype("<u4")
                sums = [zlib.crc32(ids[a:b]) for a, b in zip(s.firsts, s.firsts[1:])]
                n = np.diff(s.firsts)
                out = pd.DataFrame({"part": np.int32(s.part), "number": s.number, "place": np.arange(n.size), "doc_id": pd.array(s.doc_ids, dtype="Int64"),
                                    "first": s.firsts[:-1], "n_tokens": n, "ids_crc32": np.array(sums, dtype=np.int64),
                                    "last_id": s.codes.take(s.firsts[1:] - 1).astype(np.int64)})
                out.loc[s.null_ids, "doc_id"] = pd.NA
                yield out[names]


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, last_id) of every document of the token files.

    `start` counts the ids of all documents before it, ids_crc32 is the crc32 of its ids as little-endian 32-bit integers,
    and last_id is read by its place alone, through the levels. A cut or foreign file raises ValueError.
    """
    rows = materialize(_files(spark, folder).select("content").mapInPandas(_document_rows, _ROWS))
    # a part has some segments, so a window adds them up; the ids before a part need one number a part
    order = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    segments = materialize(rows.groupBy("part", "number").agg(F.sum("n_tokens").alias("n")).withColumn(
        "within", F.coalesce(F.sum("n").over(order), F.lit(0))))
    before, starts = 0, []
    for part, n in sorted(segments.groupBy("part").agg(F.sum("n")).toLocalIterator()):
        starts.append((part, before))
        before += n
    parts = spark.createDataFrame(starts, "part int, earlier bigint")
    directory = segments.join(F.broadcast(parts), "part").select("part", "number", (F.col("earlier") + F.col("within")).alias("before"))
    found = lookup(rows, directory, ["part", "number"])
    return found.select("doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32", "last_id")
