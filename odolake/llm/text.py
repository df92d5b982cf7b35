"""Words of whole texts as 64-bit hashes, computed in numpy over batches of UTF-8 bytes.

A word is a run of ASCII letters, digits and non-ASCII bytes of the lower-cased text. Work is done in slices of a few
MB that end between words, so memory does not follow the length of a text beyond its own bytes and 8 bytes a word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np

CHUNK_BYTES = 2 << 20
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_BYTE_VALUE = np.random.RandomState(17).randint(1, 2**63 - 1, 256).astype(np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX_A, _MIX_B = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix(values: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit values."""
    values = (values ^ (values >> np.uint64(33))) * _MIX_A
    values = (values ^ (values >> np.uint64(29))) * _MIX_B
    return values ^ (values >> np.uint64(32))


def lowered(text: str | None) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a byte array."""
    word = np.zeros(data.size + 2, dtype=np.int8)
    word[1:-1] = _IS_WORD[data]
    edges = np.flatnonzero(np.diff(word))
    return edges[0::2], edges[1::2]


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not starts.size:
        return np.empty(0, dtype=np.uint64)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    powers = np.full(int(lengths.max()), _ODD, dtype=np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    letters = data[place + np.repeat(starts, lengths)]
    return mix(np.add.reduceat(_BYTE_VALUE[letters] * powers[place], first) + lengths.astype(np.uint64))


def _slices(data: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    begin = 0
    while begin < data.size:
        end = min(begin + size, data.size)
        if end < data.size:
            gaps = np.flatnonzero(~_IS_WORD[data[begin:end]])
            if gaps.size:
                end = begin + int(gaps[-1]) + 1
            else:  # one word longer than a slice
                later = np.flatnonzero(~_IS_WORD[data[end:]])
                end = end + int(later[0]) if later.size else data.size
        yield begin, end
        begin = end


def chunked(texts: Sequence[str | None], size: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(first index, lower-cased bytes of the texts) in chunks of about `size` bytes; a long text is a chunk of its own."""
    first, held, total = 0, [], 0
    for i, text in enumerate(texts):
        data = lowered(text)
        if held and total + len(data) > size:
            yield first, held
            first, held, total = i, [], 0
        held.append(data)
        total += len(data) + 1
    if held:
        yield first, held


def word_chunks(texts: Sequence[str | None], each: Callable | None = None, size: int = CHUNK_BYTES) -> Iterator[tuple]:
    """(first index, bounds, hashes, values) by chunks of texts: the words of text first + k are bounds[k] to bounds[k + 1].

    `each` gives a value for every word of a slice from its bytes, starts and ends; without it the values are None.
    """
    for first, held in chunked(texts, size):
        data = np.frombuffer(b"\n".join(held) + b"\n", dtype=np.uint8)
        hashes, values, places = [], [], []
        for begin, end in _slices(data, 2 * size):
            starts, ends = word_spans(data[begin:end])
            hashes.append(hash_spans(data[begin:end], starts, ends))
            places.append(starts + begin)
            if each:
                values.append(each(data[begin:end], starts, ends))
        bounds = np.searchsorted(np.concatenate(places), np.cumsum([0, *(len(x) + 1 for x in held)]))
        yield first, bounds, np.concatenate(hashes), np.concatenate(values) if each else None


def word_hashes(texts: Sequence[str | None], size: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray]]:
    """(index of the text, hashes of its words in order) for every text."""
    for first, bounds, hashes, _ in word_chunks(texts, size=size):
        for i in range(bounds.size - 1):
            yield first + i, hashes[bounds[i]:bounds[i + 1]]


def shingle_hashes(words: np.ndarray, count: int) -> np.ndarray:
    """Hashes of the runs of `count` words; a shorter text has one shingle of all its words, an empty one has none."""
    count = min(count, words.size)
    if not count:
        return words
    total = np.zeros(words.size - count + 1, dtype=np.uint64)
    factor = np.uint64(1)
    with np.errstate(over="ignore"):
        for j in range(count):
            factor = factor * _ODD + np.uint64(2)
            total += words[j:j + total.size] * (factor | np.uint64(1))
        return mix(total + np.uint64(count))


def occurrence(values: np.ndarray) -> np.ndarray:
    """For every value, how many equal values stand before it."""
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    head = np.ones(values.size, dtype=bool)
    head[1:] = ranked[1:] != ranked[:-1]
    place = np.arange(values.size)
    out = np.empty(values.size, dtype=np.int64)
    out[order] = place - np.maximum.accumulate(np.where(head, place, 0))
    return out


def as_long(values: Iterable) -> np.ndarray:
    """Unsigned hashes as Spark's signed long."""
    return np.asarray(values, dtype=np.uint64).view(np.int64)
