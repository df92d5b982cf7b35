"""Directly addressable codes: integers cut into chunk levels with continuation bitmaps and rank directories.

Level 0 holds the lowest chunk of every value. A bit per chunk says whether the value goes on, and the values that go on have
their next chunk in level 1, in the same order, and so on. The chunk of the value at place i of a level therefore stands at
place rank(i) of the next one, where rank counts the set bits before i; a directory with the count before every 512 bits
makes that a lookup and at most eight population counts. Any value is read that way without decoding its neighbours.

Layout, little endian: u64 count, u32 levels, u8 widths padded to a multiple of 8 bytes, then for each level u64 count, the
packed chunks, and for all but the last the bitmap in 64-bit words and the directory in 32-bit counts; every part is padded
to 8 bytes.
"""

from __future__ import annotations

import struct

import numpy as np

BLOCK_BITS = 512
_WORDS = BLOCK_BITS // 64
STEP = 4  # chunk widths are multiples of it
_HEAD = "<QI"
_HEAD_BYTES = struct.calcsize(_HEAD)


def _padded(data: bytes) -> bytes:
    return data + b"\0" * (-len(data) % 8)


def _aligned(size: int) -> int:
    return size + -size % 8


def best_widths(values: np.ndarray) -> tuple[int, ...]:
    """Chunk widths with the least total size: a shortest path over the bit lengths of the values."""
    longest = int(values.max()).bit_length() if values.size else 0
    top = max(STEP, longest + -longest % STEP)
    longer = [np.count_nonzero(values >= values.dtype.type(1 << b)) if b else values.size for b in range(0, top, STEP)]  # values that reach level bit b
    flag = 1 + 32 / BLOCK_BITS
    best: list[tuple[float, tuple[int, ...]]] = [(0.0, ())] * (len(longer) + 1)
    for i in range(len(longer) - 1, -1, -1):
        best[i] = min((longer[i] * ((j - i) * STEP + (flag if j < len(longer) else 0)) + best[j][0], ((j - i) * STEP, *best[j][1]))
                      for j in range(i + 1, len(longer) + 1))
    return best[0][1]


def _pack(chunks: np.ndarray, width: int) -> bytes:
    low = np.ascontiguousarray(chunks.view(np.uint8).reshape(-1, chunks.itemsize)[:, :-(-width // 8)])
    if width % 8 == 0:
        return low.tobytes()
    parts = np.empty((len(low), 2 * low.shape[1]), dtype=np.uint8)
    parts[:, 0::2], parts[:, 1::2] = low & 15, low >> 4
    parts = parts[:, :width // 4].ravel()
    parts = np.append(parts, np.zeros(parts.size % 2, dtype=np.uint8))
    return (parts[0::2] | parts[1::2] << 4).tobytes()


def encode(values: np.ndarray, widths: tuple[int, ...] | None = None) -> bytes:
    """The codes of unsigned integers below 2**60; `widths` are multiples of 4 that together hold the largest."""
    values = np.asarray(values)
    values = values.astype("<u4" if values.dtype == np.uint32 else "<u8", copy=False)
    widths = widths or best_widths(values)
    if any(w <= 0 or w % STEP for w in widths) or (values.size and int(values.max()) >> sum(widths)):
        raise ValueError("chunk widths must be multiples of 4 that hold the largest value")
    if max(widths) > 8 * values.itemsize:
        values = values.astype("<u8")
    whole = values.dtype.type
    out = [_padded(struct.pack(_HEAD, values.size, len(widths)) + bytes(widths))]
    for level, width in enumerate(widths):
        out.append(struct.pack("<Q", values.size) + _padded(_pack(values & whole((1 << width) - 1), width)))
        if level < len(widths) - 1:
            values = values >> whole(width)
            more = values > 0
            bits = np.zeros(_aligned(-(-more.size // 8)), dtype=np.uint8)
            packed = np.packbits(more, bitorder="little")
            bits[:packed.size] = packed
            counts = np.bitwise_count(bits.view("<u8")).astype(np.int64)
            before = np.cumsum(counts) - counts
            out.append(bits.tobytes() + _padded(before[::_WORDS].astype("<u4").tobytes()))
            values = values[more]
    return b"".join(out)


class Codes:
    """Read access to encoded values; nothing is decoded before it is asked for."""

    def __init__(self, data: bytes, at: int = 0):
        self.size, levels = struct.unpack_from(_HEAD, data, at)
        self.widths = tuple(data[at + _HEAD_BYTES:at + _HEAD_BYTES + levels])
        at += _aligned(_HEAD_BYTES + levels)
        self._levels = []
        for level, width in enumerate(self.widths):
            (count,) = struct.unpack_from("<Q", data, at)
            size = -(-count * width // 8)
            chunks = np.frombuffer(data, np.uint8, size, at + 8)
            at += 8 + _aligned(size)
            words = ranks = None
            if level < levels - 1:
                n = _aligned(-(-count // 8)) // 8
                words = np.frombuffer(data, "<u8", n, at)
                ranks = np.frombuffer(data, "<u4", -(-n // _WORDS), at + 8 * n)
                at += 8 * n + _aligned(4 * ranks.size)
            self._levels.append((count, chunks, words, ranks))
        self.end = at

    def take(self, places: np.ndarray) -> np.ndarray:
        """Values at the places, read one by one through the levels."""
        places = np.asarray(places, dtype=np.int64)
        if places.size and not (0 <= places.min() and places.max() < self.size):
            raise IndexError("place out of range")
        out, asked, shift = np.zeros(places.size, dtype=np.uint64), np.arange(places.size), 0
        for width, (_, chunks, words, ranks) in zip(self.widths, self._levels, strict=True):
            first = places * width
            found = np.zeros(places.size, dtype=np.uint64)
            for k in range(width // 8 + 1):
                byte = (first >> 3) + k
                held = np.where(byte < chunks.size, chunks[np.minimum(byte, chunks.size - 1)], 0) if chunks.size else np.zeros_like(byte)
                found |= held.astype(np.uint64) << np.uint64(8 * k)
            out[asked] |= (found >> (first & 7).astype(np.uint64) & np.uint64((1 << width) - 1)) << np.uint64(shift)
            shift += width
            if words is None or not places.size:
                break
            goes = (words[places >> 6] >> (places & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            places, asked = self._rank(places[goes], words, ranks), asked[goes]
        return out

    @staticmethod
    def _rank(places: np.ndarray, words: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        """How many bits are set before each place."""
        block = places // BLOCK_BITS
        total = ranks[block].astype(np.int64)
        for k in range(_WORDS):
            word = block * _WORDS + k
            bits = np.clip(places - word * 64, 0, 64)
            mask = np.where(bits == 64, ~np.uint64(0), (np.uint64(1) << np.minimum(bits, 63).astype(np.uint64)) - np.uint64(1))
            total += np.bitwise_count(words[np.minimum(word, words.size - 1)] & np.where(bits > 0, mask, np.uint64(0))).astype(np.int64)
        return total

    def __getitem__(self, place: int) -> int:
        return int(self.take(np.array([place]))[0])

    def decode(self) -> np.ndarray:
        """All values."""
        below = None
        for width, (count, chunks, words, _) in reversed(list(zip(self.widths, self._levels, strict=True))):
            if width % 8 == 0:
                whole = np.zeros((count, 8), dtype=np.uint8)
                whole[:, :width // 8] = chunks.reshape(count, width // 8)
                values = whole.view("<u8").ravel()
            else:
                nibbles = np.empty(2 * chunks.size, dtype=np.uint8)
                nibbles[0::2], nibbles[1::2] = chunks & 15, chunks >> 4
                nibbles = nibbles[:count * (width // 4)].reshape(count, width // 4)
                values = np.zeros(count, dtype=np.uint64)
                for k in range(width // 4):
                    values |= nibbles[:, k].astype(np.uint64) << np.uint64(4 * k)
            if below is not None:
                more = np.unpackbits(words.view(np.uint8), count=count, bitorder="little").astype(bool)
                values[more] |= below << np.uint64(width)
            below = values
        return below
