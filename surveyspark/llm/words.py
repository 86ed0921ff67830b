"""Array kernels over the words of many texts at once (numpy over Arrow buffers).

A word is a run of bytes other than space and 0x09-0x0D; UTF-8 continuation bytes are never
among those, so bytes and characters agree. Every function works on whole texts and keeps
memory proportional to the slice it is given (``slices`` cuts a column by bytes).
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

HASH_BYTES = 1 << 19
SLICE_BYTES = 1 << 19  # text bytes handled at once; one longer text is one slice

_MASK = (1 << 64) - 1


def give_back() -> None:
    """Free memory returns to the system: a worker that waits for another task holds none."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def returning(run: Callable, *last: Callable) -> Callable:
    """``run`` over a partition; then ``last`` are called and free memory is given back."""

    def all_of(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            for end in last:
                end()
            give_back()

    return all_of


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the splitmix64 finisher)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit words of the stream ``seed``."""
    start = np.uint64((seed * 0x9E3779B97F4A7C15 + 1) & _MASK)
    with np.errstate(over="ignore"):
        return mix(start + np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Family:
    """One hash family: a table for byte values, odd factors for byte places and word places."""

    def __init__(self, seed: int, lower: bool = False):
        self.table = stream(3 * seed, 256)
        if lower:
            self.table[65:91] = self.table[97:123]
        self.table[_SPACE] = 0
        self.seed, self._place = seed, stream(3 * seed + 1, 64) | np.uint64(1)
        self.factor = stream(3 * seed + 2, 64) | np.uint64(1)

    def place(self, n: int) -> np.ndarray:
        if n > len(self._place):
            self._place = stream(3 * self.seed + 1, max(n, 2 * len(self._place))) | np.uint64(1)
        return self._place


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (starting at 0) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()).fill_null("")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    data = col.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(col: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold about ``limit`` bytes."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    _, offsets = text_buffer(col)
    at, n = 0, len(col)
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        end = min(n, max(at + 1, end))
        yield at, end
        at = end


class Words:
    """Word borders of a slice: ``start``/``end`` byte places, ``first[d]:first[d + 1]`` words of text d."""

    def __init__(self, col: pa.Array, fold: np.ndarray | None = None):
        """``fold``: another byte for each byte, e.g. to make punctuation a separator."""
        self.data, self.offsets = text_buffer(col)
        if fold is not None:
            self.data = fold[self.data]
        solid = ~_SPACE[self.data]
        begins, ends = solid.copy(), solid.copy()
        begins[1:] &= ~solid[:-1]
        ends[:-1] &= ~solid[1:]
        inner = self.offsets[(self.offsets > 0) & (self.offsets < len(solid))]
        begins[inner] = solid[inner]
        ends[inner - 1] = solid[inner - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.count = np.diff(self.first)

    def hashes(self, family: Family) -> np.ndarray:
        """64-bit hash of every word."""
        n = len(self.start)
        out = np.empty(n, np.uint64)
        # stretches of words of about HASH_BYTES, since a byte takes twenty while it is hashed
        cut = np.unique(np.searchsorted(self.start, np.arange(0, len(self.data), HASH_BYTES))).tolist()
        for a, b in zip(cut, [*cut[1:], n]):
            lo, hi = (int(self.start[k]) if k < n else len(self.data) for k in (a, b))
            start = self.start[a:b] - lo
            reach = np.diff(np.append(start, hi - lo))
            inside = np.arange(hi - lo, dtype=np.int32)
            inside -= np.repeat(start.astype(np.int32), reach)
            with np.errstate(over="ignore"):
                part = family.table[self.data[lo:hi]]
                part *= family.place(int(reach.max(initial=0)))[inside]
                total = np.add.reduceat(part, start) if b > a else np.zeros(0, np.uint64)
                out[a:b] = mix(total + (self.end[a:b] - self.start[a:b]).astype(np.uint64) * family.factor[63])
        return out


def window_hashes(word_hash: np.ndarray, width: int, family: Family) -> np.ndarray:
    """Hash of the ``width`` words starting at each word (the last ones run over the end: mask them)."""
    n = max(0, len(word_hash) - width + 1)
    out = np.zeros(len(word_hash), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out[:n] += word_hash[k:k + n] * family.factor[k]
    return mix(out)


def has_window(words: Words, width: int) -> np.ndarray:
    """For each word: do ``width`` words starting here lie in one text?"""
    last = np.repeat(words.first[1:], words.count)
    return np.arange(len(words.start)) + width <= last


def owner(words: Words) -> np.ndarray:
    """Text number of each word."""
    return np.repeat(np.arange(len(words.count)), words.count)
