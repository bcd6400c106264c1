"""Hashes of words, word windows and byte windows of many texts at once, in numpy.

All texts of a batch lie one after the other in one byte array, and hashes of
stretches come from prefix sums of a polynomial modulo 2**64, so that no loop
runs over texts, words or bytes. The base is odd and fixed: equal stretches
have equal hashes in every task.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_CHUNK_BYTES = 256 << 10  # arrays of eight bytes a character then stay in cache
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(way: str, base: np.uint64, n: int) -> np.ndarray:
    if len(_powers[way]) < n:
        steps = np.full(max(n, 1 << 20), base, np.uint64)
        steps[0] = 1
        _powers[way] = np.cumprod(steps, dtype=np.uint64)
    return _powers[way]


class Prefix:
    """Prefix sums over a byte array; ``hash(start, end)`` for arrays of stretches."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        _power("down", _BASE_INVERSE, n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix_bytes()[data] * _power("up", _BASE, n + 1)[:n], dtype=np.uint64, out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * _powers["down"][start])

    def windows(self, size: int) -> np.ndarray:
        """The hash of every stretch of ``size`` bytes, by its start."""
        n = len(self.sums) - size
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[size:] - self.sums[:n]) * _powers["down"][:n])


_byte_values: list[np.ndarray] = []


def mix_bytes() -> np.ndarray:
    if not _byte_values:
        _byte_values.append(mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    return _byte_values[0]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


class Texts:
    """A run of texts as bytes: ``data``, and text ``i`` lies in ``data[starts[i]:starts[i + 1]]``."""

    def __init__(self, data: np.ndarray, starts: np.ndarray):
        self.data, self.starts = data, starts

    def __len__(self) -> int:
        return len(self.starts) - 1

    def lower_ascii(self) -> Texts:
        return Texts(_LOWER[self.data], self.starts)

    def words(self, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of every word, and where each text's words begin in these arrays."""
        gap = space[self.data]
        first, last = ~gap, ~gap
        if len(gap):
            cut = np.zeros(len(gap) + 1, bool)
            cut[self.starts] = True
            first[1:] &= gap[:-1] | cut[1:-1]
            last[:-1] &= gap[1:] | cut[1:-1]
        begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        return begin, end, np.searchsorted(begin, self.starts)


def texts_of(column: pa.Array) -> Iterator[tuple[int, int, Texts]]:
    """(first row, end row, texts) in runs of some hundred kilobytes; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + _CHUNK_BYTES, "right")) - 1
        end = min(max(end, row + 1), len(column))
        yield row, end, Texts(data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row])
        row = end


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every ``size`` neighbouring word hashes, by the first; the last few reach past the end and mean nothing."""
    if len(words) < size:
        return np.zeros(0, np.uint64)
    n = len(words) - size + 1
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total = total * _BASE + words[k : k + n]
    return mix(total)
