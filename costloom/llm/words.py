"""Words of whole text columns as numpy arrays, for code that runs on Arrow batches inside tasks.

A word is a run of characters other than space and U+0009 to U+000D. These are single bytes in UTF-8, so words are
found on the bytes. Texts are worked on in chunks of about ``CHUNK_BYTES``; a longer text makes a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15 | 5  # odd, 5 modulo 8
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit numbers that depend on ``seed`` only."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


_BYTE = constants(256, 11)
_LOWERED = _BYTE.copy()
_LOWERED[0x41:0x5B] = _BYTE[0x61:0x7B]


class _Powers:
    """Powers of an odd base modulo 2**64, grown when a longer chunk needs them."""

    def __init__(self, base: int) -> None:
        self.base, self.values = base, np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> np.ndarray:
        while len(self.values) < n:
            step = np.uint64(pow(self.base, len(self.values), 1 << 64))
            self.values = np.concatenate([self.values, self.values * step])
        return self.values[:n]


_POWERS, _INVERSE = _Powers(_BASE), _Powers(pow(_BASE, -1, 1 << 64))


def sum_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash of ``values[start:end]`` for each pair; equal runs get equal hashes wherever they stand."""
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * _POWERS.upto(len(values)), out=total[1:])
    return (total[ends] - total[starts]) * _INVERSE.upto(len(values) + 1)[starts]


def power_of(exponents: np.ndarray) -> np.ndarray:
    """What the hash of a run is multiplied by when it moves ``exponents`` places back."""
    return _POWERS.upto(int(exponents.max(initial=0)) + 1)[exponents]


@dataclass
class Chunk:
    """Rows ``first`` to ``last`` of a column and their words."""

    first: int
    last: int
    data: np.ndarray  # bytes of the rows, one after the other
    bounds: np.ndarray  # where each row begins in data, and the end
    starts: np.ndarray  # where each word begins in data
    ends: np.ndarray
    words: np.ndarray  # index of the first word of each row, and the number of words

    @property
    def rows(self) -> int:
        return self.last - self.first

    def hashes(self, lower: bool) -> np.ndarray:
        """A 64-bit hash of each word; ``lower`` reads A-Z as a-z."""
        values = (_LOWERED if lower else _BYTE)[self.data]
        return mix(sum_hash(values, self.starts, self.ends))

    def row_of_words(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.words))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), bounds


def chunks(column: pa.Array, chunk_bytes: int = CHUNK_BYTES, space: np.ndarray = _SPACE) -> Iterator[Chunk]:
    """Cut a column into chunks of rows and find their words. ``space``: which bytes stand between words."""
    data, bounds = text_buffers(column)
    first, n = 0, len(bounds) - 1
    while first < n:
        last = int(np.searchsorted(bounds, bounds[first] + chunk_bytes, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield chunk_of(data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first], first, last, space)
        first = last


def chunk_of(data: np.ndarray, bounds: np.ndarray, first: int, last: int, space: np.ndarray = _SPACE) -> Chunk:
    solid = ~space[data]
    begins, stops = solid.copy(), solid.copy()
    if len(data):
        begins[1:] &= ~solid[:-1]
        stops[:-1] &= ~solid[1:]
        inner = bounds[1:-1][(bounds[1:-1] > 0) & (bounds[1:-1] < len(data))]
        begins[inner] = solid[inner]
        stops[inner - 1] = solid[inner - 1]
    starts = np.flatnonzero(begins)
    return Chunk(first, last, data, bounds, starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, bounds))


def ngrams(hashes: np.ndarray, words: np.ndarray, size: int, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``size`` words inside a row, and the index of its first word."""
    if len(hashes) < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    factor, total = constants(size, seed), np.zeros(len(hashes) - size + 1, np.uint64)
    for j in range(size):
        total += hashes[j : len(hashes) - size + 1 + j] * factor[j]
    ends = np.repeat(words[1:], np.diff(words))[: len(total)]
    at = np.flatnonzero(np.arange(len(total)) + size <= ends)
    return mix(total[at]), at
