"""Vectorised kernels over the byte buffers of Arrow string columns.

They run inside ``mapInArrow`` tasks: Spark partitions, shuffles and joins the
rows, the kernels only turn the texts of one batch into word boundaries and
64-bit word hashes without making a Python object per word.

A word is a maximal run of bytes that are not ASCII white space
(``[^\\x20\\x09-\\x0D]+``); UTF-8 continuation bytes are never white space, so
words of bytes and words of code points are the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def fmix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (avalanche) applied elementwise; returns a new array."""
    x = x ^ (x >> U64(33))
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def keyed(seed: int, n: int) -> np.ndarray:
    """n pseudo-random 64-bit values of a seed."""
    with np.errstate(over="ignore"):
        return fmix(np.arange(1, n + 1, dtype=U64) * U64(_BASE) + U64(seed * 0x2545F4914F6CDD1D % (1 << 64)))


_BYTE = keyed(7, 256) | U64(1)
_BYTE[WHITE] = 0
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=U64)

    @staticmethod
    def _table(base: int, size: int) -> np.ndarray:
        steps = np.full(size, base, dtype=U64)
        steps[0] = 1
        return np.multiply.accumulate(steps, dtype=U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << max(16, int(n - 1).bit_length())
            self.up, self.down = (self._table(base, size) for base in (_BASE, _INVERSE))
        return self.up, self.down


_POWERS = _Powers()
_BLOCK = 1 << 20


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, is_null) of a string column; a null has no bytes."""
    if pa.types.is_large_string(column.type):
        width = np.int64
    else:
        column, width = column.cast(pa.string()), np.int32
    null = np.asarray(column.is_null().to_numpy(zero_copy_only=False), dtype=bool)
    if null.any():
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=width)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offsets else np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets, null


def chunks(offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes; a longer text stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def word_bounds(data: np.ndarray, text_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (exclusive) of each word; no word spans two texts."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~WHITE[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[text_starts] = True
    cut[0] = cut[-1] = True
    starts = solid.copy()
    starts[1:] &= ~solid[:-1] | cut[1:-1]
    ends = solid
    after = ~solid[1:] | cut[1:-1]
    ends = ends.copy()
    ends[:-1] &= after
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """64-bit hash of each run of bytes, with a random value for each byte."""
    out = np.empty(len(starts), dtype=U64)
    first = 0
    with np.errstate(over="ignore"):
        while first < len(starts):
            base = starts[first]
            last = max(first + 1, int(np.searchsorted(ends, base + _BLOCK, "right")))
            stop = ends[last - 1]
            up, down = _POWERS.upto(int(stop - base) + 1)
            sums = np.zeros(stop - base + 1, dtype=U64)
            np.cumsum(table[data[base:stop]] * up[: stop - base], out=sums[1:])
            s, e = starts[first:last] - base, ends[first:last] - base
            out[first:last] = fmix((sums[e] - sums[s]) * down[s] + (e - s).astype(U64) * U64(0xD6E8FEB86659FD93))
            first = last
    return out


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """64-bit hash of each word; with ``lower`` A-Z hash as a-z."""
    return hash_runs(data, starts, ends, _BYTE_LOWER if lower else _BYTE)


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words; with 1 to k-1 words, of all as one."""
    n = len(hashes)
    if not n:
        return hashes
    width = min(n, k)
    with np.errstate(over="ignore"):
        odd = keyed(1000 + width, width) | U64(1)
        total = hashes[: n - width + 1] * odd[0]
        for j in range(1, width):
            total += hashes[j : n - width + 1 + j] * odd[j]
        return fmix(total + U64(width))


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    values = np.sort(values)
    if len(values) > 1:
        values = values[np.concatenate([[True], values[1:] != values[:-1]])]
    return values


def text_words(column: pa.Array, lower: bool, size: int = 1 << 19) -> Iterator[tuple[int, bool, np.ndarray]]:
    """(row, is_null, word hashes in order) of each text of a batch."""
    data, offsets, null = texts_of(column)
    for first, last in chunks(offsets, size):
        part = data[offsets[first] : offsets[last]]
        at = offsets[first : last + 1] - offsets[first]
        starts, ends = word_bounds(part, at)
        hashes = word_hashes(part, starts, ends, lower)
        edge = np.searchsorted(starts, at)
        for i in range(last - first):
            yield first + i, bool(null[first + i]), hashes[edge[i] : edge[i + 1]]
