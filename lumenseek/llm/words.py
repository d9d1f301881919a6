"""Words of whole Arrow text columns as 64-bit hashes, computed on the UTF-8 bytes without a Python loop.

A word is a run of bytes that a 256-entry table marks; the table also folds A-Z. A word's hash is the sum of a mixed value
of each byte and its place, mixed again; unlike a polynomial in the places it has no words of a known pattern that
collide. All words of a column cost a few vector operations.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Odd multipliers, by which hashes modulo 2**64 are made.
_P = 0x9E3779B97F4A7C15
_Q = 0xC2B2AE3D27D4EB4F
#: Second, independent hashes start from here.
CHECK = 0x5851F42D4C957F2D
_BLOCK = 1 << 18


def byte_table(separators) -> np.ndarray:
    """Folded byte for each byte; 0-length marks (value 256) for the separators."""
    fold = np.arange(256, dtype=np.uint16)
    fold[65:91] += 32
    fold[list(separators)] = 256
    return fold


#: Words of letters, digits and all that is not ASCII: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z are folded.
ALNUM = byte_table([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
#: Words between white space: [^\x20\x09-\x0D]+.
BLACK = byte_table([0x20, *range(0x09, 0x0E)])


class Words(NamedTuple):
    hashes: np.ndarray  # uint64, of all words of all rows
    bounds: np.ndarray  # words of row i are bounds[i]:bounds[i + 1]
    folded: np.ndarray | None = None  # the bytes, and where each word starts and ends in them
    starts: np.ndarray | None = None
    ends: np.ndarray | None = None

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the rows' bounds in them; null rows are empty."""
    if pa.types.is_large_string(column.type) or column.null_count:
        column = pa.array([x or "" for x in column.to_pylist()], pa.string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int32, len(column) + 1, 4 * column.offset).astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[bounds[0] : bounds[-1]], bounds - bounds[0]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them evenly."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i < n."""
    size = 1 << max(16, (max(n, 1) - 1).bit_length())
    if size not in _POWERS:
        up, down = np.full(size, _P, np.uint64), np.full(size, pow(_P, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        made = np.cumprod(up), np.cumprod(down)
        if size > _BLOCK:  # one very long text: not kept
            return made
        _POWERS[size] = made
    return _POWERS[size]


def range_hashes(folded: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of each byte range (starts ascending, none empty), the same for equal bytes wherever they stand; another seed gives independent hashes."""
    out = np.zeros(len(starts), np.uint64)
    lengths = ends - starts
    before = np.concatenate(([0], np.cumsum(lengths)))
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(before, before[at] + _BLOCK, "right")) - 1)
        firsts = before[at:to] - before[at]
        place = np.arange(int(before[to] - before[at])) - np.repeat(firsts, lengths[at:to])
        values = folded[np.repeat(starts[at:to], lengths[at:to]) + place].astype(np.uint64)
        values |= place.astype(np.uint64) << np.uint64(8)
        out[at:to] = np.add.reduceat(_spread(values ^ np.uint64(seed)), firsts)
        at = to
    return mix(out + lengths.astype(np.uint64) * np.uint64(_Q))


def _spread(h: np.ndarray) -> np.ndarray:
    """As ``mix``, in place; ends with a high bits' fold, so that sums of a few values are spread too."""
    h *= np.uint64(_P)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def split(column: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes, starts and ends of all words, and the rows' bounds among the words."""
    data, bounds = text_bytes(column)
    folded = table[data]
    inside = folded < 256
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = bounds[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] = inside[edges]  # a row's first byte begins a word even if the row before ends in one
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return folded, starts, ends, np.searchsorted(starts, bounds)


def of(column: pa.Array, table: np.ndarray = ALNUM) -> Words:
    folded, starts, ends, bounds = split(column, table)
    folded = folded.astype(np.uint8)
    return Words(range_hashes(folded, starts, ends), bounds, folded, starts, ends)


def grams(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k words from each word on, and whether they all lie in one row."""
    n = len(words.hashes)
    out = np.zeros(n, np.uint64)
    factor = 1
    for j in range(min(k, n)):
        out[: n - j] += words.hashes[j:] * np.uint64(factor)
        factor = factor * _Q % (1 << 64)
    ends = np.repeat(words.bounds[1:], words.counts)
    return mix(out), np.arange(n) + k <= ends


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values in ascending order, by one sort (``np.unique`` hashes, which is far slower on values that hardly repeat)."""
    values = np.sort(values)
    first = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=first[1:])
    return values[first]
