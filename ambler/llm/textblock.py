"""Words of an Arrow text column as numpy arrays, without a Python object per word.

A word is a run of bytes other than 0x20 and 0x09 to 0x0D.  Its 64-bit hash takes
eight bytes at a time, each step a bijection of the state that the next bytes enter,
so unlike words of at most eight bytes and equal length never collide; words over
``LONG`` bytes have a BLAKE2b digest.  Equal words have equal hashes in every process.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_STEP = 0xD1342543DE82EF95
#: Bytes up to which words are hashed and compared by lanes of eight.
LONG = 64
#: The bytes of a lane that belong to a word with so many bytes left.
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over all 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place of ``data`` on, zeros behind its end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def _by_lane(size: np.ndarray):
    """(words that have bytes left, bytes done, mask) for every lane of the words up to LONG bytes."""
    active, at = np.flatnonzero((size > 0) & (size <= LONG)), 0
    while len(active):
        left = size[active] - at
        yield active, at, _MASKS[np.minimum(left, 8)]
        active, at = active[left > 8], at + 8


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    size = end - start
    out = mix(size.astype(np.uint64) + np.uint64(1))
    lanes = _lanes(data)
    for active, at, mask in _by_lane(size):
        out[active] = mix((out[active] ^ (lanes[start[active] + at] & mask)) * np.uint64(_STEP))
    for i in np.flatnonzero(size > LONG):
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]], digest_size=8).digest(), "little")
    return out


def same_bytes(a: np.ndarray, a_start: np.ndarray, b: np.ndarray, b_start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether ``size[i]`` bytes of ``a`` from ``a_start[i]`` on equal those of ``b`` from ``b_start[i]`` on."""
    out = np.ones(len(size), bool)
    one, two = _lanes(a), _lanes(b)
    for active, at, mask in _by_lane(size):
        out[active] &= (one[a_start[active] + at] ^ two[b_start[active] + at]) & mask == 0
    for i in np.flatnonzero(size > LONG):
        out[i] = np.array_equal(a[a_start[i] : a_start[i] + size[i]], b[b_start[i] : b_start[i] + size[i]])
    return out


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pc.fill_null(column, "").cast(pa.large_binary())
    offsets = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    held = wide.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """start, end and hash of every word; ``bounds[i]:bounds[i + 1]`` are those of row i."""

    def __init__(self, column: pa.Array, lower: bool):
        self.data, self.offsets = buffers(column)
        n = len(self.data)
        held = ~_SPACE[self.data]
        if n:
            before, after = np.zeros(n, bool), np.zeros(n, bool)
            before[1:], after[:-1] = held[:-1], held[1:]
            firsts = self.offsets[:-1]
            before[firsts[firsts < n]] = False
            lasts = self.offsets[1:] - 1
            after[lasts[lasts >= 0]] = False
            self.start = np.flatnonzero(held & ~before)
            self.end = np.flatnonzero(held & ~after) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        self.bounds = np.searchsorted(self.start, self.offsets)
        self.hash = word_hashes(_LOWER[self.data] if lower else self.data, self.start, self.end)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``k`` words inside rows, and each row's bounds in them."""
        n, counts = len(self.hash), self.counts
        if n < k:
            return np.zeros(0, np.uint64), np.zeros(len(counts) + 1, np.int64)
        total = np.zeros(n - k + 1, np.uint64)
        weight = 1
        for i in range(k):
            total += self.hash[i : n - k + 1 + i] * np.uint64(weight)
            weight = weight * _STEP % 2**64
        per_row = np.maximum(counts - k + 1, 0)
        inside = np.ones(n - k + 1, bool)
        for back in range(1, k):
            last = self.bounds[1:] - back
            last = last[(last >= self.bounds[:-1]) & (last < n - k + 1)]
            inside[last] = False
        return mix(total[inside]), np.concatenate([[0], np.cumsum(per_row)])

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`windows`; a row of 1 to k - 1 words has its whole sequence as one."""
        hashes, bounds = self.windows(k)
        short = np.flatnonzero((self.counts > 0) & (self.counts < k))
        if not len(short):
            return hashes, bounds
        own = np.zeros(len(short), np.uint64)
        weight = 1
        for i in range(k - 1):
            has = self.counts[short] > i
            own[has] += self.hash[self.bounds[short[has]] + i] * np.uint64(weight)
            weight = weight * _STEP % 2**64
        own = mix(own ^ mix(self.counts[short].astype(np.uint64) + np.uint64(1)))
        hashes = np.insert(hashes, bounds[short], own)
        per_row = np.diff(bounds)
        per_row[short] = 1
        return hashes, np.concatenate([[0], np.cumsum(per_row)])
