"""Whole texts of an Arrow batch as flat NumPy arrays: words, hashes of words and of runs, minimisers.

Everything here is a small vectorised helper that runs inside a task. Hashes are 64-bit polynomials modulo
2**64 followed by a bit mixer; equal content always gives equal values, on every machine. Such polynomials cannot tell
some texts of 1,024 or more values apart, so longer words are hashed by BLAKE2; runs of values are always shorter.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one step of a task looks at; only a single longer text goes beyond it.
CHUNK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C55
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes from which on a word is hashed as a whole.
LONG_WORD = 256
#: Separators of words written as `[^\x20\x09-\x0D]+`.
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
#: Separators of words of letters, digits and non-ASCII characters.
NON_WORD = np.zeros(256, bool)
NON_WORD[:0x30] = NON_WORD[0x3A:0x61] = NON_WORD[0x7B:0x80] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = {_BASE: np.ones(1, np.uint64), _INVERSE: np.ones(1, np.uint64)}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next call."""
    if len(_powers[base]) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return _powers[base][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective bit mixer (the finaliser of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """The same work of a task; at its end the worker, which lives on, gives freed memory back to the machine."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library can
            if trim is not None:
                trim(0)

    return whole


class Hasher:
    """Hashes of any slices of one array of numbers, after a single pass over it."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(_BASE, n), out=self.prefix[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self.prefix[ends] - self.prefix[starts]) * powers(_INVERSE, len(self.prefix))[starts]
        return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def runs(self, n: int) -> np.ndarray:
        """Hash of each run of n values."""
        if len(self.prefix) <= n:
            return np.zeros(0, np.uint64)
        raw = (self.prefix[n:] - self.prefix[:-n]) * powers(_INVERSE, len(self.prefix) - n)
        return mix(raw + np.uint64(n * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF))


def short_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int) -> np.ndarray:
    """What a Hasher gives for slices of at most `most` values, without its pass over all values."""
    sizes, raw = ends - starts, np.zeros(len(starts), np.uint64)
    for i in range(most):
        held = sizes > i
        raw[held] += (values[starts[held] + i].astype(np.uint64) + np.uint64(1)) * powers(_BASE, most)[i]
    return mix(raw + sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Places:
    """Finds hashes in a sorted array of distinct ones: by their first bits, and a few steps on from there."""

    def __init__(self, hashes: np.ndarray):
        bits = len(hashes).bit_length() + 1
        self.size, self.shift = len(hashes), np.uint64(64 - bits)
        self.hashes = np.append(hashes, np.uint64(2**64 - 1))
        self.first = np.searchsorted(hashes, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def __len__(self) -> int:
        return self.size

    def __call__(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each, and whether it is there."""
        at = self.first[asked >> self.shift].astype(np.int64)
        behind = np.flatnonzero(self.hashes[at] < asked)
        while len(behind):
            at[behind] += 1
            behind = behind[self.hashes[at[behind]] < asked[behind]]
        return at, (self.hashes[at] == asked) & (at < self.size)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the bounds of its rows (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, bounds, data = column.buffers()
    if bounds is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    bounds = np.frombuffer(bounds, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def chunks(bounds: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts have about `size` bytes together."""
    first, rows = 0, len(bounds) - 1
    while first < rows:
        last = int(np.searchsorted(bounds, bounds[first] + size, side="right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


@dataclass
class Words:
    """Words of some rows: byte bounds, row of each word, first word of each row, hash of each word."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    firsts: np.ndarray
    hashes: np.ndarray

    def within(self, n: int) -> np.ndarray:
        """For each run of n words, whether all are of one row."""
        return self.rows[: len(self.rows) - n + 1] == self.rows[n - 1 :] if len(self.rows) >= n else np.zeros(0, bool)

    def text(self, first: int, last: int) -> bytes:
        """Words first..last-1, joined by one space."""
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.starts[first:last], self.ends[first:last], strict=True))


def words(data: np.ndarray, bounds: np.ndarray, separators: np.ndarray = SPACES, lower: bool = True) -> Words:
    """Words of the rows with these bounds; A-Z in lower case if asked."""
    base, n, rows = int(bounds[0]), int(bounds[-1] - bounds[0]), len(bounds) - 1
    own = data[base : base + n]
    own = _LOWER[own] if lower else own
    cut = np.zeros(n + 1, bool)
    cut[:n] = separators[own]
    is_word = ~cut[:n]
    begins = is_word.copy()
    begins[1:] &= cut[: n - 1]
    ends = is_word.copy()
    ends[: n - 1] &= cut[1:n]
    # a row's end also ends its last word, when the next row begins with one at once
    edges = bounds[:-1][bounds[1:] > bounds[:-1]] - base
    begins[edges] = is_word[edges]
    last = edges[edges > 0] - 1
    ends[last] = is_word[last]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    of = np.searchsorted(bounds[1:] - base, starts, side="right")
    firsts = np.searchsorted(of, np.arange(rows + 1))
    hashes = Hasher(own)(starts, ends) if n else np.zeros(0, np.uint64)
    for i in np.flatnonzero(ends - starts >= LONG_WORD).tolist():
        hashes[i] = int.from_bytes(blake2b(own[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return Words(own, starts, ends, of, firsts, hashes)


def sliding_min(values: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each run of n values, by doubling."""
    out, span = values, 1
    while span * 2 <= n:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[: len(values) - n + 1], out[n - span :]) if n > span else out


_PLACES = 22


def minimisers(hashes: np.ndarray, n: int, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each window of n hashes the place of the smallest (of equal ones the last): places, first and last window.

    `valid` tells which windows count; windows with the same place that follow each other give one entry. Which
    place a window takes depends on its own content only, so equal windows take the same relative place.
    """
    total, step, found = len(hashes) - n + 1, (1 << _PLACES) - n, []
    for at in range(0, max(total, 0), step):
        upto = min(at + step, total)
        part = hashes[at : upto + n - 1]
        keyed = (part >> np.uint64(_PLACES) << np.uint64(_PLACES)) | np.arange((1 << _PLACES) - 1, (1 << _PLACES) - 1 - len(part), -1).astype(np.uint64)
        place = at + ((1 << _PLACES) - 1) - (sliding_min(keyed, n) & np.uint64((1 << _PLACES) - 1)).astype(np.int64)
        window = np.flatnonzero(valid[at:upto])
        if len(window):
            place = place[window]
            new = np.ones(len(window), bool)
            new[1:] = (place[1:] != place[:-1]) | (np.diff(window) != 1)
            heads = np.flatnonzero(new)
            tails = np.append(heads[1:], len(window)) - 1
            found.append((place[heads], window[heads] + at, window[tails] + at))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def covered(firsts: np.ndarray, lasts: np.ndarray, size: int) -> np.ndarray:
    """A flag for each of `size` places that lies in one of the ranges first..last-1."""
    steps = np.zeros(size + 1, np.int64)
    np.add.at(steps, firsts, 1)
    np.subtract.at(steps, lasts, 1)
    return np.cumsum(steps[:-1]) > 0


def run_bounds(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true flags."""
    edges = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
