"""Whole Arrow text columns as numpy arrays: word spans, span hashes, per-document sums.

Everything here works on one bounded chunk of documents at a time. A word is a run of bytes other
than space and \\t..\\r. Hashes have 64 bits; two different words or n-grams are taken for the same
with a chance of about 2**-57 a pair.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 2 << 20
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
# ASCII letters to lower case, byte by byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
C1, C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = np.array(x, np.uint64)
    x ^= x >> np.uint64(30)
    x *= C1
    x ^= x >> np.uint64(27)
    x *= C2
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> list[np.ndarray]:
    """BASE**i and its inverse modulo 2**64, for i up to n."""
    if len(_POWERS[0]) <= n:
        size = 1 << int(n).bit_length()
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for k, b in enumerate((_BASE, inverse)):
            p = np.full(size + 1, b, np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS


def chunks(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches holding up to ``most`` bytes of text each, or a single longer document."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64))
        start = 0
        while start < batch.num_rows:
            floor = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, floor + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop


class Texts:
    """The bytes of a text column and the words in them. Null texts count as empty."""

    def __init__(self, column: pa.Array, lower: bool = False, separators: np.ndarray = SPACE):
        column = pc.fill_null(column.cast(pa.large_string()), "")
        _, offsets, data = column.buffers()
        offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
        raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.empty(0, np.uint8)
        self.bytes = LOWER[raw] if lower else raw
        self.offsets = offsets - offsets[0]
        self.docs = len(column)
        n = len(self.bytes)
        inside = ~separators[self.bytes]
        first = np.zeros(n + 1, bool)
        first[self.offsets] = True
        begins, stops = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1] | first[1:n]
        stops[:-1] &= ~inside[1:] | first[1:n]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        # words of document i: bounds[i] to bounds[i + 1]
        self.bounds = np.searchsorted(self.starts, self.offsets)
        self.doc = np.repeat(np.arange(self.docs), np.diff(self.bounds))
        self._sums = None

    def hashes(self, starts: np.ndarray | None = None, ends: np.ndarray | None = None) -> np.ndarray:
        """A hash of each span of bytes, by default of each word; equal bytes have equal hashes."""
        starts, ends = (self.starts, self.ends) if starts is None else (starts, ends)
        power, inverse = _powers(len(self.bytes))
        if self._sums is None:
            self._sums = np.zeros(len(self.bytes) + 1, np.uint64)
            np.cumsum((self.bytes.astype(np.uint64) + np.uint64(1)) * power[:len(self.bytes)], out=self._sums[1:])
        h = (self._sums[ends] - self._sums[starts]) * inverse[starts]
        return mix(h + (ends - starts).astype(np.uint64) * C2)

    def per_doc(self, values: np.ndarray, positions: np.ndarray | None = None) -> np.ndarray:
        """Sums of values by document: one value a word, or one for each byte position given."""
        where = self.doc if positions is None else np.searchsorted(self.offsets, positions, "right") - 1
        return np.bincount(where, values, self.docs).astype(np.int64)


def ngrams(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n words from each position on, for positions whose n words are in one document."""
    if len(h) < n:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    at = np.flatnonzero(doc[:len(h) - n + 1] == doc[n - 1:])
    out = h[at]
    for k in range(1, n):
        out = mix(out * _BASE + h[at + k])
    return at, out


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in a span."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, starts + lengths, -1)
    return np.cumsum(d[:n]) > 0


def binary_list(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([a.tobytes() for a in arrays], pa.binary())
