"""Whole-batch word splitting and hashing in numpy.

A word is ``[^\\x20\\x09-\\x0D]+``.  One Arrow batch of texts is split at once:
there is no Python object per word, and memory is bounded by slicing a batch so
that a slice holds at most ``SLICE_BYTES`` bytes or one single text, whose words
are hashed piece by piece.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_GRAM = np.uint64(0xD6E8FEB86659FD93)
_GRAM_INV = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_tables: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept, and grown when a longer one is needed."""
    table = _tables.get(int(base))
    if table is None or len(table) < n:
        table = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        table[0] = 1
        np.multiply.accumulate(table, out=table)
        if n <= SLICE_BYTES + 1024:
            _tables[int(base)] = table
    return table[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """The words of rows first .. first + n_docs - 1 of a batch."""

    first: int
    n_docs: int
    raw: np.ndarray  # the bytes as they stand
    bytes: np.ndarray  # A-Z lower-cased if asked for
    doc: np.ndarray  # row of each word, from 0
    start: np.ndarray  # byte positions in raw
    end: np.ndarray
    hash: np.ndarray  # uint64 of each word
    offset: np.ndarray  # first word of each row, and the end
    bounds: np.ndarray  # first byte of each row, and the end

    def grams(self, k: int, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Positions at which k consecutive words of one document start, and the hash of those words."""
        n = len(self.hash)
        if at is None:
            if n < k:
                return np.empty(0, np.int64), np.empty(0, np.uint64)
            at = np.flatnonzero(self.doc[: n - k + 1] == self.doc[k - 1 :])
        if k <= 6:
            g = self.hash[at]
            for j in range(1, k):
                g = g * _GRAM + self.hash[at + j]
        else:
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.hash * _powers(_GRAM, n), dtype=np.uint64)])
            g = (sums[at + k] - sums[at]) * _powers(_GRAM_INV, n)[at]
        return at, mix(g)

    def spans(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Hash of the words lo .. hi - 1 for each pair."""
        n = len(self.hash)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.hash * _powers(_GRAM, n), dtype=np.uint64)])
        if not n:
            return np.zeros(len(lo), np.uint64)
        g = (sums[hi] - sums[lo]) * _powers(_GRAM_INV, n)[np.minimum(lo, n - 1)]
        return mix(g + (hi - lo).astype(np.uint64) * _BASE)


def split(texts: pa.Array, lower: bool = True) -> Iterator[Words]:
    """Words of a string array, some rows at a time; a null text has none."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if len(texts) and texts.buffers()[2] is not None else np.empty(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, "right")) - 1)
        yield _words(i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lower)
        i = j


def _words(first: int, raw: np.ndarray, bounds: np.ndarray, lower: bool) -> Words:
    n_docs, size = len(bounds) - 1, len(raw)
    data = _LOWER[raw] if lower else raw
    solid = ~_SPACE[raw]
    edge = np.zeros(size + 1, dtype=bool)
    edge[bounds] = True
    before = np.ones(size, dtype=bool)
    before[1:] = ~solid[:-1]
    after = np.ones(size, dtype=bool)
    after[:-1] = ~solid[1:]
    start = np.flatnonzero(solid & (before | edge[:-1]))
    end = np.flatnonzero(solid & (after | edge[1:])) + 1
    doc = np.searchsorted(bounds, start, "right") - 1
    h = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):  # a text of any length is hashed a piece at a time: eight bytes of sums per byte are held for a piece only
        j = max(i + 1, int(np.searchsorted(end, start[i] + SLICE_BYTES, "right")))
        lo, hi = int(start[i]), int(end[j - 1])
        sums = np.zeros(hi - lo + 1, dtype=np.uint64)
        np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * _powers(_BASE, hi - lo), out=sums[1:])
        a, z = start[i:j] - lo, end[i:j] - lo
        h[i:j] = mix((sums[z] - sums[a]) * _powers(_BASE_INV, hi - lo)[a] + (z - a).astype(np.uint64))
        i = j
    offset = np.searchsorted(doc, np.arange(n_docs + 1))
    return Words(first, n_docs, raw, data, doc, start, end, h, offset, bounds)
