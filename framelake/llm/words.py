"""Vectorised word work shared by the document operators (runs inside Arrow tasks).

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D, never crossing a document. Words and word windows are named by
64-bit hashes; polynomial hashing over the UTF-8 bytes keeps everything in numpy, whatever the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20  # texts are worked on in slices of about this many bytes

_U = np.uint64
_P = _U(0x9E3779B97F4A7C15 | 1)
_P_INV = _U(pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64))
_Q = _U(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _P)
IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, 9, 10, 11, 12, 13]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse."""
    if len(_powers[0]) < n:
        n = max(n, CHUNK_BYTES + 1024)
        for i, base in enumerate((_P, _P_INV)):
            t = np.full(n, base, np.uint64)
            t[0] = 1
            _powers[i] = np.multiply.accumulate(t)
    return _powers[0][:n], _powers[1][:n]


def slices(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes of text each; a longer text stands alone."""
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, n, lo = np.cumsum(size), len(size), 0
    while lo < n:
        before = int(ends[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield lo, hi
        lo = hi


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null is empty."""
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """The words of a slice of documents: `start`, `end` (byte offsets in `data`), `hash`, and `first` (index of each document's first word, one more at the end)."""

    def __init__(self, column: pa.Array, lower: bool = False, hashed: bool = True):
        self.data, self.offsets = text_bytes(column)
        data = LOWER[self.data] if lower else self.data
        n = len(data)
        inside = IS_WORD[data]
        cut = np.zeros(n + 1, bool)
        cut[self.offsets] = True
        begins, ends = inside.copy(), inside.copy()
        if n:
            begins[1:] &= ~inside[:-1] | cut[1:n]
            ends[:-1] &= ~inside[1:] | cut[1:n]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.docs = len(self.offsets) - 1
        if hashed:
            up, down = powers(n + 1)
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTE[data] * up[:n], out=total[1:])
            self.hash = mix((total[self.end] - total[self.start]) * down[self.start])

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def windows(self, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of every k consecutive words, by first word; and which of them lie in one document."""
        n = len(self.hash)
        m = max(0, n - k + 1)
        out = np.zeros(m, np.uint64)
        for j in range(k):
            out *= _Q
            out += self.hash[j : j + m] if not seed else mix(self.hash[j : j + m] + _U(seed))
        doc = np.repeat(np.arange(self.docs), self.counts)
        return mix(out + _U(k)), doc[:m] == doc[k - 1 :] if m else np.zeros(0, bool)


def shingle_sets(column: pa.Array, k: int = 5, lower: bool = True) -> Iterator[np.ndarray]:
    """For each document its sorted distinct k-word shingle hashes; with 1 to k-1 words the whole sequence is the one shingle; without words none."""
    words = Words(column, lower)
    grams, _ = words.windows(k)
    for d in range(words.docs):
        lo, hi = words.first[d], words.first[d + 1]
        if hi - lo >= k:
            yield np.unique(grams[lo : hi - k + 1])
        elif hi > lo:
            h, n = 0, int(hi - lo)
            for x in words.hash[lo:hi].tolist():
                h = (h * int(_Q) + x + n) % (1 << 64)
            yield mix(np.array([h], np.uint64))
        else:
            yield np.zeros(0, np.uint64)
