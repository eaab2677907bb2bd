"""Keyed entries in packed rows: what the pair and repeat operators shuffle instead of a row for each word window.

An entry is a 64-bit key of a document. Entries are dealt to 2**bits buckets by the key's top bits; one row holds all entries of one
bucket from one slice of the input, its documents in order: how many entries each has, and 6 or 8 bytes a key.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LOW = np.uint64((1 << 48) - 1)
MOST_BITS = 20


def text_size(docs: DataFrame, text_col: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string"))).alias("n")).first().n or 0


def bits_for(size: int, each: int, least: int = 2) -> int:
    """log2 of the number of buckets of about `each` bytes that `size` bytes need; at most MOST_BITS: beyond that many buckets, rows would hold an entry each."""
    return min(MOST_BITS, max(least, math.ceil(math.log2(max(1, size / each)))))


def keys_to_bytes(keys: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def narrowed(keys: np.ndarray, bits: int) -> np.ndarray:
    """Keys as 6 bytes and the bucket's number hold them: no two that differ in their top `bits` or in their low 48 bits are confused."""
    return (top(keys, bits).astype(np.uint64) << np.uint64(min(48, 64 - bits))) | (keys & _LOW)


def keys_from_bytes(data: bytes, width: int, bucket: int = 0, bits: int = 16) -> np.ndarray:
    """The keys of a bucket; with 6 bytes a key as `narrowed` gives them."""
    if width == 8:
        return np.frombuffer(data, "<u8")
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel() | (np.uint64(bucket) << np.uint64(min(48, 64 - bits)))


def dealt(bucket: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(bucket, its entries' places, its documents, entries of each); entries must come ordered by document."""
    if not len(bucket):
        return
    order = np.argsort(bucket.astype(np.uint16 if bucket.max() < 1 << 16 else np.uint32), kind="stable")
    at = bucket[order]
    edges = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    for s, e in zip(edges, [*edges[1:], len(at)], strict=True):
        own = order[s:e]
        d = doc[own]
        cut = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
        yield int(at[s]), own, d[cut], np.diff(np.concatenate([cut, [len(d)]]))


def top(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64)
