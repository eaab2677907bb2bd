"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Items are parted by the size of their shingle set. For a part whose largest item has u shingles a document is cut into strides of u
shingles and each two neighbouring strides are one domain, so that a passage of an item's length lies whole in some domain of at most
twice its size: the domains' sizes, and with them the Jaccard similarity that a contained item must have, are bounded below whatever
the document's length. Domains and items meet where one of PERMUTATIONS min-hashes is equal (bands of one row). Items of the smallest
part, which a domain of twice the part's size would miss too often, are looked up exactly: a document that holds enough of an item's n
shingles holds one of any n - enough + 1 of them, and the ones rarest among the items are taken. Candidates are
verified against the document's whole shingle set. With `exact` items of every size are looked up like the smallest: then no item is
missed, not even one whose shingles lie scattered over a document, at a cost that grows with how common the items' shingles are.

Items are hashed by tasks and written to the shared folder; the driver fetches and sends out one block of at most about BLOCK_BYTES at a
time, so neither it nor a task holds more, however many items there are. Each further block is one more pass over the documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written
from .words import Words, mix, shingle_sets, slices
from .worker import release

K = 5  # words a shingle
CONTAINMENT = 0.75
PERMUTATIONS = 32
BLOCK_BYTES = 64 << 20  # of hashes in a block of items
SIZE_PARTS = (8, 16, 32, 64, 128, 256, 512)  # upper shingle counts of the parts; larger items fall in powers of two beyond

_SEEDS = mix(np.arange(1, 129, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


def _part(n: int) -> int:
    u = next((p for p in SIZE_PARTS if n <= p), SIZE_PARTS[-1])
    while u < n:
        u *= 2
    return u


class ItemIndex:
    """The shingle sets of a block of items, the shingles that small ones are looked up by, and by size part the sorted min-hashes of the others."""

    def __init__(self, rows: list, containment: float):
        """rows: of _ITEMS."""
        self.ids = [r["item"] for r in rows]
        self.sets = [np.frombuffer(r["tokens"], "<u8") for r in rows]
        self.need = [int(np.ceil(containment * len(s) - 1e-9)) for s in self.sets]
        self.short: dict[int, dict[int, list[int]]] = {}
        by_part: dict[int, list[int]] = {}
        small = []
        for i, r in enumerate(rows):
            if r["words"]:
                self.short.setdefault(r["words"], {}).setdefault(r["brief"] % (1 << 64), []).append(i)
            elif r["hashes"]:
                by_part.setdefault(_part(len(self.sets[i])), []).append(i)
            else:
                small.append(i)
        keys, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        if small:
            values, counts = np.unique(np.concatenate([self.sets[i] for i in small]), return_counts=True)
            for i in small:
                own = self.sets[i]
                rare = np.argsort(counts[np.searchsorted(values, own)], kind="stable")[: len(own) - self.need[i] + 1]
                keys.append(own[rare])
                owners.append(np.full(len(rare), i))
        every = np.concatenate(keys)
        order = np.argsort(every, kind="stable")
        self.keys, self.owners = every[order], np.concatenate(owners)[order]
        self.parts = []
        for u, members in sorted(by_part.items()):
            hashes = np.stack([np.frombuffer(rows[i]["hashes"], "<u8") for i in members])
            order = np.argsort(hashes, axis=0, kind="stable")
            self.parts.append((u, np.array(members), np.take_along_axis(hashes, order, 0), order))

    def candidates(self, grams: np.ndarray, sizes: np.ndarray) -> set[tuple[int, int]]:
        """(document, item) pairs with an equal min-hash in some domain or, for small items, a shingle in common; grams: shingles in text order, sizes: how many each document has."""
        found: set[tuple[int, int]] = set()
        if not len(grams):
            return found
        if len(self.keys):
            lo = np.searchsorted(self.keys, grams, "left")
            at = np.flatnonzero(self.keys[np.minimum(lo, len(self.keys) - 1)] == grams)
            hi = np.searchsorted(self.keys, grams[at], "right")
            doc = np.repeat(np.arange(len(sizes)), sizes)[at]
            for d, a, b in zip(doc.tolist(), lo[at].tolist(), hi.tolist(), strict=True):
                found.update((d, m) for m in self.owners[a:b].tolist())
        if not self.parts:
            return found
        unit = self.parts[0][0]
        strides = -(-sizes // unit)
        at = _cuts(np.cumsum(sizes) - sizes, strides, unit)
        for j in range(PERMUTATIONS):
            fine = np.minimum.reduceat(grams * _SEEDS[j], at)
            for u, members, hashes, order in self.parts:
                low, per_doc = fine, strides
                if u > unit:
                    per_doc = -(-strides * unit // u)
                    low = np.minimum.reduceat(fine, _cuts(np.cumsum(strides) - strides, per_doc, u // unit))
                doc = np.repeat(np.arange(len(sizes)), per_doc)
                pair = low.copy()
                joined = doc[:-1] == doc[1:]
                pair[:-1][joined] = np.minimum(low[:-1][joined], low[1:][joined])
                column = hashes[:, j]
                lo, hi = np.searchsorted(column, pair, "left"), np.searchsorted(column, pair, "right")
                for i in np.flatnonzero(hi > lo):
                    found.update((int(doc[i]), m) for m in members[order[lo[i] : hi[i], j]].tolist())
        return found


def _cuts(first: np.ndarray, counts: np.ndarray, step: int) -> np.ndarray:
    """first[d], first[d] + step, ... - counts[d] of them for each d."""
    return np.repeat(first, counts) + step * (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts))


_ITEMS = "item long, words int, brief long, tokens binary, hashes binary"


def _hashed(items: DataFrame, item_col: str, item_text: str, k: int, exact: bool) -> DataFrame:
    """A row an item with a word: its shingles and, beyond the smallest part, its min-hashes. An item with fewer than k words has no k-word
    shingle: `words` then says how many, and `brief` is the hash of the whole sequence, which is looked for as it stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                texts = batch.column(1).slice(lo, hi - lo)
                words = Words(texts, lower=True)
                windows = {n: words.windows(n)[0] for n in range(1, k)}
                rows = []
                for i, (n, tokens) in enumerate(zip(words.counts.tolist(), shingle_sets(texts, k), strict=True)):
                    if 0 < n < k:
                        rows.append((i, n, int(windows[n][words.first[i]].view(np.int64)), b"", b""))
                    elif n:
                        hashes = (tokens[None, :] * _SEEDS[:PERMUTATIONS, None]).min(1) if len(tokens) > SIZE_PARTS[0] and not exact else np.zeros(0, np.uint64)
                        rows.append((i, 0, 0, tokens.astype("<u8").tobytes(), hashes.astype("<u8").tobytes()))
                ids = batch.column(0).slice(lo, hi - lo).take(pa.array([r[0] for r in rows], pa.int64()))
                columns = [pa.array([r[c] for r in rows], t) for c, t in ((1, pa.int32()), (2, pa.int64()), (3, pa.binary()), (4, pa.binary()))]
                yield pa.RecordBatch.from_arrays([ids, *columns], ["item", "words", "brief", "tokens", "hashes"])

    return items.select(items[item_col].cast("long").alias("i"), items[item_text].cast("string").alias("t")).where("i IS NOT NULL AND t IS NOT NULL").mapInArrow(run, _ITEMS)


def _blocks(items: DataFrame, item_col: str = "item_id", item_text: str = "text", k: int = K, containment: float = CONTAINMENT, exact: bool = False) -> list[Callable[[], ItemIndex]]:
    """What makes the index of each block of items, dealt at random."""
    table = written(_hashed(items, item_col, item_text, k, exact).withColumn("place", F.xxhash64(F.monotonically_increasing_id())), "items")
    size = table.agg(F.sum(F.octet_length("tokens") + F.octet_length("hashes") + 64).alias("n")).first().n or 0
    n = -(-size // BLOCK_BYTES)
    return [lambda b=b: ItemIndex(table.where(F.pmod("place", F.lit(n)) == b).orderBy("place").collect(), containment) for b in range(n)]


def _hits(index: ItemIndex, texts: pa.Array, k: int) -> list[tuple[int, int, float]]:
    """(row, item id, containment) of every item held by a text."""
    hits: list[tuple[int, int, float]] = []
    for lo, hi in slices(texts):
        words = Words(texts.slice(lo, hi - lo), lower=True)
        grams, inside = words.windows(k)
        sizes = np.maximum(words.counts - k + 1, 0)
        of, have = -1, grams
        for d, i in sorted(index.candidates(grams[inside], sizes)):
            if d != of:
                a = int(words.first[d])
                of, have = d, np.unique(grams[a : a + sizes[d]])
            s = index.sets[i]
            common = int((have[np.minimum(np.searchsorted(have, s), len(have) - 1)] == s).sum())
            if common >= index.need[i]:
                hits.append((lo + d, index.ids[i], common / len(s)))
        for n, table in index.short.items():
            brief, inside = words.windows(n)
            doc = np.repeat(np.arange(words.docs), words.counts)
            at = np.flatnonzero(inside & np.isin(brief, np.array(list(table), np.uint64)))
            for d, h in sorted(set(zip(doc[at].tolist(), brief[at].tolist(), strict=True))):
                hits += [(lo + d, index.ids[i], 1.0) for i in table[h]]
    return hits


def find(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", k: int = K, containment: float = CONTAINMENT, exact: bool = False) -> DataFrame:
    """Pairs (doc_id, item_id, containment) where a document holds at least `containment` of an item's distinct k-word shingles.

    Words are split at white space, A-Z lower-cased. An item with fewer than k words is held where its word sequence stands in the
    document. Null and empty texts, on either side, and null item ids match nothing; repeated items or documents give repeated pairs; an
    empty table gives no pair; documents and items of any length are searched whole; other columns are ignored. `exact`: without MinHash,
    by the items' rarest shingles. Narrow: no document is shuffled.
    """
    rows = docs.select(docs[id_col].cast("long").alias(id_col), docs[text_col].cast("string").alias(text_col))
    schema = f"{id_col} long, item_id long, containment double"
    out = None
    for block in _blocks(items, item_col, item_text, k, containment, exact):
        held = docs.sparkSession.sparkContext.broadcast(block())

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            release()
            for batch in batches:
                hits = _hits(held.value, batch.column(1), k)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([h[0] for h in hits], pa.int64())), pa.array([h[1] for h in hits], pa.int64()), pa.array([h[2] for h in hits], pa.float64())], [id_col, "item_id", "containment"])

        found = rows.mapInArrow(run, schema)
        out = found if out is None else out.unionAll(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def without_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, containment: float = CONTAINMENT, exact: bool = False) -> DataFrame:
    """The rows of `docs` that hold no item, with their columns, whatever these are named; judged row by row, in one narrow pass for each block of items.

    Null and empty texts hold nothing and stay; repeated rows go or stay together; an empty table on either side takes nothing away. Rows
    are written to the shared folder between blocks, so that a task holds one block only.
    """
    place = docs.columns.index(text_col)
    for n, block in enumerate(_blocks(items, k=k, containment=containment, exact=exact)):
        held = docs.sparkSession.sparkContext.broadcast(block())

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            release()
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for row, _, _ in _hits(held.value, batch.column(place), k):
                    clean[row] = False
                yield batch.filter(pa.array(clean))

        docs = (written(docs, "clean") if n else docs).mapInArrow(run, docs.schema)
    return docs
