"""Ranked lexical search: term-at-a-time with a limited set of accumulators.

Every task ranks its documents for all items of a block. For an item its terms come rarest first. As long as the terms still to come
could lift a document that has no accumulator to the k-th best partial score, postings make accumulators; from there on they only add to
those there are, so that survivors get their exact scores. The k best of every task meet at the end.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from .kernels import arrow_words
from .words import slices

SLICE_BYTES = 8 << 20  # of text whose postings a task holds at a time
BLOCK_BYTES = 16 << 20  # of items searched in one pass over the documents
SALTS = 64


class Postings:
    """Of a slice of texts: `counts` (terms of each text), and the texts and occurrences of each of the given terms, ordered by term."""

    def __init__(self, column: pa.Array, terms: pa.Array):
        words, home, self.counts = arrow_words(column)
        which = pc.index_in(words, value_set=terms)
        known = pc.is_valid(which).to_numpy(zero_copy_only=False)
        which = which.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
        size = max(1, len(column))
        pairs, self.often = np.unique(which * size + home[known], return_counts=True)
        term, self.text = np.divmod(pairs, size)
        self.term, self.edges = term, np.searchsorted(term, np.arange(len(terms) + 1))


def best(found: Postings, item: list[tuple[int, int]], worth: np.ndarray, bound: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts of the slice that may be among an item's k best, with their scores: all that score at least as high as the k-th here and `least`.

    `item` holds (term, times) rarest first, `worth` what each posting is worth, `bound` the most a posting of each term is worth.
    """
    left = np.cumsum([times * bound[t] for t, times in reversed(item)])[::-1].tolist()
    sums, alive, growing = np.zeros(len(found.counts), np.int64), np.zeros(len(found.counts), bool), True
    for (t, times), rest in zip(item, left, strict=True):
        lo, hi = found.edges[t], found.edges[t + 1]
        if lo == hi:
            continue
        if growing and rest < max(least, np.partition(sums, len(sums) - k)[len(sums) - k] if len(sums) >= k else 0):
            growing = False
        text, adds = found.text[lo:hi], times * worth[lo:hi]
        if growing:
            alive[text] = True
        else:
            old = alive[text]
            text, adds = text[old], adds[old]
        sums[text] += adds  # a text occurs once in a term's postings
    at = np.flatnonzero(sums >= max(1, least))
    if len(at) > k:
        at = at[sums[at] >= np.partition(sums[at], len(at) - k)[len(at) - k]]
    return at, sums[at]


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[Row]]:
    """The items in blocks of about BLOCK_BYTES, each fetched alone; repeated items are spread by a random number fixed by their task."""
    rows = items.select(items[id_col].cast("long").alias("item_id"), items[text_col].cast("string").alias("text")).where("text is not null")
    size = rows.agg(F.sum(F.octet_length("text") + 16).alias("n")).first().n or 0
    n = -(-size // BLOCK_BYTES)
    if n > 1:
        rows = rows.withColumn("block", F.pmod(F.xxhash64("item_id", "text", F.monotonically_increasing_id()), F.lit(n)))
    for b in range(n):
        yield (rows.where(F.col("block") == b).drop("block") if n > 1 else rows).collect()


def _statistics(rows: DataFrame, terms: pa.Array) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms of all documents, and documents that hold each of the given terms."""
    n = len(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n + 2, np.int64)
        for batch in batches:
            for lo, hi in slices(batch.column(1), SLICE_BYTES):
                found = Postings(batch.column(1).slice(lo, hi - lo), terms)
                total[:n] += np.diff(found.edges)
                total[n] += np.count_nonzero(found.counts)
                total[n + 1] += found.counts.sum()
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["at", "n"])

    total = np.zeros(n + 2, np.int64)
    for row in rows.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        total[row.at] = row.n
    return int(total[n]), int(total[n + 1]), total[:n]


def _search(rows: DataFrame, block: list[Row], k: int) -> DataFrame:
    """key (the item's place in the block), item_id, doc_id and score: the k best documents of every task for each item of a block."""
    spark = rows.sparkSession
    words, home, _ = arrow_words(pa.array([r.text for r in block], pa.string()))
    coded = words.dictionary_encode()
    terms = coded.dictionary
    n_docs, n_terms, held = _statistics(rows, terms)
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in held], np.int64)
    own: list[Counter] = [Counter() for _ in block]
    for at, t in zip(home.tolist(), coded.indices.to_pylist(), strict=True):
        own[at][t] += 1
    shared = spark.sparkContext.broadcast((terms, weight, [(r.item_id, sorted(c.items(), key=lambda x: (held[x[0]], x[0]))) for r, c in zip(block, own, strict=True)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, weight, items = shared.value
        top: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(items)
        for batch in batches:
            valid = pc.is_valid(batch.column(0)).to_numpy(zero_copy_only=False)
            ids = pc.fill_null(batch.column(0), 0).to_numpy(zero_copy_only=False)
            for lo, hi in slices(batch.column(1), SLICE_BYTES):
                found = Postings(batch.column(1).slice(lo, hi - lo), terms)
                if not len(found.text):
                    continue
                fill = 75 + 25 * found.counts * n_docs // n_terms
                worth = weight[found.term] * (1_000_000_000 * found.often // (1000 * found.often + 12 * fill[found.text]))
                bound = np.zeros(len(terms), np.int64)
                np.maximum.at(bound, found.term, worth)
                for i, (_, item) in enumerate(items):
                    known, doc, score = top[i]
                    at, sums = best(found, item, worth, bound, k, int(score[-1]) if len(score) >= k else 0)
                    if len(at):
                        known, doc, score = np.concatenate([known, valid[lo:hi][at]]), np.concatenate([doc, ids[lo:hi][at]]), np.concatenate([score, sums])
                        order = np.lexsort((doc, known, -score))[:k]
                        top[i] = known[order], doc[order], score[order]
        for i, (known, doc, score) in enumerate(top):
            if len(doc):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), i, np.int64)), pa.array([items[i][0]] * len(doc), pa.int64()), pa.array(doc, mask=~known), pa.array(score)], ["key", "item_id", "doc_id", "score"])

    return rows.mapInArrow(run, "key long, item_id long, doc_id long, score long")


def rank(docs: DataFrame, items: DataFrame, k: int = 20, item_col: str = "item_id", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each item's k documents of highest score above 0: item_id, rank, doc_id, score; equal scores by ascending doc_id, a null doc_id first.

    The score sums, over the item's terms with repeats, the term's weight by its rarity times its saturated frequency in the document,
    less in long documents; all in whole numbers. Null and empty texts on either side have no terms and give nothing; an empty table gives
    no row; every row is an item or a document of its own, also where rows repeat an id; long texts are taken whole; other columns are
    ignored. Items are searched in blocks of BLOCK_BYTES, each two passes over the documents: one counts, one searches.
    """
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    schema, out = "item_id long, rank int, doc_id long, score long", None
    for block in _blocks(items, item_col, text_col):
        found = _search(rows, block, k)
        order = [F.desc("score"), F.col("doc_id").asc_nulls_first()]
        for keys in (["key", "salt"], ["key"]):  # tasks' lists are cut to k in parts before an item's meet
            found = found.withColumn("salt", F.spark_partition_id() % SALTS) if "salt" in keys else found
            found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
        part = found.select("item_id", "rank", "doc_id", "score")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)
