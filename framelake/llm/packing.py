"""Packing: documents in the order of a Hilbert curve through hashed document vectors, laid end to end and cut into sequences.

A document's token ids are hashed into a vector, which a fixed random matrix projects to a few dimensions; the cell it falls into has a
place on the Hilbert curve, so documents of like words come near each other. A range sort by that place and a sum of each partition's
tokens give every document its place in one long run of ids, which is cut every `length` ids: only the very last sequence has padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written
from .token_files import column_encoder
from .words import mix, slices
from .worker import release

HASHED, DIMS, BITS, REACH = 256, 4, 15, 4.0  # sizes of a hashed vector and of its projection; bits of a coordinate between -REACH and REACH
PART_ROWS = 1 << 20  # documents in a range of the curve
SLICE_BYTES = 4 << 20  # of text encoded at a time


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of rows of `bits`-bit coordinates (J. Skilling, Programming the Hilbert curve, 2004, on arrays)."""
    x = [c.astype(np.int64) for c in np.asarray(cells).T]
    for b in range(bits - 1, 0, -1):
        q, low = 1 << b, (1 << b) - 1
        for i in range(len(x)):
            hit = (x[i] & q) != 0
            swap = np.where(hit, 0, (x[0] ^ x[i]) & low)
            x[i] = x[i] ^ swap
            x[0] = np.where(hit, x[0] ^ low, x[0] ^ swap if i else x[0])
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] & (1 << b)) != 0, (1 << b) - 1, 0)
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for c in x:
            key = key << 1 | (c ^ flip) >> b & 1
    return key


def curve_places(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The place on the curve of each document, given the ids of all of them in turn."""
    named = mix(np.arange(int(ids.max()) + 1 if len(ids) else 1, dtype=np.uint64) + np.uint64(1))
    slot, sign = (named % np.uint64(HASHED)).astype(np.int64), np.where(named >> np.uint64(63) > 0, 1.0, -1.0)
    doc = np.repeat(np.arange(len(counts)), counts)
    vectors = np.bincount(doc * HASHED + slot[ids], weights=sign[ids], minlength=len(counts) * HASHED).reshape(len(counts), HASHED)
    vectors = np.sign(vectors) * np.sqrt(np.abs(vectors))  # frequent words count less
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    places = vectors @ np.random.default_rng(11).standard_normal((HASHED, DIMS))
    return hilbert(np.clip((places + REACH) / (2 * REACH) * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64), BITS)


def encoded(docs: DataFrame, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, place (on the curve), n_tokens and ids (2 or 4 bytes each) of every document, the end id last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = column_encoder(tokenizer_path)
        for batch in batches:
            for lo, hi in slices(batch.column(1), SLICE_BYTES):
                ids, counts = coder.column(batch.column(1).slice(lo, hi - lo))
                ids, counts = np.insert(ids, np.cumsum(counts), end_id), counts + 1
                bounds = np.concatenate([[0], np.cumsum(counts)]) * ids.itemsize
                own = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(ids)])
                place = curve_places(ids, counts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(place), pa.array(counts), own], ["doc_id", "place", "n_tokens", "ids"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, place long, n_tokens long, ids binary")


def along_curve(coded: DataFrame, partitions: int) -> DataFrame:
    """row, part and before of every document in order of (place, doc_id, row): the range partition it is in and the tokens before it there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        part, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            counts = batch.column(1).to_numpy()
            before = done + np.cumsum(counts) - counts
            done += int(counts.sum())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.full(len(counts), part, np.int64)), pa.array(before)], ["row", "n_tokens", "part", "before"])

    order = [F.col("place"), F.col("doc_id").asc_nulls_first(), F.col("row")]
    rows = coded.select("place", "doc_id", "row", "n_tokens").repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    return rows.select("row", "n_tokens").mapInArrow(run, "row long, n_tokens long, part long, before long")


def pack(docs: DataFrame, tokenizer_path: str, length: int = 4096, end_id: int = 2, partitions: int | None = None) -> DataFrame:
    """The pieces of all documents in sequences of `length` tokens: doc_id, start (tokens of its document before it), length, ids (little-
    endian unsigned 32-bit), doc_tokens, sequence_id and offset (place in its sequence).

    Every token is in one piece, and sequences are full but for the last. Null and empty texts hold the end id only; a null doc_id comes
    first among documents of one place; rows that repeat a doc_id are documents of their own; a document longer than a sequence runs on
    over as many as it needs; an empty table gives no piece; other columns are ignored. Texts are encoded once: their ids are written to
    the shared folder, and only places and counts are sorted by range of the curve; copies of one text have one place and are told apart by
    doc_id and row, so that a large group of copies is dealt to many tasks. Tasks lost later on read these tables again.
    """
    spark = docs.sparkSession
    coded = written(encoded(docs, tokenizer_path, end_id).withColumn("row", F.monotonically_increasing_id()), "coded")
    n = partitions or max(2 * spark.sparkContext.defaultParallelism, -(-coded.count() // PART_ROWS))
    curve = written(along_curve(coded, n), "curve")
    begins, at = [], 0
    for row in curve.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect():
        begins.append((row.part, at))
        at += row.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        for batch in batches:
            counts, first = batch.column(1).to_numpy(), batch.column(3).to_numpy()
            pieces = (first + counts - 1) // length - first // length + 1
            of = np.repeat(np.arange(len(counts)), pieces)
            sequence = first[of] // length + np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            lo, hi = np.maximum(first[of], sequence * length), np.minimum((first + counts)[of], (sequence + 1) * length)
            start = lo - first[of]
            ids = []
            for d, s, e in zip(of.tolist(), start.tolist(), (start + hi - lo).tolist(), strict=True):
                own = batch.column(2)[d].as_buffer()
                width = own.size // int(counts[d])
                ids.append(np.frombuffer(own, f"<u{width}")[s:e].astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), pa.array(start), pa.array(hi - lo), pa.array(ids, pa.binary()), pa.array(counts[of]), pa.array(sequence), pa.array(lo - sequence * length)], names)

    # One row a range partition is broadcast; the places of the documents meet their ids by `row`.
    places = curve.join(F.broadcast(spark.createDataFrame(begins, "part long, begin long")), "part").select("row", (F.col("begin") + F.col("before")).alias("first"))
    laid = coded.select("row", "doc_id", "n_tokens", "ids").join(places.hint("shuffle_hash"), "row").select("doc_id", "n_tokens", "ids", "first")
    return laid.mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def sequences(pieces: DataFrame, length: int = 4096) -> DataFrame:
    """The pieces put together: sequence_id, n_tokens, ids (zero-padded to `length` ids), and doc_ids, starts and offsets of its pieces."""
    own = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids")))
    rows = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), own.alias("own"))
    joined = F.aggregate("own", F.lit(b""), lambda done, p: F.concat(done, p["ids"]))
    return rows.select("sequence_id", "n_tokens", F.rpad(joined, length * 4, F.lit(b"\x00")).alias("ids"), F.col("own.doc_id").alias("doc_ids"), F.col("own.start").alias("starts"), F.col("own.offset").alias("offsets"))
