"""Target-distribution importance resampling over hashed n-grams.

Every feature (a run of 1 to `grams` words) falls into a bucket. What a bucket gains is the log ratio of its share in the target's
features and in the documents'; a document weighs the mean gain of its features; Gumbel noise from its id makes drawing without
replacement a matter of the highest scores. Words are made and counted by Arrow kernels: runs of words are pairs of dictionary indices,
so that a checksum is taken once for each distinct run of a slice.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernels import arrow_words
from .shared import written
from .words import slices

BUCKETS = 10_000
RUN = 1 << 16  # ranks of equal rows made at a time


def features(column: pa.Array, grams: int = 2, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of 1, 2, ... `grams` words: the bucket of every run of the slice, in order, and how many each text has."""
    words, home, counts = arrow_words(column)
    coded = words.dictionary_encode()
    first = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    spelled = [w.encode("utf-8") for w in coded.dictionary.to_pylist()]
    sums = [crc32(w) for w in spelled]
    code, n = first, len(first)
    yield np.array(sums, np.int64)[code] % buckets if n else code, counts
    for k in range(1, grams):
        m = max(0, n - k)
        inside = home[:m] == home[k:] if m else np.zeros(0, bool)
        # The run of k words before it and the word after it: both are dictionary indices, and so is their pair.
        pairs = pa.array(code[:m][inside] * max(1, len(spelled)) + first[k:][inside]).dictionary_encode()
        before, after = np.divmod(pairs.dictionary.to_numpy(zero_copy_only=False), max(1, len(spelled)))
        head = [crc32(b" ", s) for s in sums]
        sums = [crc32(spelled[b], head[a]) for a, b in zip(before.tolist(), after.tolist(), strict=True)]
        code = np.full(m, -1, np.int64)
        code[inside] = pairs.indices.to_numpy(zero_copy_only=False)
        yield np.array(sums, np.int64)[code[inside]] % buckets if len(sums) else np.zeros(0, np.int64), np.maximum(counts - k, 0)


def histogram(texts: DataFrame, grams: int = 2, buckets: int = BUCKETS, text_col: str = "text") -> DataFrame:
    """(bucket, n): how many features of each task's texts fall into each bucket; buckets without any are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for lo, hi in slices(batch.column(0)):
                for bucket, _ in features(batch.column(0).slice(lo, hi - lo), grams, buckets):
                    total += np.bincount(bucket, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    return texts.select(texts[text_col].cast("string").alias("text")).mapInArrow(run, "bucket long, n long")


def gains(docs: DataFrame, target: DataFrame, grams: int = 2, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln) of the smoothed ratio of each bucket's share in the target and in the documents; `buckets` numbers reach the driver."""
    spark = docs.sparkSession
    both = histogram(target, grams, buckets).withColumn("side", F.lit("t")).unionByName(histogram(docs, grams, buckets).withColumn("side", F.lit("s")))
    wide = both.groupBy("bucket").agg(*[F.coalesce(F.sum(F.when(F.col("side") == x, F.col("n"))), F.lit(0)).alias(x) for x in "ts"])
    found = spark.range(buckets).withColumnRenamed("id", "bucket").join(wide, "bucket", "left").select("bucket", *[F.coalesce(x, F.lit(0)).alias(x) for x in "ts"]).collect()
    t, s = np.zeros(buckets), np.zeros(buckets)
    for row in found:
        t[row.bucket], s[row.bucket] = row.t, row.s
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray, grams: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features and weight: the floored mean of the gains of a document's features, 0 without any."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                words = total = summed = 0
                for bucket, counts in features(batch.column(1).slice(lo, hi - lo), grams, len(gain)):
                    ends = np.cumsum(counts)
                    so_far = np.concatenate([[0], np.cumsum(gain.take(bucket))])
                    summed = summed + so_far[ends] - so_far[ends - counts]
                    words = words if isinstance(words, np.ndarray) else counts
                    total = total + counts
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *[pa.array(x.astype(np.int64)) for x in (words, total, summed // np.maximum(total, 1))]], ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(seed: int) -> F.Column:
    """floor(1000 x) of a standard Gumbel draw x that `seed` and doc_id fix; a null doc_id counts as an empty string."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, grams: int = 2, buckets: int = BUCKETS) -> DataFrame:
    """Draw `percent` % of the documents of `least_words` words or more by how much they look like the target's texts.

    Gives doc_id, n_words, n_features, weight, score and rank: 1 for the highest score, ties to the smaller doc_id, null for what is not
    drawn. Null and empty texts have no features and weigh 0; a null doc_id comes first among ties; rows that repeat a doc_id are documents
    of their own, each with a rank (equal rows in any order); long texts are taken whole; an empty table gives no row, an empty target
    gains from smoothing alone; other columns are ignored. Ranks need no global sort: scores are whole numbers between sums of logarithms,
    at most some 200,000 different ones for any input, so their counts tell where each score's ranks begin, and the noise spreads the
    documents over thousands of them.
    """
    spark = docs.sparkSession
    scored = written(weights(docs, gains(docs, target, grams, buckets), grams).withColumn("score", F.col("weight") + noise(seed)), "scored")
    able = F.col("n_words") >= least_words
    levels = scored.where(able).groupBy("score").agg(F.count("*").alias("n")).orderBy(F.desc("score")).collect()
    limit, begun, starts = percent * sum(r.n for r in levels) // 100, 0, []
    for row in levels:
        if begun >= limit:
            break
        starts.append((row.score, begun))
        begun += row.n
    lowest = starts[-1][0] if starts else None
    high = able & (F.col("score") >= lowest) if starts else F.lit(False)
    names = ["doc_id", "n_words", "n_features", "weight", "score"]
    # Equal rows are counted before they meet, so that one doc_id in very many rows is one row of the window.
    drawn = scored.where(high).groupBy(names).agg(F.count("*").alias("n"))
    order = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_first(), "n_words", "n_features", "weight")
    before = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    begins = spark.createDataFrame(starts, "score long, begun long")
    ranked = drawn.withColumn("before", before).join(F.broadcast(begins), "score").select(*names, (F.col("begun") + F.col("before") + 1).alias("low"), (F.col("begun") + F.col("before") + F.col("n")).alias("high"))
    ranked = ranked.select(*names, "high", F.explode(F.sequence("low", "high", F.lit(RUN))).alias("low"))
    ranked = ranked.select(*names, F.explode(F.sequence("low", F.least("high", F.col("low") + (RUN - 1)))).alias("rank"))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= limit, F.col("rank")))
    return ranked.unionByName(scored.where(~F.coalesce(high, F.lit(False))).withColumn("rank", F.lit(None).cast("long")))
