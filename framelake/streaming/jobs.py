"""Structured Streaming twins of the incremental operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..sources.store import scratch, written


def run_available(stream: DataFrame, mode: str, keys: list[str] | None = None, order: str | None = None) -> DataFrame:
    """Drive a stream over what there is and return its result table.

    append: rows as they come. complete: the last state. update: with `keys` and `order`, the latest row of each key.
    """
    spark = stream.sparkSession
    base = scratch(spark, "stream")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{base}/out").start()
    else:
        # Each batch in a folder of its own: a batch that is tried again writes the same folder.
        query = writer.foreachBatch(lambda df, n: df.withColumn("batch", F.lit(n).cast("long")).write.mode("overwrite").parquet(f"{base}/out/n={n:09d}")).start()
    query.awaitTermination()
    schema = stream.schema if mode == "append" else stream.schema.add("batch", "long")
    out = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{base}/out")
    if mode == "complete":
        return out.join(out.agg(F.max("batch").alias("batch")), "batch").drop("batch")
    if mode == "update" and keys:
        w = Window.partitionBy(*keys).orderBy(F.col("batch").desc(), *([F.col(order).desc()] if order else []))
        return out.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k", "batch")
    return out.drop("batch") if mode != "append" else out


def read_stream(spark: SparkSession, pattern: str, schema, files: int = 1) -> DataFrame:  # noqa: ANN001
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(pattern)


def _one(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """A key's rows of a batch as one frame; most keys have few rows, which one Arrow batch holds, so that nothing is copied."""
    parts = list(batches)
    return parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)


def incremental_frame_index(headers: DataFrame) -> DataFrame:
    """stream, pos, coding_order, display_index, shown_id for headers appended over time; a position that falls back starts the stream anew.

    State of a stream: last position, next coding order, next display index, the frame in each of 8 slots.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, coded, shown, slots = (*state.get[:3], list(state.get[3])) if state.exists else (-1, 0, 0, [-1] * 8)
        out = []
        rows = _one(batches)
        columns = [rows[c].tolist() for c in ("pos", "show_existing", "map_idx", "coded_id", "refresh_flags", "show_frame")]
        for pos, show_existing, map_idx, coded_id, refresh_flags, show_frame in sorted(zip(*columns, strict=True), key=lambda h: h[0]):
            if pos <= last:
                last, coded, shown, slots = -1, 0, 0, [-1] * 8
            last = int(pos)
            order = index = ident = None
            if show_existing == 1:
                held = slots[int(map_idx)]
                index, ident, shown = shown, (held if held >= 0 else None), shown + 1
            else:
                order, coded = coded, coded + 1
                slots = [int(coded_id) if int(refresh_flags) >> k & 1 else s for k, s in enumerate(slots)]
                if show_frame == 1:
                    index, ident, shown = shown, int(coded_id), shown + 1
            out.append((key[0], last, order, index, ident))
        state.update((last, coded, shown, slots))
        named = dict(zip(("stream", "pos", "coding_order", "display_index", "shown_id"), zip(*out, strict=True), strict=True))
        yield pd.DataFrame({c: pd.array(v, "Int64") if c in ("coding_order", "display_index", "shown_id") else list(v) for c, v in named.items()})

    return headers.groupBy("stream").applyInPandasWithState(fold, "stream long, pos long, coding_order long, display_index long, shown_id long", "last long, coded long, shown long, slots array<long>", "append", GroupStateTimeout.NoTimeout)


def late_sse_join(bits: DataFrame, sse: DataFrame, bound: str) -> DataFrame:
    """key, ts, bits, sse, state: bits with the errors that arrive within `bound` of them, `ok`; bits whose wait is over without any come out as `skipped`.

    Both sides: key, ts and own columns. A row without a key (the end mark of `replayed`) only moves the clock. Keys meet as structs, which are
    never null and, without a key, differ by side: of plain keys the nulls are filtered out ahead of the watermark, which then stands still.
    """
    meet = lambda side: F.struct("key", F.when(F.col("key").isNull(), side).alias("side"))
    b = bits.withColumn("bits_key", meet(0)).withWatermark("ts", bound)
    s = sse.select(meet(1).alias("sse_key"), F.col("ts").alias("sse_ts"), "sse").withWatermark("sse_ts", bound)
    on = (F.col("bits_key") == F.col("sse_key")) & (F.col("sse_ts") >= F.col("ts")) & (F.col("sse_ts") <= F.col("ts") + F.expr(f"INTERVAL {bound}"))
    return b.join(s, on, "leftOuter").select("key", "ts", "bits", "sse", F.when(F.col("sse_key").isNull(), "skipped").otherwise("ok").alias("state"))


def running_totals(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Totals usable at any time (update or complete mode)."""
    return samples.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def causal_smooth(series: DataFrame, q: float, r: float) -> DataFrame:
    """series, frame, v, smooth: the causal filter, whose state (two means, three covariances) goes on from batch to batch."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = state.get if state.exists else None
        rows = pd.concat(list(batches)).sort_values("frame")
        out = []
        for v in rows["v"]:
            if known is None:
                x0, x1, p00, p01, p11 = float(v), 0.0, 1e6 * max(r, 1e-9), 0.0, 1e6 * max(r, 1e-9)
            else:
                x0, x1, p00, p01, p11 = known
                x0, p00, p01, p11 = x0 + x1, p00 + 2 * p01 + p11 + q / 4, p01 + p11 + q / 2, p11 + q
            g0, g1, gap = p00 / (p00 + r), p01 / (p00 + r), float(v) - x0
            known = (x0 + g0 * gap, x1 + g1 * gap, (1 - g0) * p00, (1 - g0) * p01, p11 - g1 * p01)
            out.append(known[0])
        state.update(known)
        yield pd.DataFrame({"series": key[0], "frame": rows["frame"].to_numpy(), "v": rows["v"].to_numpy(), "smooth": out})

    return series.groupBy("series").applyInPandasWithState(fold, "series string, frame long, v double, smooth double", "x0 double, x1 double, p00 double, p01 double, p11 double", "append", GroupStateTimeout.NoTimeout)


def bitrate_window(frames: DataFrame, width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """kbps of each stream over tumbling or sliding windows of event time."""
    seconds = F.unix_timestamp(F.col("w.end")) - F.unix_timestamp(F.col("w.start"))
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    g = frames.withWatermark("ts", late).groupBy(w.alias("w"), "stream").agg(F.count("*").alias("frames"), F.sum("bytes").alias("bytes"))
    return g.select("stream", F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "frames", "bytes", (F.col("bytes") * 8 / seconds / 1000).alias("kbps"))


def picture_session(slices: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """Groups of slices of a stream with less than `gap` between neighbours."""
    g = slices.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "stream").agg(F.count("*").alias("slices"))
    return g.select("stream", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "slices")


def marked_pictures(slices: DataFrame, quiet_ms: int, late: str = "1 hour") -> DataFrame:
    """stream, coding_order, poc, idr, slices, slice_type_ids of every picture once it is whole: the streaming form of `frames.assemble_pictures`.

    slices: stream, ts, pos, first_mb, poc, nal_type, slice_type_id. A slice of first_mb 0 or of another order count closes the picture before it;
    so does a stream that is silent for `quiet_ms` of event time, after which coding order goes on and any slice begins a new picture. Rows
    of a stream go by (ts, pos) within a batch. Rows without a stream only move the clock. State: pictures so far and the open one.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done = []
        coded, is_open, poc, idr, types, last = state.get if state.exists else (0, False, 0, False, [], 0)

        def close() -> None:
            nonlocal coded, is_open
            if is_open:
                done.append((key[0], coded, poc, idr, len(types), list(types)))
                coded, is_open = coded + 1, False

        if state.hasTimedOut:
            close()
            state.update((coded, False, 0, False, [], last))
        elif pd.notna(key[0]):
            rows, types = _one(batches), list(types)
            columns = [rows["ts"].to_numpy().astype("datetime64[us]").astype("int64").tolist(), *[rows[c].tolist() for c in ("pos", "first_mb", "poc", "nal_type", "slice_type_id")]]
            for ts, _, first_mb, own, nal_type, kind in sorted(zip(*columns, strict=True), key=lambda h: h[:2]):
                now = ts // 1000
                if not is_open or first_mb == 0 or own != poc or now > last + quiet_ms:
                    close()
                    is_open, poc, idr, types = True, int(own), False, []
                idr = idr or bool(nal_type == 5)
                types.append(int(kind))
                last = max(int(last), now)
            state.update((coded, is_open, poc, idr, types, last))
        if is_open:
            state.setTimeoutTimestamp(max(last + quiet_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(done, columns=["stream", "coding_order", "poc", "idr", "slices", "slice_type_ids"])

    kind = slices.schema["stream"].dataType.simpleString()
    rows = slices.withWatermark("ts", late)
    return rows.groupBy("stream").applyInPandasWithState(fold, f"stream {kind}, coding_order long, poc long, idr boolean, slices long, slice_type_ids array<int>", "coded long, open boolean, poc long, idr boolean, types array<int>, last long", "append", GroupStateTimeout.EventTimeTimeout)


def dedupe_latest(errors: DataFrame) -> DataFrame:
    """item, ts, text whenever an item's text changes: a text like the item's last one is ignored, a returning one comes through, an empty one
    (the item is in order again) comes through once and is nothing to begin with. Rows of an item go by ts within a batch.

    State: each item's last text. `LiveTable` keeps the latest of each item that are not empty.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = _one(batches)
        null, ts = rows["text"].isna().to_numpy(), rows["ts"].to_numpy()
        text = ["" if n else t for n, t in zip(null.tolist(), rows["text"].tolist(), strict=True)]
        # By ts, then text; nulls last, as sort_values has them.
        order = sorted(range(len(text)), key=list(zip(pd.isna(ts).tolist(), ts.astype("int64").tolist(), null.tolist(), text, strict=True)).__getitem__)
        last, kept = state.get[0] if state.exists else "", []
        for i in order:
            if text[i] != last:
                kept.append(i)
            last = text[i]
        state.update((last,))
        if kept:
            yield pd.DataFrame({"item": [key[0]] * len(kept), "ts": ts[kept], "text": [text[i] for i in kept]})

    kind = errors.schema["item"].dataType.simpleString()
    return errors.select("item", "ts", "text").groupBy("item").applyInPandasWithState(fold, f"item {kind}, ts timestamp, text string", "text string", "append", GroupStateTimeout.NoTimeout)


class LiveTable:
    """A keyed table that a stream keeps up to date: the latest row of each key, rows that `gone` holds for taken out.

    Keys are dealt to `buckets`. Batch n rewrites the buckets that it touches, as files of version n, and then writes manifest n, which names
    the version of every bucket. It starts from the last manifest before n, so a batch that is tried again, or that died halfway, gives the
    same table; readers see the last whole manifest.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: list[str], order: list[str], gone: str = "false", buckets: int = 16):
        self.spark, self.path, self.schema, self.keys, self.order, self.gone, self.buckets = spark, path, schema, keys, order, gone, buckets

    def _versions(self, below: int | None = None) -> dict[int, int]:
        """Bucket: version, by the last manifest (before a batch)."""
        fs, found = self._files(), []
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        if fs.exists(folder):
            names = [f.getPath().getName() for f in fs.listStatus(folder)]
            found = sorted(n for n in (int(x.partition("=")[2]) for x in names if x.startswith("n=")) if (below is None or n < below) and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest/n={n}/_SUCCESS")))
        if not found:
            return {}
        return {r.bucket: r.version for r in self.spark.read.schema("bucket int, version long").parquet(f"{self.path}/manifest/n={found[-1]}").collect()}

    def _files(self):  # noqa: ANN202
        context = self.spark.sparkContext
        return self.spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(context._jsc.hadoopConfiguration())

    def _rows(self, versions: dict[int, int]) -> DataFrame:
        if not versions:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/v={v}/bucket={b}" for b, v in sorted(versions.items())])

    def merge(self, batch: DataFrame, n: int) -> None:
        """Rows of micro-batch n (for foreachBatch)."""
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        w = Window.partitionBy(*self.keys).orderBy(*[F.desc(c) for c in self.order])
        latest = batch.select(*self.schema.names).withColumn("k", F.row_number().over(w)).where("k = 1").drop("k").withColumn("bucket", bucket)
        latest = written(latest, "batch")
        touched = [r.bucket for r in latest.select("bucket").distinct().collect()]  # at most `buckets` numbers
        versions = self._versions(n)
        old = self._rows({b: v for b, v in versions.items() if b in touched})
        newest = F.struct(*self.order)
        both = old.withColumn("bucket", bucket).unionByName(latest)
        held = both.groupBy("bucket", *self.keys).agg(F.max(F.struct(newest.alias("at"), *[c for c in self.schema.names if c not in (*self.keys, *self.order)])).alias("r"))
        rows = held.select(*self.keys, *[F.col(f"r.at.{c}").alias(c) for c in self.order], *[F.col(f"r.{c}").alias(c) for c in self.schema.names if c not in (*self.keys, *self.order)], "bucket").where(f"NOT ({self.gone})")
        if touched:
            rows.select(*self.schema.names, "bucket").repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/v={n}")
            full = {int(f.getPath().getName().partition("=")[2]) for f in self._files().listStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/data/v={n}")) if f.getPath().getName().startswith("bucket=")}
            versions = {b: v for b, v in versions.items() if b not in touched} | {b: n for b in touched if b in full}
        self.spark.createDataFrame(sorted(versions.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/n={n}")

    def read(self) -> DataFrame:
        return self._rows(self._versions())


def run_merged(stream: DataFrame, table: LiveTable, checkpoint: str) -> DataFrame:
    """Drive a stream over what there is into a live table; a restart goes on from the checkpoint."""
    query = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(table.merge).start()
    query.awaitTermination()
    return table.read()


FILES, FILE_ROWS = 4, 10_000  # files of a micro-batch of a replay, and rows that each has at least: fewer rows make one file


def replay(table: DataFrame, order: str, parts: int, end: str | None = None) -> tuple[str, int]:
    """(the folder of a table's rows as files of `parts` micro-batches by ranges of `order`, one batch written after another, for the file source
    goes by their age; how many files make a batch).

    With `end` (an interval) a last file has one row of nulls but for `order`, which lies so much later: it moves the clock of event time past
    all others.
    """
    path = scratch(table.sparkSession, "replay")
    number = F.unix_micros(order) if dict(table.dtypes)[order] == "timestamp" else F.col(order).cast("long")
    edges = sorted(set(table.select(number.alias("n")).approxQuantile("n", [k / parts for k in range(1, parts)], 0.01)))
    place = sum(((number > int(e)).cast("int") for e in edges), F.lit(0))
    least = min((r["count"] for r in table.groupBy(place.alias("place")).count().collect()), default=0)
    files = FILES if least >= FILES * FILE_ROWS else 1
    for k in range(len(edges) + 1):
        table.where(place == k).repartition(files).write.mode("append").parquet(path)
    if end:
        kinds = dict(table.dtypes)
        last = table.agg((F.max(order) + F.expr(f"INTERVAL {end}")).alias(order)).where(F.col(order).isNotNull())
        last.select(*[F.col(c) if c == order else F.lit(None).cast(kinds[c]).alias(c) for c in table.columns]).coalesce(1).write.mode("append").parquet(path)
    return path, files


def replayed(table: DataFrame, order: str, parts: int, end: str | None = None) -> DataFrame:
    """A stream over a replay of the table."""
    path, files = replay(table, order, parts, end)
    return read_stream(table.sparkSession, path, table.schema, files)
