"""Frames and timelines: range summaries, pictures from slices, coding and display order, which coded frame a display shows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def range_summary(frames: DataFrame, first: int, last: int, fps: float) -> DataFrame:
    """For each stream over [first, last]: frames, bytes, kbps, first largest and first smallest frame and counts and bytes by type; unknown sizes are skipped."""
    inside = frames.where(F.col("frame").between(first, last))
    by_type = inside.groupBy("stream", "frame_type").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).groupBy("stream").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("frame_type", F.struct("n", "bytes"))))).alias("by_type"))
    out = inside.groupBy("stream").agg(
        F.count("*").alias("frames"), F.sum("bytes").alias("bytes"),
        F.max_by("frame", F.struct("bytes", -F.col("frame"))).alias("largest"),
        F.min_by("frame", F.when(F.col("bytes").isNotNull(), F.struct("bytes", "frame"))).alias("smallest"),
    )
    return out.withColumn("kbps", F.col("bytes") * 8 * fps / F.col("frames") / 1000).join(by_type, "stream")


def range_diff(a: DataFrame, b: DataFrame, first: int, last: int) -> DataFrame:
    """One row (percent): (B - A) / A over the same frames; null if any frame of B is missing or unknown, or A is zero."""
    pair = a.where(F.col("frame").between(first, last)).select("frame", F.col("bytes").alias("bytes_a")).join(b.select("frame", F.col("bytes").alias("bytes_b")), "frame", "left")
    sums = pair.agg(F.bool_and(F.col("bytes_b").isNotNull()).alias("whole"), F.sum("bytes_a").alias("a"), F.sum("bytes_b").alias("b"))
    return sums.select(F.when(F.col("whole") & (F.col("a") > 0), (F.col("b") - F.col("a")) * 100.0 / F.col("a")).alias("percent"))


def align_check(frames: DataFrame, lasts: DataFrame) -> DataFrame:
    """stream, frame, bytes for 0..last of each stream: sizes are kept only where their number is last + 1, else every size is unknown."""
    n = frames.groupBy("stream").agg(F.count("*").alias("n"))
    every = lasts.join(n, "stream", "left").select("stream", F.coalesce("n", F.lit(0)).alias("n"), "last", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("frame"))
    return every.join(frames.select("stream", "frame", "bytes"), ["stream", "frame"], "left").select("stream", "frame", F.when(F.col("n") == F.col("last") + 1, F.col("bytes")).alias("bytes"))


def assemble_pictures(slices: DataFrame) -> DataFrame:
    """Pictures of each stream: a new one where first_mb is 0 or the order count changes; coding order, order count, idr and slice type ids in order."""
    w = Window.partitionBy("stream").orderBy("pos")
    new = (F.col("first_mb") == 0) | F.lag("poc").over(w).isNull() | (F.lag("poc").over(w) != F.col("poc"))
    numbered = slices.withColumn("picture", F.sum(new.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return numbered.groupBy("stream", F.col("picture").alias("coding_order")).agg(
        F.min_by("poc", "pos").alias("poc"), F.bool_or(F.col("nal_type") == 5).alias("idr"), F.count("*").alias("slices"),
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "slice_type_id"))), lambda s: s["slice_type_id"]).alias("slice_type_ids"),
    )


def display_order(pictures: DataFrame) -> DataFrame:
    return pictures.withColumn("display_order", F.row_number().over(Window.partitionBy("stream").orderBy("poc", "coding_order")).cast("long") - 1)


def coding_order(headers: DataFrame) -> DataFrame:
    """Coding order of every header that codes a frame, hidden ones included; null for headers that show an existing one."""
    w = Window.partitionBy("stream").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    codes = (F.col("show_existing") == 0).cast("long")
    return headers.withColumn("coding_order", F.when(F.col("show_existing") == 0, F.sum(codes).over(w) - 1))


def display_index(headers: DataFrame) -> DataFrame:
    """Shown units counted from 0; null where nothing is shown."""
    w = Window.partitionBy("stream").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    shown = (F.col("show_frame") == 1) | (F.col("show_existing") == 1)
    return headers.withColumn("display_index", F.when(shown, F.sum(shown.cast("long")).over(w) - 1))


def hidden_frames(headers: DataFrame) -> DataFrame:
    """For every display the coding orders of the hidden frames since the one before."""
    numbered = display_index(coding_order(headers))
    w = Window.partitionBy("stream").orderBy("pos").rowsBetween(0, Window.unboundedFollowing)
    unit = numbered.withColumn("unit", F.first("display_index", ignorenulls=True).over(w))
    hidden = (F.col("show_existing") == 0) & (F.col("show_frame") == 0)
    return unit.where("unit IS NOT NULL").groupBy("stream", F.col("unit").alias("display_index")).agg(F.sort_array(F.collect_list(F.when(hidden, F.col("coding_order")))).alias("hidden"))


def display_map(headers: DataFrame) -> DataFrame:
    """stream, coded_id, display_index: where each coded frame is shown last, directly or by a later unit that names its slot.

    A slot holds the last coded frame before the unit whose refresh bits have it; frames that are never shown are absent.
    """
    numbered = display_index(headers)
    slots = F.explode(F.sequence(F.lit(0), F.lit(7)))
    writes = numbered.where("show_existing = 0").select("stream", "pos", "coded_id", "refresh_flags", slots.alias("slot")).where("shiftright(refresh_flags, slot) & 1 = 1").select("stream", F.col("slot").cast("long").alias("slot"), "pos", "coded_id", F.lit(None).cast("long").alias("shown_at"))
    shows = numbered.where("show_existing = 1").select("stream", F.col("map_idx").cast("long").alias("slot"), "pos", F.lit(None).cast("long").alias("coded_id"), F.col("display_index").alias("shown_at"))
    w = Window.partitionBy("stream", "slot").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    late = writes.unionByName(shows).withColumn("held", F.last("coded_id", ignorenulls=True).over(w)).where("shown_at IS NOT NULL AND held IS NOT NULL").select("stream", F.col("held").alias("coded_id"), F.col("shown_at").alias("display_index"))
    direct = numbered.where("show_existing = 0 AND show_frame = 1").select("stream", "coded_id", "display_index")
    return direct.unionByName(late).groupBy("stream", "coded_id").agg(F.max("display_index").alias("display_index"))


def display_map_full(headers: DataFrame) -> DataFrame:
    """As display_map, with reloads: a key frame shown again refreshes all slots, as do a shown key frame and a switch frame.

    A re-shown key frame can itself come from a reload, so this is a fold over each stream in order.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        slots: list[tuple[int, int] | None] = [None] * 8
        shown: dict[int, int] = {}
        index = 0
        for h in pdf.sort_values("pos").itertuples(index=False):
            if h.show_existing == 1:
                frame = slots[int(h.map_idx)]
                if frame is not None:
                    shown[frame[0]] = index
                    if frame[1] == 0:
                        slots = [frame] * 8
                index += 1
                continue
            frame = (int(h.coded_id), int(h.frame_type))
            whole = (h.frame_type == 0 and h.show_frame == 1) or h.frame_type == 3
            slots = [frame if whole or int(h.refresh_flags) >> k & 1 else s for k, s in enumerate(slots)]
            if h.show_frame == 1:
                shown[frame[0]] = index
                index += 1
        return pd.DataFrame({"stream": [pdf.stream.iloc[0]] * len(shown), "coded_id": list(shown), "display_index": list(shown.values())})

    return headers.select("stream", "pos", "coded_id", "show_existing", "map_idx", "show_frame", "refresh_flags", "frame_type").groupBy("stream").applyInPandas(fold, "stream long, coded_id long, display_index long")


def resolve_display(ids: DataFrame, shown: DataFrame) -> DataFrame:
    """Display index of (stream, coded_id); -1 and a text where a frame is never shown."""
    out = ids.join(shown, ["stream", "coded_id"], "left")
    return out.select("stream", "coded_id", F.coalesce("display_index", F.lit(-1).cast("long")).alias("display_index"), F.when(F.col("display_index").isNull(), "never shown").alias("error"))


def keep_known(rows: DataFrame, items: DataFrame, key: str) -> DataFrame:
    return rows.join(items.select(key).distinct(), key, "left_semi")


def latest_error(log: DataFrame, item: str, order: str, text: str) -> DataFrame:
    """The live row of each item: its latest, unless that text is empty."""
    w = Window.partitionBy(item).orderBy(F.col(order).desc())
    return log.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k").where(F.col(text).isNotNull() & (F.col(text) != ""))


def carry_config(pictures: DataFrame, stream: str, order: str, config: str) -> DataFrame:
    """`current`: the last config seen so far; `initial`: the stream's first."""
    w = Window.partitionBy(stream).orderBy(order)
    return pictures.withColumn("current", F.last(config, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("initial", F.first(config, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
