"""Sample tables of containers: run-length tables to located samples and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.store import written
from .scan import SPAN, scan, span

_BEFORE, _SO_FAR = (Window.unboundedPreceding, -1), (Window.unboundedPreceding, 0)


def _running(column: str | Column, w) -> Column:
    return F.coalesce(F.sum(column).over(w.rowsBetween(*_BEFORE)), F.lit(0)).cast("long")


def rle_encode(rows: DataFrame, key: str, order: str, value: str, size: int = SPAN) -> DataFrame:
    """key, run, first, count, value: equal neighbours as runs. `order` is an ordinal, `size` of it make a block.

    Blocks are encoded apart; of their runs a table is written. A row a block then tells which blocks go on with the run of the one before, and
    how many runs the key has had.
    """
    w = Window.partitionBy(key, "_block").orderBy(order)
    own = rows.select(key, order, value).withColumn("_block", span(order, size))
    own = own.withColumn("_new", (F.row_number().over(w) == 1) | ~F.lag(value).over(w).eqNullSafe(F.col(value)))
    own = own.withColumn("_part", F.sum(F.col("_new").cast("long")).over(w.rowsBetween(*_SO_FAR)))
    parts = written(own.groupBy(key, "_block", "_part").agg(F.min(order).alias("first"), F.count("*").alias("count"), F.first(value).alias("value")), "runs")
    by = Window.partitionBy(key).orderBy("_block")
    ends = parts.groupBy(key, "_block").agg(F.max("_part").alias("n"), *[pick(F.struct("value"), "_part").alias(c) for c, pick in (("low", F.min_by), ("high", F.max_by))])
    ends = ends.withColumn("on", F.coalesce(F.lag("high").over(by) == F.col("low"), F.lit(False)).cast("long"))
    ends = ends.select(key, "_block", "on", (F.sum(F.col("n") - F.col("on")).over(by.rowsBetween(*_SO_FAR)) - F.col("n")).alias("earlier"))
    numbered = parts.join(ends, [key, "_block"]).withColumn("run", F.col("earlier") + F.col("_part"))
    return numbered.groupBy(key, "run").agg(F.min("first").alias("first"), F.sum("count").alias("count"), F.first("value").alias("value"))


def chunk_runs(rows: DataFrame, size: int = SPAN) -> DataFrame:
    """stsc: track, first_chunk, per_chunk from samples with their chunk. Chunks are counted once, into a table, and scanned in blocks of `size`."""
    n = written(rows.groupBy("track", "chunk").agg(F.count("*").alias("per_chunk")), "chunks")
    n = scan(n, ["track"], ["chunk"], span("chunk", size), lasts={"before": F.col("per_chunk")}, own=False)
    return n.where("before IS NULL OR before <> per_chunk").select("track", F.col("chunk").alias("first_chunk"), "per_chunk")


def chunk_offsets(rows: DataFrame, size: int = SPAN) -> DataFrame:
    """stco: track, chunk, offset - earlier chunks' bytes and 100 a chunk. Chunks are summed once, into a table, and scanned in blocks of `size`."""
    n = written(rows.groupBy("track", "chunk").agg(F.sum("size").alias("bytes")), "bytes")
    n = scan(n, ["track"], ["chunk"], span("chunk", size), {"before": F.col("bytes")})
    return n.select("track", "chunk", (F.col("before") + 100 * F.col("chunk")).alias("offset"))


def _chunk_slots(chunks: DataFrame, runs: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(chunks with per_chunk, that of the last run which starts at or before them, and `before`, the samples of earlier chunks; track and the samples its chunks hold).

    Runs meet the chunk they start at, and a table of that is written. Inside blocks of `size` chunks a window carries runs forward and adds
    samples up; chunks ahead of a block's first run have that of an earlier block, so they are counted, and a row a block tells the rest.
    """
    starts = runs.select("track", F.col("first_chunk").alias("chunk"), F.col("per_chunk").alias("starts"))
    met = written(chunks.select("track", "chunk", "offset").join(starts, ["track", "chunk"], "full"), "chunks")
    w = Window.partitionBy("track", "_block").orderBy("chunk")
    known = F.col("offset").isNotNull()
    local = met.withColumn("_block", span("chunk", size)).repartition("track", "_block").withColumn("own", F.last("starts", ignorenulls=True).over(w.rowsBetween(*_SO_FAR)))
    adds, ahead = F.when(known, F.greatest("own", F.lit(0))), (known & F.col("own").isNull()).cast("long")
    local = local.withColumns({"_sum": _running(adds, w), "_ahead": _running(ahead, w)})
    blocks = local.groupBy("track", "_block").agg(F.max_by("own", "chunk").alias("last"), F.coalesce(F.sum(adds), F.lit(0)).alias("sum"), F.sum(ahead).alias("ahead"))
    by = Window.partitionBy("track").orderBy("_block")
    blocks = blocks.withColumn("carry", F.last("last", ignorenulls=True).over(by.rowsBetween(*_BEFORE)))
    blocks = blocks.withColumn("held", F.col("sum") + F.col("ahead") * F.greatest(F.coalesce("carry", F.lit(0)), F.lit(0))).withColumn("earlier", _running("held", by))
    out = local.where(known).join(blocks.select("track", "_block", "carry", "earlier"), ["track", "_block"])
    before = F.col("earlier") + F.col("_sum") + F.col("_ahead") * F.greatest(F.coalesce("carry", F.lit(0)), F.lit(0))
    return out.select("track", "chunk", "offset", F.coalesce("own", "carry").alias("per_chunk"), before.alias("before")), blocks.groupBy("track").agg(F.sum("held").alias("room"))


def chunk_run_join(chunks: DataFrame, runs: DataFrame, size: int = SPAN) -> DataFrame:
    """Every chunk with the last run whose first_chunk is not after it."""
    return _chunk_slots(chunks, runs, size)[0].drop("before")


def _slots(chunks: DataFrame) -> DataFrame:
    each = chunks.where("per_chunk > 0").select("track", "chunk", "offset", "before", F.explode(F.sequence(F.lit(1).cast("long"), F.col("per_chunk"))).alias("slot"))
    return each.select("track", (F.col("before") + F.col("slot")).alias("sample"), "chunk", "offset", "slot")


def sample_chunk_join(chunks: DataFrame, size: int = SPAN) -> DataFrame:
    """track, sample, chunk, offset, slot: chunk slots exploded, so that samples meet chunks by equality of the ordinal."""
    return _slots(scan(chunks.where("per_chunk > 0"), ["track"], ["chunk"], span("chunk", size), {"before": F.col("per_chunk")}))


def locate_samples(sizes: DataFrame, runs: DataFrame, offsets: DataFrame, size: int = SPAN) -> DataFrame:
    """track, sample, chunk, size, offset, error: a chunk's offset and the sizes of earlier samples in it; samples beyond the chunks carry an error.

    Samples meet chunks by (track, sample) and add up by (track, chunk); chunks add up in blocks of `size`. What is joined by track is a row for
    each track with an error.
    """
    chunks, room = _chunk_slots(offsets, runs, size)
    placed = sizes.join(_slots(chunks), ["track", "sample"], "left")
    # Samples without a chunk would be one window each track; by their own number they are dealt like the others.
    w = Window.partitionBy("track", "chunk", F.when(F.col("chunk").isNull(), F.col("sample"))).orderBy("sample")
    out = placed.withColumn("at", F.when(F.col("chunk").isNotNull(), F.col("offset") + _running("size", w)))
    lost = sizes.groupBy("track").agg(F.count("*").alias("n")).join(room, "track", "left").select("track", (F.col("n") - F.coalesce("room", F.lit(0))).alias("lost")).where("lost > 0")
    bad = runs.groupBy("track").agg(F.bool_or(F.col("per_chunk") <= 0).alias("bad")).where("bad")
    wrong = F.when(F.col("bad"), "a run has no samples").otherwise(F.concat(F.col("lost").cast("string"), F.lit(" samples unplaced")))
    return out.join(bad.join(lost, "track", "full").select("track", wrong.alias("error")), "track", "left").select("track", "sample", "chunk", "size", F.col("at").alias("offset"), "error")


def decode_times(samples: DataFrame, runs: DataFrame, size: int = SPAN) -> DataFrame:
    """track, sample, time: base + delta x (sample - first) of the covering run; entries past the samples are ignored, samples past the entries get 0.

    A run is repeated in every block of `size` samples that it covers, so that samples look no further back than their block.
    """
    spans = scan(runs.select("track", "run", "count", "value"), ["track"], ["run"], span("run", size), {"before": F.col("count"), "base": F.col("count") * F.col("value")}).where("count > 0")
    cover = F.explode(F.sequence(F.floor((F.col("before") + 1) / size), F.floor((F.col("before") + F.col("count")) / size)))
    held = F.struct("before", "base", "value", "count")
    marks = spans.select("track", held.alias("span"), cover.alias("block")).select("track", F.greatest(F.col("span.before") + 1, F.col("block") * size).alias("sample"), "span", "block", F.lit(0).alias("kind"))
    both = samples.select("track", "sample", F.lit(None).cast(marks.schema["span"].dataType).alias("span"), span("sample", size).alias("block"), F.lit(1).alias("kind")).unionByName(marks)
    both = both.repartition("track", "block")
    found = F.last("span", ignorenulls=True).over(Window.partitionBy("track", "block").orderBy("sample", "kind").rowsBetween(Window.unboundedPreceding, 0))
    out = both.withColumn("s", found).where("kind = 1")
    inside = F.col("sample") <= F.col("s.before") + F.col("s.count")
    return out.select("track", "sample", F.when(inside, F.col("s.base") + F.col("s.value") * (F.col("sample") - F.col("s.before") - 1)).otherwise(0).alias("time"))


def mark_sync(samples: DataFrame, stss: DataFrame) -> DataFrame:
    """`sync`: listed in the track's table; a track without a table has all true; entries out of range match nothing."""
    known = stss.select("track").distinct().withColumn("has_table", F.lit(True))
    listed = stss.select("track", "sample").distinct().withColumn("listed", F.lit(True))
    out = samples.join(listed, ["track", "sample"], "left").join(known, "track", "left")
    return out.withColumn("sync", F.col("has_table").isNull() | F.col("listed").isNotNull()).drop("listed", "has_table")


def apply_defaults(rows: DataFrame, fragments: DataFrame, tracks: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """A sample's own value, else its fragment's, else its track's; the fragment's first_flags override the first sample's flags."""
    f = fragments.select("track", "fragment", *[F.col(c).alias(f"f_{c}") for c in columns], "first_flags")
    t = tracks.select("track", *[F.col(c).alias(f"t_{c}") for c in columns])
    out = rows.join(f, ["track", "fragment"], "left").join(t, "track", "left")
    out = out.withColumns({c: F.coalesce(c, f"f_{c}", f"t_{c}") for c in columns})
    if "flags" in columns:
        out = out.withColumn("flags", F.when((F.col("index") == 0) & F.col("first_flags").isNotNull(), F.col("first_flags")).otherwise(F.col("flags")))
    return out.drop(*[f"f_{c}" for c in columns], *[f"t_{c}" for c in columns], "first_flags")


def fallback_source(table: DataFrame, fragments: DataFrame, key: str = "track") -> DataFrame:
    """The table's samples, and those of fragments for tracks that have none in it."""
    return table.unionByName(fragments.join(table.select(key).distinct(), key, "left_anti").select(*table.columns))


def map_position(offsets: DataFrame, segments: DataFrame, key: str, width: int | None = None) -> DataFrame:
    """`segment` of each offset: the last that starts at or before it, null past that one's length.

    Both are cut into blocks of `width` of offset, by default such as hold about SPAN segments (of the key with the densest ones no more than
    all keys together make of it); the last segment of earlier blocks is carried over.
    """
    if width is None:
        s = segments.agg(F.min("start").alias("low"), F.max("start").alias("high"), F.count("*").alias("n")).first()
        width = max(1, (s.high - s.low + 1) * SPAN // s.n) if s.n else 1
    s = segments.select(key, F.col("start").alias("offset"), F.struct("segment", "start", "length").alias("seg"), F.lit(0).alias("kind"))
    both = offsets.select(key, "offset", F.lit(None).cast(s.schema["seg"].dataType).alias("seg"), F.lit(1).alias("kind")).unionByName(s)
    found = scan(both, [key], ["offset", "kind"], span("offset", width), lasts={"s": F.col("seg")}).where("kind = 1")
    return found.select(key, "offset", F.when(F.col("offset") < F.col("s.start") + F.col("s.length"), F.col("s.segment")).alias("segment"))


def fragment_samples(runs: DataFrame, size: int = SPAN) -> DataFrame:
    """runs: track, run, index, data_offset, tfdt (null: carried on), size, delta -> track, run, index, offset, time.

    Offsets run on within a run from its data offset; decode times run on over runs and start anew where one gives its own time. Runs are
    summed up first; the scan over a track is one over its runs, in blocks of `size` run numbers.
    """
    own = Window.partitionBy("track", "run").orderBy("index")
    each = runs.groupBy("track", "run").agg(F.sum("delta").alias("delta"), F.max(F.when(F.col("index") == 0, F.col("tfdt"))).alias("tfdt"))
    each = scan(written(each, "fragments"), ["track"], ["run"], span("run", size), {"sum": F.col("delta")})
    each = scan(each, ["track"], ["run"], span("run", size), lasts={"base": F.col("tfdt") - F.col("sum")})
    begins = each.select("track", "run", (F.coalesce("base", F.lit(0)) + F.col("sum")).alias("begin"))
    inside = runs.select("track", "run", "index", (F.col("data_offset") + _running("size", own)).alias("offset"), _running("delta", own).alias("passed"))
    return inside.join(begins, ["track", "run"]).select("track", "run", "index", "offset", (F.col("begin") + F.col("passed")).alias("time"))


def slice_by_sizes(sizes: DataFrame, data: DataFrame, key: str) -> DataFrame:
    """`piece`: the bytes of each item, sizes running over the key's data; size 0 keeps its place as empty."""
    w = Window.partitionBy(key).orderBy("index")
    return sizes.withColumn("start", _running("size", w)).join(data, key).select(key, "index", "size", "start", F.expr("substring(data, CAST(start + 1 AS INT), CAST(size AS INT))").alias("piece"))


def validate_samples(located: DataFrame, files: DataFrame) -> DataFrame:
    """First finding of each track: a table larger than the file, nothing placed, a sample past the end."""
    g = located.groupBy("track").agg(F.count("*").alias("n"), F.count("offset").alias("placed"), F.max(F.col("offset") + F.col("size")).alias("end"))
    e = g.join(files, "track")
    error = F.when(F.col("n") * 4 > F.col("file_size"), "implausible sample count").when(F.col("placed") == 0, "no sample placed").when(F.col("end") > F.col("file_size"), "sample past the end of the file")
    return e.select("track", error.alias("error")).where("error IS NOT NULL")


def bytes_per_layer(pictures: DataFrame) -> DataFrame:
    """plane, level, bytes: nested arrays surface_bytes[plane][level] summed over pictures."""
    planes = pictures.select(F.posexplode("surface_bytes").alias("plane", "levels"))
    return planes.select("plane", F.posexplode("levels").alias("level", "bytes")).groupBy("plane", "level").agg(F.sum("bytes").alias("bytes"))
