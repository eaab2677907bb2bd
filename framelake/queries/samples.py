"""Queries of the sample-table family (ST) and its joins."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import samples as st
from ..registry import query

RUNS = "runs AS (SELECT track, chunk AS first_chunk, per_chunk FROM (SELECT *, lag(per_chunk) OVER (PARTITION BY track ORDER BY chunk) AS b FROM (SELECT track, chunk, count(*) AS per_chunk FROM f_st GROUP BY track, chunk)) WHERE b IS NULL OR b <> per_chunk)"
OFFS = "offs AS (SELECT track, chunk, CAST(coalesce(sum(bytes) OVER (PARTITION BY track ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 100 * chunk AS BIGINT) AS \"offset\" FROM (SELECT track, chunk, sum(size) AS bytes FROM f_st GROUP BY track, chunk))"
LOC = "loc AS (SELECT f.track, sample, f.chunk, size, CAST(o.\"offset\" + coalesce(sum(size) OVER (PARTITION BY f.track, f.chunk ORDER BY sample ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM f_st f JOIN offs o ON o.track = f.track AND o.chunk = f.chunk)"


@query("jn5_chunk_run_join", "f_st", oracle=f"WITH {OFFS}, n AS (SELECT track, chunk, count(*) AS per_chunk FROM f_st GROUP BY track, chunk) SELECT o.track, o.chunk, o.\"offset\", n.per_chunk FROM offs o JOIN n USING (track, chunk)")
def jn5(t):
    return st.chunk_run_join(st.chunk_offsets(t), st.chunk_runs(t))


@query("jn6_sample_chunk_join", "f_st", oracle=f"WITH {OFFS} SELECT f.track, f.sample, f.chunk, o.\"offset\", CAST(row_number() OVER (PARTITION BY f.track, f.chunk ORDER BY f.sample) AS BIGINT) AS slot FROM f_st f JOIN offs o ON o.track = f.track AND o.chunk = f.chunk")
def jn6(t):
    return st.sample_chunk_join(st.chunk_run_join(st.chunk_offsets(t), st.chunk_runs(t)))


@query("st1_locate_samples", "f_st", oracle=f"WITH {OFFS}, {LOC} SELECT *, CAST(NULL AS VARCHAR) AS error FROM loc")
def st1(t):
    return st.locate_samples(t.select("track", "sample", "size"), st.chunk_runs(t), st.chunk_offsets(t))


@query("st1_unplaced", "f_st", oracle="SELECT track, count(*) AS n, count(CASE WHEN track = 1 AND chunk > 20 THEN NULL ELSE 1 END) AS placed, max(CASE WHEN track = 1 THEN concat(CAST((SELECT count(*) FROM f_st WHERE track = 1 AND chunk > 20) AS VARCHAR), ' samples unplaced') END) AS error FROM f_st GROUP BY track")
def st1_unplaced(t):
    offsets = st.chunk_offsets(t).where("NOT (track = 1 AND chunk > 20)")
    return st.locate_samples(t.select("track", "sample", "size"), st.chunk_runs(t), offsets).groupBy("track").agg(F.count("*").alias("n"), F.count("offset").alias("placed"), F.max("error").alias("error"))


@query("st2_decode_times", "f_st", oracle="SELECT track, sample, CAST(coalesce(sum(delta) OVER (PARTITION BY track ORDER BY sample ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS time FROM f_st")
def st2(t):
    return st.decode_times(t.select("track", "sample"), st.rle_encode(t, "track", "sample", "delta"))


@query("st3_fragment_samples", "f_st", oracle="""
WITH r AS (SELECT track, chunk AS run, sample, size, delta, row_number() OVER (PARTITION BY track, chunk ORDER BY sample) - 1 AS idx FROM f_st), m AS (SELECT *, CASE WHEN run % 10 = 0 AND idx = 0 THEN 1 ELSE 0 END AS reset FROM r),
e AS (SELECT *, sum(reset) OVER (PARTITION BY track ORDER BY run, idx ROWS UNBOUNDED PRECEDING) AS epoch FROM m)
SELECT track, run, CAST(idx AS BIGINT) AS index, CAST(run * 1000 + coalesce(sum(size) OVER (PARTITION BY track, run ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset", CAST(CASE WHEN epoch > 0 THEN min(run) OVER (PARTITION BY track, epoch) * 500 ELSE 0 END + coalesce(sum(delta) OVER (PARTITION BY track, epoch ORDER BY run, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS time FROM e""")
def st3(t):
    idx = F.row_number().over(Window.partitionBy("track", "chunk").orderBy("sample")).cast("long") - 1
    r = t.select("track", F.col("chunk").alias("run"), idx.alias("index"), "size", "delta").withColumn("data_offset", F.col("run") * 1000).withColumn("tfdt", F.when(F.col("run") % 10 == 0, F.col("run") * 500))
    return st.fragment_samples(r)


@query("st4_rle_encode", "f_st", oracle="WITH i AS (SELECT track, sample, delta, row_number() OVER (PARTITION BY track ORDER BY sample) - row_number() OVER (PARTITION BY track, delta ORDER BY sample) AS g FROM f_st), r AS (SELECT track, delta, min(sample) AS first, count(*) AS n FROM i GROUP BY track, delta, g) SELECT track, CAST(row_number() OVER (PARTITION BY track ORDER BY first) AS BIGINT) AS run, first, n AS count, delta AS value FROM r")
def st4(t):
    return st.rle_encode(t, "track", "sample", "delta")


@query("st5_slice_by_sizes", "documents", oracle="WITH s AS (SELECT doc_id, i, CAST((doc_id + i * 7) % 12 AS BIGINT) AS size FROM documents, range(0, 6) r(i)), w AS (SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM s) SELECT w.doc_id, i AS index, size, start, substr(md5(text), CAST(start + 1 AS BIGINT), size) AS piece FROM w JOIN documents d ON d.doc_id = w.doc_id")
def st5(d):
    sizes = d.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))).alias("index")).withColumn("size", (F.col("doc_id") + F.col("index") * 7) % 12)
    return st.slice_by_sizes(sizes, d.select("doc_id", F.encode(F.md5("text"), "UTF-8").alias("data")), "doc_id").withColumn("piece", F.decode("piece", "UTF-8"))


@query("jn7_mark_sync", "f_st", oracle="SELECT track, sample, CASE WHEN track = 2 THEN TRUE ELSE sync END AS sync FROM f_st")
def jn7(t):
    return st.mark_sync(t.select("track", "sample"), t.where("sync AND track <> 2").select("track", "sample").unionByName(t.where("track = 0 AND sample = 1").select("track", (F.col("sample") - 5).alias("sample"))))


@query("jn8_apply_defaults", "f_st", oracle="SELECT track, sample, CAST(CASE WHEN sample % 3 = 0 THEN size WHEN chunk % 2 = 0 THEN chunk ELSE track * 10 END AS BIGINT) AS size, CAST(CASE WHEN sample = first AND chunk % 5 = 0 THEN 7 WHEN sample % 4 = 0 THEN delta WHEN chunk % 2 = 0 THEN 1 ELSE 2 END AS BIGINT) AS flags FROM (SELECT *, min(sample) OVER (PARTITION BY track, chunk) AS first FROM f_st)")
def jn8(t):
    idx = F.row_number().over(Window.partitionBy("track", "chunk").orderBy("sample")) - 1
    rows = t.select("track", "sample", F.col("chunk").alias("fragment"), idx.alias("index"), F.when(F.col("sample") % 3 == 0, F.col("size")).alias("size"), F.when(F.col("sample") % 4 == 0, F.col("delta")).alias("flags"))
    even = F.col("chunk") % 2 == 0
    fragments = t.select("track", "chunk").distinct().select("track", F.col("chunk").alias("fragment"), F.when(even, F.col("chunk")).alias("size"), F.when(even, F.lit(1).cast("long")).alias("flags"), F.when(F.col("chunk") % 5 == 0, F.lit(7).cast("long")).alias("first_flags"))
    tracks = t.select("track").distinct().select("track", (F.col("track") * 10).alias("size"), F.lit(2).cast("long").alias("flags"))
    return st.apply_defaults(rows, fragments, tracks, ("size", "flags")).select("track", "sample", "size", "flags")


@query("jn9_fallback_source", "f_st", oracle="SELECT track, sample, CASE WHEN track < 2 THEN size ELSE size + 1 END AS size FROM f_st")
def jn9(t):
    s = t.select("track", "sample", "size")
    return st.fallback_source(s.where("track < 2"), s.withColumn("size", F.col("size") + 1))


@query("jn18_map_position", "f_st", oracle=f"WITH {OFFS}, {LOC}, p AS (SELECT track, \"offset\" + size + CASE WHEN sample % 2 = 0 THEN 0 ELSE -1 END AS pos FROM loc) SELECT p.track, p.pos AS \"offset\", CASE WHEN p.pos < l.\"offset\" + l.size THEN l.sample END AS segment FROM p ASOF LEFT JOIN loc l ON l.track = p.track AND p.pos >= l.\"offset\"")
def jn18(t):
    loc = st.locate_samples(t.select("track", "sample", "size"), st.chunk_runs(t), st.chunk_offsets(t))
    pos = loc.select("track", (F.col("offset") + F.col("size") + F.when(F.col("sample") % 2 == 0, 0).otherwise(-1)).alias("offset"))
    return st.map_position(pos, loc.select("track", F.col("sample").alias("segment"), F.col("offset").alias("start"), F.col("size").alias("length")), "track")


@query("mn4_bytes_per_layer", "f_st", oracle="SELECT CAST(p AS INTEGER) AS plane, CAST(l AS INTEGER) AS level, CAST(sum(size + p * 10 + l) AS BIGINT) AS bytes FROM f_st, range(0, 3) a(p), range(0, 2) b(l) GROUP BY p, l")
def mn4(t):
    return st.bytes_per_layer(t.select(F.array(*[F.array(*[F.col("size") + p * 10 + lvl for lvl in range(2)]) for p in range(3)]).alias("surface_bytes")))


@query("mn7_validate_samples", "f_st", oracle=f"WITH {OFFS}, {LOC}, g AS (SELECT track, count(*) AS n, max(\"offset\" + size) AS e FROM loc GROUP BY track), s AS (SELECT *, CASE track WHEN 0 THEN e ELSE CASE track WHEN 1 THEN e - 1 ELSE CASE track WHEN 2 THEN n ELSE e + 5 END END END AS file_size FROM g) SELECT track, CASE WHEN n * 4 > file_size THEN 'implausible sample count' WHEN e > file_size THEN 'sample past the end of the file' END AS error FROM s WHERE n * 4 > file_size OR e > file_size")
def mn7(t):
    loc = st.locate_samples(t.select("track", "sample", "size"), st.chunk_runs(t), st.chunk_offsets(t))
    files = loc.groupBy("track").agg(F.max(F.col("offset") + F.col("size")).alias("e"), F.count("*").alias("n")).select("track", F.when(F.col("track") == 0, F.col("e")).when(F.col("track") == 1, F.col("e") - 1).when(F.col("track") == 2, F.col("n")).otherwise(F.col("e") + 5).alias("file_size"))
    return st.validate_samples(loc, files)
