"""Queries of the scalar functions (SC)."""

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.sql import register
from ..registry import query

PSNR = "CASE WHEN samples > 0 AND sse > 0 THEN 10 * log10(65025.0 * samples / sse) END"


@query("sc1_psnr_from_sse", "f_rd", oracle=f"SELECT frame, sb_row, sb_col, grp, point, bits, round({PSNR}, 4) AS psnr FROM f_rd")
def sc1(t):
    return t.select("frame", "sb_row", "sb_col", "grp", "point", "bits", F.round(S.psnr_from_sse("sse", "samples"), 4).alias("psnr"))


@query("sc2_psnr_label", "f_rd", oracle=f"SELECT label, count(*) AS n FROM (SELECT CASE WHEN {PSNR} IS NOT NULL THEN printf('%.1f', floor({PSNR})) WHEN sse = 0 THEN 'lossless' ELSE '-' END AS label FROM f_rd) GROUP BY label")
def sc2(t):
    return t.select(S.psnr_label("sse", F.floor(S.psnr_from_sse("sse", "samples")).cast("double")).alias("label")).select(F.regexp_replace("label", "00$", "").alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@query("sc3_clipped_samples", "f_bl_a", oracle="SELECT frame, x, y, n FROM (SELECT frame, x, y, greatest(0, least(x + 64, 120) - x) * greatest(0, least(y + 64, 100) - y) AS n FROM f_bl_a) WHERE n > 0")
def sc3(t):
    return t.select("frame", "x", "y", S.clipped_samples("x", "y", F.lit(64), F.lit(64), 120, 100).alias("n")).where("n > 0")


@query("sc4_rate_axis", "f_rd", oracle="SELECT frame, grp, point, sum(bits + 1) AS rate FROM f_rd GROUP BY frame, grp, point")
def sc4(t):
    return t.groupBy("frame", "grp", "point").agg(F.sum(S.rate_axis("bits")).alias("rate"))


@query("sc5_mv_units", "f_mv", oracle="SELECT frame, algorithm, x, y, x * 8 AS full_q8, mv_x_q8 * 2 AS quarter_q8, CAST(trunc(mv_x_q8 / 8.0) AS BIGINT) AS whole_x, CAST(trunc(mv_y_q8 / 8.0) AS BIGINT) AS whole_y FROM f_mv")
def sc5(t):
    return t.select("frame", "algorithm", "x", "y", S.to_eighth_pel("x").alias("full_q8"), S.quarter_to_eighth_pel("mv_x_q8").alias("quarter_q8"), S.whole_part("mv_x_q8").alias("whole_x"), S.whole_part("mv_y_q8").alias("whole_y"))


def _place(d):
    m = f"least(abs({d}), 1919)"
    return f"CASE WHEN {m} < 128 THEN {m} WHEN {m} < 384 THEN 128 + ({m} - 128) // 2 WHEN {m} < 896 THEN 256 + ({m} - 384) // 4 ELSE 384 + ({m} - 896) // 8 END"


@query("sc6_mv_rate", "f_mv", oracle=f"WITH v AS (SELECT *, {_place('mv_x_q8 * 9')} AS px, {_place('mv_y_q8 * 9')} AS py FROM f_mv), r AS (SELECT px AS place, count(*) AS rate FROM v GROUP BY px) SELECT frame, algorithm, x, y, coalesce(a.rate, 0) + coalesce(b.rate, 0) AS rate FROM v LEFT JOIN r a ON a.place = px LEFT JOIN r b ON b.place = py")
def sc6(t):
    """Rates by tables made from the vectors: how many have a horizontal part of that place."""
    n = {r.place: r["count"] for r in t.groupBy(S.rate_place(F.col("mv_x_q8") * 9).alias("place")).count().collect()}
    tables = [[n.get(128 * i + k, 0) for k in range(128)] for i in range(4)]
    return t.select("frame", "algorithm", "x", "y", S.mv_rate(F.col("mv_x_q8") * 9, F.col("mv_y_q8") * 9, tables).alias("rate"))


@query("sc7_divide_round", "f_gr", oracle="SELECT frame, y, sum(CASE WHEN v >= 128 THEN 1 ELSE -1 END * CAST(floor((abs(v - 128) + 3) / 7) AS BIGINT))::BIGINT AS s, sum(sign(v - 128) * floor(abs(v - 128) / 8.0 + 0.5))::BIGINT AS h FROM f_gr GROUP BY frame, y")
def sc7(t):
    d = F.col("v") - 128
    return t.groupBy("frame", "y").agg(F.sum(S.divide_round(d, F.lit(7))).alias("s"), F.sum(S.round_half_away(d / 8.0)).alias("h"))


@query("sc8_frame_type", "f_fh", oracle="SELECT stream, pos, CASE WHEN show_existing = 1 THEN 'SHOW_EXISTING' WHEN frame_type = 0 THEN 'KEY' WHEN frame_type = 1 THEN 'INTER' WHEN frame_type = 2 THEN 'INTRA_ONLY' WHEN frame_type = 3 THEN 'SWITCH' ELSE '-' END AS type FROM f_fh")
def sc8(t):
    return t.select("stream", "pos", S.frame_type("frame_type", "show_existing").alias("type"))


_NAMES = "CASE WHEN slice_type_id < 0 THEN '?' ELSE ['P','B','I','SP','SI'][CAST(slice_type_id % 5 + 1 AS INTEGER)] END"


@query("sc9_avc_frame_class", "f_sl", oracle=f"SELECT stream, poc, CASE WHEN idr OR (list_contains(ts, 'I') AND NOT list_contains(ts, 'P') AND NOT list_contains(ts, 'B')) THEN 'Key' WHEN list_contains(ts, 'B') THEN 'BiPred' ELSE 'Inter' END AS class FROM (SELECT stream, poc, bool_or(nal_type = 5) AS idr, list({_NAMES}) AS ts FROM f_sl GROUP BY stream, poc)")
def sc9(t):
    g = t.groupBy("stream", "poc").agg(F.bool_or(F.col("nal_type") == 5).alias("idr"), F.collect_set(S.slice_type_name("slice_type_id")).alias("ts"))
    return g.select("stream", "poc", S.avc_frame_class("idr", "ts").alias("class"))


@query("sc10_slice_type_name", "f_sl", oracle=f"SELECT stream, pos, {_NAMES} AS type FROM f_sl")
def sc10(t):
    return t.select("stream", "pos", S.slice_type_name("slice_type_id").alias("type"))


@query("sc11_slice_poc", "f_sl", oracle="SELECT stream, pos, CAST(nullif(regexp_extract(name, '^NAL \\d+: (1|5) Slice.* POC (-?\\d+)', 2), '') AS BIGINT) AS poc FROM f_sl")
def sc11(t):
    return t.select("stream", "pos", S.slice_poc("name").alias("poc"))


@query("sc12_bytes_text", "f_cf", oracle="SELECT stream, frame, CASE WHEN b >= 10485760 THEN printf('%.1f MB', b / 1048576.0) WHEN b >= 10240 THEN printf('%.1f KB', b / 1024.0) WHEN b IS NOT NULL THEN concat(CAST(b AS VARCHAR), ' B') END AS text FROM (SELECT stream, frame, bytes - bytes % 512 AS b FROM f_cf)")
def sc12(t):
    return t.select("stream", "frame", S.bytes_text(F.col("bytes") - F.col("bytes") % 512).alias("text"))


@query("sc13_yuv709", "f_gr", oracle="""
WITH a AS (SELECT frame, y, x, v AS r, 255 - v AS g, (v * 3) % 256 AS b FROM f_gr), l AS (SELECT *, 0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b AS luma FROM a),
q AS (SELECT frame, y, x, CAST(least(255, greatest(0, floor(16 + luma * 219 / 255 + 0.5))) AS BIGINT) AS yy, CAST(least(255, greatest(0, floor(128 + (b - luma) / 1.8556::DOUBLE * 224 / 255 + 0.5))) AS BIGINT) AS cb, CAST(least(255, greatest(0, floor(128 + (r - luma) / 1.5748::DOUBLE * 224 / 255 + 0.5))) AS BIGINT) AS cr FROM l)
SELECT frame, y, x, yy, cb, cr, CAST(least(255, greatest(0, floor((298 * (yy - 16) + 459 * (cr - 128) + 128) / 256))) AS BIGINT) AS r2, CAST(least(255, greatest(0, floor((298 * (yy - 16) - 55 * (cb - 128) - 136 * (cr - 128) + 128) / 256))) AS BIGINT) AS g2, CAST(least(255, greatest(0, floor((298 * (yy - 16) + 541 * (cb - 128) + 128) / 256))) AS BIGINT) AS b2 FROM q""")
def sc13(t):
    q = t.select("frame", "y", "x", S.rgb_to_yuv709("v", 255 - F.col("v"), (F.col("v") * 3) % 256).alias("s")).select("frame", "y", "x", F.col("s.y").alias("yy"), "s.cb", "s.cr")
    return q.withColumn("s", S.yuv709_to_rgb("yy", "cb", "cr")).select("frame", "y", "x", "yy", "cb", "cr", F.col("s.r").alias("r2"), F.col("s.g").alias("g2"), F.col("s.b").alias("b2"))


@query("sc14_to_8bit", "f_gr", oracle="SELECT frame, y, x, CAST(floor(v * 4 / 4) AS BIGINT) AS v8, v * 4 >= 512 AS over FROM f_gr")
def sc14(t):
    return t.select("frame", "y", "x", S.to_8bit(F.col("v") * 4, 10).alias("v8"), (F.col("v") * 4 >= S.scaled_threshold(128, 10)).alias("over"))


@query("sc15_read_bits", "f_pl_a", oracle="SELECT ordinal, CAST(('0x' || substr(md5(payload), 1, 12))::UBIGINT >> CAST(48 - 24 - ordinal % 16 AS INTEGER) AS BIGINT) % 16777216 AS bits, CAST(('0x' || substr(md5(payload), CAST(ordinal % 4 * 4 + 1 AS BIGINT), 15))::UBIGINT AS BIGINT) AS sixty, CAST(('0x0' || substr(md5(payload), CAST(ordinal % 5 + 1 AS BIGINT), 15))::UBIGINT % 9007199254740992 AS BIGINT) AS low, CASE WHEN ordinal % 16 * 8 + 64 <= 128 THEN CAST(('0x' || substr(md5(payload), CAST(ordinal % 16 * 2 + 1 AS BIGINT), 2))::UBIGINT >> 7 AS BIGINT) END AS sign FROM f_pl_a")
def sc15(t):
    data, at = F.unhex(F.md5("payload")), F.col("ordinal")
    word = S.read_bits(data, at % 16 * 8, 64)
    return t.select("ordinal", S.read_bits(data, at % 16, 24).alias("bits"), S.read_bits(data, at % 4 * 16, 60).alias("sixty"), S.read_bits(data, at % 5 * 4 + 7, 53).alias("low"), (word < 0).cast("long").alias("sign"))


@query("sc16_sync_from_flags", "f_st", oracle="SELECT track, sample, (size * 4096) & 65536 = 0 AS sync_sample FROM f_st")
def sc16(t):
    return t.select("track", "sample", S.sync_from_flags(F.col("size") * 4096).alias("sync_sample"))


@query("sc17_model_mv", "f_mv", oracle="SELECT frame, algorithm, x, y, CAST(sign(d) * floor(abs(d) + 0.5) AS BIGINT) AS mx, CAST(sign(e) * floor(abs(e) + 0.5) AS BIGINT) AS my FROM (SELECT *, (1.5::DOUBLE + 1.01::DOUBLE * x + -0.02::DOUBLE * y - x) * 8 AS d, (-2.25::DOUBLE + 0.02::DOUBLE * x + 1.01::DOUBLE * y - y) * 8 AS e FROM f_mv)")
def sc17(t):
    mx, my = S.model_mv([F.lit(v) for v in (1.5, -2.25, 1.01, -0.02, 0.02, 1.01)], "x", "y")
    return t.select("frame", "algorithm", "x", "y", mx.alias("mx"), my.alias("my"))


@query("sc18_model_scale_angle", "f_mv", oracle="SELECT frame, algorithm, x, y, round(sqrt(abs(a * a + b * b)), 6) AS scale, round(degrees(atan2(2 * b, 2 * a)), 6) AS angle FROM (SELECT *, 1 + x / 1000.0::DOUBLE AS a, y / 1000.0::DOUBLE AS b FROM f_mv)")
def sc18(t):
    a, b = 1 + F.col("x") / 1000.0, F.col("y") / 1000.0
    scale, angle = S.model_scale_angle([F.lit(0.0), F.lit(0.0), a, -b, b, a])
    return t.select("frame", "algorithm", "x", "y", F.round(scale, 6).alias("scale"), F.round(angle, 6).alias("angle"))


@query("sc19_motion_from_model", "f_ts", oracle="""
WITH m AS (SELECT series, frame, v / 1000 AS p0, -v / 2000 AS p1, 1 + n / 1000.0::DOUBLE AS a, n / 500.0::DOUBLE AS b FROM f_ts),
s AS (SELECT *, sqrt(a * a + b * b) AS sc, atan2(b, a) AS an, p0 + a * 64 - b * 48 - 64 AS tx, p1 + b * 64 + a * 48 - 48 AS ty FROM m)
SELECT series, frame, round(-(cos(an) * tx + sin(an) * ty) / sc, 5) AS dx, round(-(cos(an) * ty - sin(an) * tx) / sc, 5) AS dy, round(-an, 6) AS angle, round(-ln(sc), 6) AS log_scale FROM s""")
def sc19(t):
    a, b = 1 + F.col("n") / 1000.0, F.col("n") / 500.0
    got = S.motion_from_model([F.col("v") / 1000, -F.col("v") / 2000, a, -b, b, a], 128.0, 96.0)
    return t.select("series", "frame", *[F.round(c, d).alias(n) for c, d, n in zip(got, (5, 5, 6, 6), ("dx", "dy", "angle", "log_scale"), strict=True)])


@query("sc20_warp_params", "f_ts", oracle="""
WITH c AS (SELECT series, frame, v / 100 AS dx, n / 10.0::DOUBLE AS dy, cos(n / 1000.0) * exp(-n / 10000.0) AS c, sin(n / 1000.0) * exp(-n / 10000.0) AS s FROM f_ts)
SELECT series, frame, round(64 - c * (64 + dx) - s * (48 + dy), 5) AS p0, round(48 + s * (64 + dx) - c * (48 + dy), 5) AS p1, round(c, 6) AS p2, round(s, 6) AS p3, round((64 - c * (64 + dx) - s * (48 + dy) + s * 0.5) / 2, 5) AS q0 FROM c""")
def sc20(t):
    p = S.warp_params(F.col("v") / 100, F.col("n") / 10.0, F.col("n") / 1000.0, F.col("n") / 10000.0, 128.0, 96.0)
    return t.withColumn("p", p).select("series", "frame", F.round(F.col("p")[0], 5).alias("p0"), F.round(F.col("p")[1], 5).alias("p1"), F.round(F.col("p")[2], 6).alias("p2"), F.round(F.col("p")[3], 6).alias("p3"), F.round(S.chroma_warp("p")[0], 5).alias("q0"))


@query("sc21_looks_like_link", "f_lk", oracle="SELECT line_no, line, regexp_matches(line, '^https?://') OR regexp_full_match(line, '[A-Za-z0-9_-]{11}') AS ok FROM f_lk")
def sc21(t):
    return t.select("line_no", "line", S.looks_like_link("line").alias("ok"))


@query("sc22_unit_label", "f_pl_a", oracle="SELECT ordinal, concat('TU ', CAST(ordinal % 5 AS VARCHAR), ' / OBU ', CAST(ordinal % 3 AS VARCHAR), ': ', CASE unit_type WHEN 1 THEN 'Sequence Header' WHEN 2 THEN 'Temporal Delimiter' WHEN 3 THEN 'Frame Header' WHEN 4 THEN 'Tile Group' WHEN 5 THEN 'Metadata' WHEN 6 THEN 'Frame' WHEN 7 THEN 'Redundant Frame Header' WHEN 8 THEN 'Tile List' ELSE 'Other' END) AS label FROM f_pl_a")
def sc22(t):
    return t.select("ordinal", S.unit_label(F.col("ordinal") % 5, F.col("ordinal") % 3, "unit_type").alias("label"))


@query("sc23_log_height", "f_cf", oracle="SELECT stream, frame, round(coalesce(ln(1 + bytes) / ln(1 + max(bytes) OVER ()), 0.5), 6) AS h, round(coalesce(bytes / max(bytes) OVER (), 0.5), 6) AS linear FROM f_cf")
def sc23(t):
    both = S.log_height(S.log_height(t).withColumnRenamed("height", "h"), logarithmic=False)
    return both.select("stream", "frame", F.round("h", 6).alias("h"), F.round("height", 6).alias("linear"))


@query("sql_scalars", "f_rd", oracle="SELECT frame, grp, count(*) FILTER (sse > 0) AS known, round(sum(CASE WHEN sse > 0 THEN 10 * log10(65025.0 * samples / sse) END), 3) AS psnr, sum(bits + 1) AS rate, CAST(sum(CASE WHEN frame >= 4 THEN 1 ELSE -1 END * CAST(floor((abs(frame - 4) + 1) / 3) AS BIGINT)) AS BIGINT) AS thirds, max(CASE WHEN samples * 1001 >= 10240 THEN format('{:.1f} KB', samples * 1001 / 1024.0::DOUBLE) ELSE concat(CAST(samples * 1001 AS VARCHAR), ' B') END) AS size, min(CASE WHEN sse IS NULL THEN '-' WHEN sse = 0 THEN 'lossless' WHEN sse > 0 THEN '+' END) AS label FROM f_rd GROUP BY frame, grp")
def sql_scalars(t):
    """The scalar functions as SQL calls them."""
    spark = t.sparkSession
    register(spark)
    t.createOrReplaceTempView("sb_samples")
    return spark.sql("""
        SELECT frame, grp, count(psnr_from_sse(sse, samples)) AS known, round(sum(psnr_from_sse(sse, samples)), 3) AS psnr, sum(rate_axis(bits)) AS rate,
               sum(divide_round(frame - 4, 3)) AS thirds, max(bytes_text(samples * 1001)) AS size,
               min(CASE WHEN psnr_label(sse, psnr_from_sse(sse, samples)) RLIKE '^[0-9-][0-9.]' THEN '+' ELSE psnr_label(sse, psnr_from_sse(sse, samples)) END) AS label
        FROM sb_samples GROUP BY frame, grp""")


@query("sql_mi_positions", "f_bl_a", oracle="SELECT frame, x, y, CAST(r AS BIGINT) AS mi_row, CAST(c AS BIGINT) AS mi_col FROM f_bl_a, range(0, 64) i(r), range(0, 64) j(c) WHERE r BETWEEN y // 4 AND (y + h - 1) // 4 AND c BETWEEN x // 4 AND (x + w - 1) // 4")
def sql_mi_positions(t):
    """The positions of every block by the table function."""
    spark = t.sparkSession
    register(spark)
    t.createOrReplaceTempView("blocks")
    return spark.sql("SELECT frame, b.x, b.y, p.mi_row, p.mi_col FROM blocks b, LATERAL mi_positions(b.x, b.y, b.w, b.h) p")
