"""Queries of the stream-diff family (DF), its joins, set operations and sorts."""

from pyspark.sql import functions as F

from ..operators import diff as df
from ..operators import frames as fr
from ..operators import grid as gr
from ..plans.find_diff import find_diff
from ..registry import query

_SX = "p AS (SELECT coalesce(a.section, b.section) AS section, coalesce(a.idx, b.idx) AS idx, a.section IS NOT NULL AS in_a, b.section IS NOT NULL AS in_b, a.name AS name_a, b.name AS name_b, a.value AS value_a, b.value AS value_b FROM f_sx_a a FULL JOIN f_sx_b b ON a.section = b.section AND a.idx = b.idx), d AS (SELECT *, CASE WHEN NOT in_b THEN 'OnlyInA' WHEN NOT in_a THEN 'OnlyInB' WHEN name_a IS DISTINCT FROM name_b OR value_a IS DISTINCT FROM value_b THEN 'ValueMismatch' END AS kind FROM p)"


@query("jn3_pair_by_position", "f_sx_a", "f_sx_b", oracle=f"WITH {_SX} SELECT section, idx, name_a, name_b, value_a, value_b, CASE WHEN NOT in_b THEN 'OnlyInA' WHEN NOT in_a THEN 'OnlyInB' ELSE 'Both' END AS side FROM p")
def jn3(a, b):
    return df.pair_by_position(a, b, ["section", "idx"], ["name", "value"])


#: Longest common subsequences by the plain table, a row of it for each left element from the last to the first, and the walk through it.
def _lcs(a: str, b: str) -> str:
    lists = lambda t, s: f"l{s} AS (SELECT section, list(name ORDER BY idx) AS n{s}, list(value ORDER BY idx) AS v{s}, list(idx ORDER BY idx) AS i{s} FROM {t} GROUP BY section)"
    return f"""{lists(a, 'a')}, {lists(b, 'b')}, ls AS (SELECT *, coalesce(len(na), 0) AS n, coalesce(len(nb), 0) AS m, CASE WHEN nb IS NULL THEN 'OnlyInA' WHEN na IS NULL THEN 'OnlyInB' ELSE 'Both' END AS side FROM la FULL JOIN lb USING (section)),
lt(section, i, r) AS (SELECT section, n + 1, list_transform(range(1, m + 2), lambda j: 0) FROM ls UNION ALL
  SELECT lt.section, lt.i - 1, list_transform(range(1, m + 2), lambda j: coalesce(list_max(list_transform(range(j, m + 1), lambda q: CASE WHEN na[lt.i - 1] = nb[q] THEN r[q + 1] + 1 ELSE r[q] END)), 0)) FROM lt JOIN ls USING (section) WHERE lt.i > 1),
lw(section, step, i, j, x, y) AS (SELECT section, -1, 1, 1, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM ls UNION ALL
  SELECT section, step + 1, CASE WHEN move < 2 THEN i + 1 ELSE i END, CASE WHEN move <> 1 THEN j + 1 ELSE j END, CASE WHEN move < 2 THEN i END, CASE WHEN move <> 1 THEN j END
  FROM (SELECT lw.*, CASE WHEN lw.i > n THEN 2 WHEN lw.j > m THEN 1 WHEN na[lw.i] = nb[lw.j] THEN 0 WHEN t1.r[lw.j] >= t0.r[lw.j + 1] THEN 1 ELSE 2 END AS move
        FROM lw JOIN ls ON ls.section = lw.section JOIN lt t0 ON t0.section = lw.section AND t0.i = lw.i LEFT JOIN lt t1 ON t1.section = lw.section AND t1.i = lw.i + 1 WHERE lw.i <= n OR lw.j <= m) z),
le AS (SELECT w.section, side, step, ia[x] AS index_a, ib[y] AS index_b, coalesce(na[x], nb[y]) AS name, va[x] AS value_a, vb[y] AS value_b,
  CASE WHEN y IS NULL THEN 'OnlyInA' WHEN x IS NULL THEN 'OnlyInB' WHEN va[x] IS DISTINCT FROM vb[y] THEN 'ValueMismatch' END AS kind FROM lw w JOIN ls USING (section) WHERE step >= 0),
lc AS (SELECT section, any_value(side) AS side, CASE WHEN any_value(side) = 'Both' THEN count(kind) ELSE 1 END AS differences, count(*) FILTER (side = 'Both' AND index_a IS NOT NULL AND index_b IS NOT NULL) AS aligned_pairs,
  count(*) FILTER (side = 'Both' AND kind = 'ValueMismatch') AS valuemismatch, count(*) FILTER (side = 'Both' AND kind = 'OnlyInA') AS onlyina, count(*) FILTER (side = 'Both' AND kind = 'OnlyInB') AS onlyinb, FALSE AS degraded FROM le GROUP BY section)"""


_LC = _lcs("f_sx_a", "f_sx_c")


@query("df9_diff_elements", "f_sx_a", "f_sx_c", oracle=f"WITH RECURSIVE {_LC} SELECT section, kind, index_a, index_b, name, value_a, value_b FROM le WHERE side = 'Both' AND kind IS NOT NULL")
def df9(a, b):
    return df.diff_elements(a, b)


@query("df8_align_names", "f_sx_a", "f_sx_c", oracle=f"WITH RECURSIVE {_LC} SELECT section, CAST(step AS BIGINT) AS step, index_a, index_b, FALSE AS degraded FROM le")
def df8(a, b):
    return df.align_names(a, b)


@query("df10_diff_sections", "f_sx_a", "f_sx_c", oracle=f"WITH RECURSIVE {_LC} SELECT * FROM lc")
def df10(a, b):
    return df.diff_sections(a, b)


@query("df1_diff_counts", "f_sx_a", "f_sx_c", oracle=f"WITH RECURSIVE {_LC} SELECT CAST(sum(differences) AS BIGINT) AS differences, CAST(sum(aligned_pairs) AS BIGINT) AS aligned_pairs, CAST(sum(valuemismatch) AS BIGINT) AS valuemismatch, CAST(sum(onlyina) AS BIGINT) AS onlyina, CAST(sum(onlyinb) AS BIGINT) AS onlyinb, count(*) FILTER (differences > 0) AS sections, count(*) FILTER (side <> 'Both') AS missing_sections, CAST(0 AS BIGINT) AS degraded_sections FROM lc")
def df1(a, b):
    return df.diff_counts(df.diff_sections(a, b))


@query("df2_first_difference", "f_sx_a", "f_sx_c", oracle=f"WITH RECURSIVE {_LC} SELECT section, index_a AS pos, kind, name FROM le WHERE side = 'Both' AND kind = 'ValueMismatch' QUALIFY row_number() OVER (PARTITION BY section ORDER BY index_a) = 1")
def df2(a, b):
    d = df.diff_elements(a, b).select("section", F.coalesce("index_a", "index_b").alias("pos"), "kind", "name")
    return df.first_difference(d, ["section"], ["pos"], F.col("kind") == "ValueMismatch")


_PL = "q AS (SELECT coalesce(a.ordinal, b.ordinal) AS ordinal, a.payload AS pa, b.payload AS pb FROM f_pl_a a FULL JOIN f_pl_b b ON a.ordinal = b.ordinal), z AS (SELECT ordinal, CASE WHEN pb IS NULL THEN 'OnlyInA' WHEN pa IS NULL THEN 'OnlyInB' WHEN length(pa) <> length(pb) THEN 'SizeDiffers' ELSE 'ContentDiffers' END AS kind, CASE WHEN pa IS NOT NULL AND pb IS NOT NULL THEN (SELECT min(i) FROM (SELECT unnest(range(0, greatest(length(pa), length(pb)) + 1)) AS i) r WHERE substr(pa, i + 1, 1) <> substr(pb, i + 1, 1)) END AS first_byte FROM q WHERE pa IS NULL OR pb IS NULL OR pa <> pb)"


@query("df11_diff_payloads", "f_pl_a", "f_pl_b", oracle=f"WITH {_PL} SELECT * FROM z")
def df11(a, b):
    return df.diff_payloads(a, b)


_ON = "a.frame = b.frame AND a.x = b.x AND a.y = b.y"


@query("jn4_pair_by_raster", "f_bl_a", "f_bl_b", oracle=f"SELECT coalesce(a.frame, b.frame) AS frame, coalesce(a.y, b.y) AS y, coalesce(a.x, b.x) AS x, a.bit_start AS start_bit_a, b.bit_start AS start_bit_b, CASE WHEN b.frame IS NULL THEN 'OnlyInA' WHEN a.frame IS NULL THEN 'OnlyInB' ELSE 'Both' END AS side FROM f_bl_a a FULL JOIN f_bl_b b ON {_ON}")
def jn4(a, b):
    return df.pair_by_raster(*[x.withColumnRenamed("bit_start", "start_bit") for x in (a, b)])


@query("so3_positions_union", "f_bl_a", "f_bl_b", oracle="SELECT frame, y, x FROM f_bl_a UNION SELECT frame, y, x FROM f_bl_b")
def so3(a, b):
    return df.positions_union(a, b)


@query("df12_diff_bit_windows", "f_bl_a", "f_bl_b", oracle=f"""
WITH w AS (SELECT coalesce(a.frame, b.frame) AS frame, coalesce(a.y, b.y) AS y, coalesce(a.x, b.x) AS x, a.bit_start % 160 AS sa, b.bit_start % 160 AS sb, a.frame IS NOT NULL AND b.frame IS NOT NULL AS both_ FROM f_bl_a a FULL JOIN f_bl_b b ON {_ON}),
v AS (SELECT *, CASE WHEN sa + 24 <= 128 THEN (('0x' || substr(md5(CAST(frame AS VARCHAR)), CAST(floor(sa / 8) * 2 + 1 AS BIGINT), 8))::UBIGINT >> CAST(8 - sa % 8 AS INTEGER)) % 16777216 END AS wa, CASE WHEN sb + 24 <= 128 THEN (('0x' || substr(md5(CAST(frame AS VARCHAR)), CAST(floor(sb / 8) * 2 + 1 AS BIGINT), 8) || CASE WHEN floor(sb / 8) * 2 + 8 > 32 THEN '00' ELSE '' END)::UBIGINT >> CAST(8 - sb % 8 AS INTEGER)) % 16777216 END AS wb FROM w)
SELECT frame, y, x, CASE WHEN NOT both_ THEN 'Missing' WHEN sa + 24 > 128 OR sb + 24 > 128 THEN 'Unreadable' WHEN sa = sb OR wa = wb THEN 'Equal' ELSE 'Differ' END AS state FROM v""")
def df12(a, b):
    probe = lambda t: t.select("frame", "y", "x", (F.col("bit_start") % 160).alias("start_bit"))
    data = a.select("frame").distinct().select("frame", F.unhex(F.md5(F.col("frame").cast("string"))).alias("data"))
    return df.diff_bit_windows(probe(a), data, probe(b), data)


@query("df3_probe_blocks", "f_bl_a", oracle="SELECT frame, CAST(floor(y / 64) AS BIGINT) AS sb_row, CAST(floor(x / 64) AS BIGINT) AS sb_col, min(bit_start - frame * 6400 - 300) AS start_bit FROM f_bl_a WHERE bit_start - frame * 6400 - 300 >= 0 GROUP BY 1, 2, 3")
def df3(a):
    return df.probe_blocks(a, F.col("frame") * 6400 + 300, 64)


_MI = "mi_{0} AS (SELECT {0}.*, CAST(r AS BIGINT) AS mi_row, CAST(c AS BIGINT) AS mi_col FROM f_bl_{0} {0}, range(0, 32) i(r), range(0, 32) j(c) WHERE r >= floor({0}.y / 4) AND r <= floor((least({0}.y + {0}.h, 128) - 1) / 4) AND c >= floor({0}.x / 4) AND c <= floor((least({0}.x + {0}.w, 128) - 1) / 4)), g_{0} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY frame, mi_row, mi_col ORDER BY bit_start, y, x) AS rn FROM mi_{0}) WHERE rn = 1)"


@query("df13_mi_grid", "f_bl_a", oracle=f"WITH {_MI.format('a')} SELECT frame, mi_row, mi_col, x, y, w, h, bit_start, bit_end, syntax FROM g_a")
def df13(a):
    return df.mi_grid(a, 128, 128)


@query("df4_coverage", "f_bl_a", oracle=f"WITH {_MI.format('a')} SELECT frame, count(DISTINCT mi_row * 100 + mi_col) AS covered, round(count(DISTINCT mi_row * 100 + mi_col) * 100.0::DOUBLE / 1024, 4) AS percent, count(DISTINCT mi_row * 100 + mi_col) * 100.0 / 1024 >= 95 AS complete FROM mi_a GROUP BY frame")
def df4(a):
    return df.coverage(a, 128, 128).withColumn("percent", F.round("percent", 4))


@query("df5_tiling_check", "f_bl_a", oracle=f"WITH {_MI.format('a')}, n AS (SELECT frame, mi_row, mi_col, count(*) AS n FROM mi_a GROUP BY 1, 2, 3) SELECT f.frame, count(*) FILTER (n.n IS NULL) AS holes, count(*) FILTER (n.n > 1) AS overlaps, count(*) FILTER (n.n = 1) AS single, CAST(0 AS BIGINT) AS duplicates FROM (SELECT DISTINCT frame FROM f_bl_a) f CROSS JOIN range(0, 32) i(r) CROSS JOIN range(0, 32) j(c) LEFT JOIN n ON n.frame = f.frame AND n.mi_row = r AND n.mi_col = c GROUP BY f.frame")
def df5(a):
    return df.tiling_check(a, 128, 128)


@query("df6_probe_sb_size", "f_bl_a", "f_bl_b", oracle="SELECT CASE WHEN max(greatest(w, h)) > 64 THEN 128 ELSE 64 END AS sb_size FROM (SELECT w, h FROM f_bl_a UNION ALL SELECT w, h FROM f_bl_b)")
def df6(a, b):
    return df.probe_sb_size(a, b)


@query("df19_bit_range_check", "f_bl_a", oracle="WITH k AS (SELECT frame, min(bit_start) + 10 AS fb, max(bit_end) AS lb FROM f_bl_a GROUP BY frame), n AS (SELECT a.*, fb, lb, lead(bit_start) OVER (PARTITION BY a.frame ORDER BY bit_start, bit_end) AS nx FROM f_bl_a a JOIN k ON k.frame = a.frame) SELECT frame, count(*) FILTER (bit_start >= bit_end) AS empty, count(*) FILTER (bit_start < fb OR bit_end > lb) AS outside, count(*) FILTER (nx > bit_end) AS gaps, round(sum(CASE WHEN bit_start < bit_end THEN bit_end - bit_start ELSE 0 END) * 100.0::DOUBLE / (lb - fb), 4) AS percent, sum(CASE WHEN bit_start < bit_end THEN bit_end - bit_start ELSE 0 END) * 100.0 / (lb - fb) >= 80 AS ok FROM n GROUP BY frame, fb, lb")
def df19(a):
    k = a.groupBy("frame").agg((F.min("bit_start") + 10).alias("first_bit"), F.max("bit_end").alias("last_bit"))
    return df.bit_range_check(a, k).withColumn("percent", F.round("percent", 4))


@query("df20_bits_budget", "f_bl_a", oracle="SELECT frame, CAST(sum(bit_end - bit_start) AS BIGINT) AS block_bits, 1700 + frame * 3 AS bits, round(sum(bit_end - bit_start) * 100.0::DOUBLE / (1700 + frame * 3), 4) AS percent, sum(bit_end - bit_start) * 100.0 / (1700 + frame * 3) BETWEEN 70 AND 100 AS ok FROM f_bl_a GROUP BY frame")
def df20(a):
    return df.bits_budget(a, a.select("frame").distinct().withColumn("bits", 1700 + F.col("frame") * 3)).withColumn("percent", F.round("percent", 4))


@query("df15_split_sb_values", "f_bl_a", oracle="SELECT frame, CAST(floor(y / 64) AS BIGINT) AS sb_row, CAST(floor(x / 64) AS BIGINT) AS sb_col, concat('sb_qindex=', CAST(frame % 5 AS VARCHAR)) AS \"values\" FROM f_bl_a GROUP BY 1, 2, 3")
def df15(a):
    return df.split_sb_values(a, ("sb_bitcount", "sb_qindex"), 64)[1]


_STRIP = "regexp_replace({}, '\\|sb_qindex=[0-9]+$', '')"


def _diff_sql(sa="a.syntax", sb="b.syntax"):
    return f"""{_MI.format('a')}, {_MI.format('b')}, m AS (SELECT coalesce(a.frame, b.frame) AS frame, coalesce(a.mi_row, b.mi_row) AS mi_row, coalesce(a.mi_col, b.mi_col) AS mi_col,
  CASE WHEN a.frame IS NULL THEN '' ELSE concat_ws(',', CAST(a.x AS VARCHAR), CAST(a.y AS VARCHAR), CAST(a.w AS VARCHAR), CAST(a.h AS VARCHAR)) END AS rect_a, CASE WHEN b.frame IS NULL THEN '' ELSE concat_ws(',', CAST(b.x AS VARCHAR), CAST(b.y AS VARCHAR), CAST(b.w AS VARCHAR), CAST(b.h AS VARCHAR)) END AS rect_b, {sa} AS sa, {sb} AS sb, a.frame IS NULL AS na, b.frame IS NULL AS nb FROM g_a a FULL JOIN g_b b ON a.frame = b.frame AND a.mi_row = b.mi_row AND a.mi_col = b.mi_col),
k AS (SELECT *, CASE WHEN na THEN 'MissingInA' WHEN nb THEN 'MissingInB' WHEN rect_a <> rect_b THEN 'GeometryDiffers' WHEN sa IS DISTINCT FROM sb THEN 'SyntaxDiffers' END AS kind FROM m),
dd AS (SELECT frame, CAST(floor(mi_row / 16) AS BIGINT) AS sb_row, CAST(floor(mi_col / 16) AS BIGINT) AS sb_col, kind, rect_a, rect_b, CAST(floor(min(mi_row * 1000 + mi_col) / 1000) AS BIGINT) AS mi_row, min(mi_row * 1000 + mi_col) % 1000 AS mi_col, count(*) AS positions FROM k WHERE kind IS NOT NULL GROUP BY 1, 2, 3, 4, 5, 6)"""


@query("df14_diff_blocks", "f_bl_a", "f_bl_b", oracle=f"WITH {_diff_sql()} SELECT * FROM dd")
def df14(a, b):
    return df.diff_blocks(a, b, 128, 128)


@query("df1_block_counts", "f_bl_a", "f_bl_b", oracle=f"WITH {_diff_sql()} SELECT frame, count(*) AS compared, count(kind) AS differing, count(DISTINCT CASE WHEN kind IS NOT NULL THEN CAST(floor(mi_row / 16) * 1000 + floor(mi_col / 16) AS BIGINT) END) AS superblocks FROM k GROUP BY frame")
def df1_blocks(a, b):
    return df.block_counts(a, b, 128, 128)


@query("df14_diff_block_maps", "f_bl_a", "f_bl_b", oracle=f"""WITH {_diff_sql()}, fr AS (SELECT DISTINCT frame FROM f_bl_a),
er AS (SELECT frame, CASE WHEN frame % 7 = 3 THEN concat('the two frames are not the same size: A 32x32 MI, B ', CASE WHEN frame % 2 = 0 THEN '0x0' ELSE '32x16' END, ' MI') WHEN frame % 7 = 4 THEN 'the two streams use different superblock sizes' WHEN frame % 7 = 5 THEN 'empty frame' END AS error FROM fr)
SELECT dd.*, CAST(NULL AS VARCHAR) AS error FROM dd WHERE frame % 7 NOT IN (3, 4, 5) UNION ALL SELECT frame, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, error FROM er WHERE error IS NOT NULL""")
def df14_maps(a, b):
    """Every seventh frame has other sizes (or is missing in B), another superblock size, or no picture."""
    n, size = F.col("frame"), F.lit(128)
    base = a.select("frame").distinct()
    none = F.when(n % 7 == 5, 0).otherwise(size)
    maps_a = base.select("frame", none.alias("width"), none.alias("height"), F.lit(64).alias("sb"))
    maps_b = base.where((n % 7 != 3) | (n % 2 == 1)).select("frame", F.when(n % 7 == 3, 64).otherwise(none).alias("width"), none.alias("height"), F.when(n % 7 == 4, 128).otherwise(64).alias("sb"))
    return df.diff_block_maps(a, b, maps_a, maps_b)


@query("df16_first_sb", "f_bl_a", "f_bl_b", oracle=f"""WITH {_diff_sql(_STRIP.format('a.syntax'), _STRIP.format('b.syntax'))}, f AS (SELECT frame, min(sb_row * 1000 + sb_col) AS f FROM dd GROUP BY frame),
va AS (SELECT frame, floor(y / 64) AS r, floor(x / 64) AS c, arg_min(regexp_extract(syntax, 'sb_qindex=[0-9]+'), y * 1000 + x) AS v FROM f_bl_a GROUP BY 1, 2, 3), vb AS (SELECT frame, floor(y / 64) AS r, floor(x / 64) AS c, arg_min(regexp_extract(syntax, 'sb_qindex=[0-9]+'), y * 1000 + x) AS v FROM f_bl_b GROUP BY 1, 2, 3),
t AS (SELECT va.frame, min(CAST(va.r * 1000 + va.c AS BIGINT)) AS t FROM va JOIN vb USING (frame, r, c) LEFT JOIN f ON f.frame = va.frame WHERE va.v <> vb.v AND (f.f IS NULL OR va.r * 1000 + va.c < f.f) GROUP BY va.frame)
SELECT coalesce(f.frame, t.frame) AS frame, CAST(floor(f / 1000) AS BIGINT) AS first_sb_row, f % 1000 AS first_sb_col, CAST(floor(t / 1000) AS BIGINT) AS totals_only_sb_row, t % 1000 AS totals_only_sb_col FROM f FULL JOIN t ON t.frame = f.frame""")
def df16(a, b):
    names = ("sb_bitcount", "sb_qindex")
    (oa, va), (ob, vb) = df.split_sb_values(a, names, 64), df.split_sb_values(b, names, 64)
    keys = ["frame", "sb_row", "sb_col"]
    values = va.join(vb.withColumnRenamed("values", "other"), keys).where("values <> other")
    return df.first_sb(df.diff_blocks(oa, ob, 128, 128), values)


_OTHER_GRID = "CASE WHEN frame % 2 = 1 AND x % 13 = 5 THEN (v + 1) % 256 ELSE v END"
_RECON = f"""rc AS (SELECT frame AS "at", count(*) AS k, arg_min(x, {{'y': y, 'x': x}}) AS px, arg_min(y, {{'y': y, 'x': x}}) AS py FROM f_gr WHERE v <> {_OTHER_GRID} GROUP BY frame)"""
_LIVE = """live AS (SELECT stream AS "at", text FROM (SELECT stream, CASE WHEN stream % 3 = 0 THEN '' ELSE frame_type END AS text, row_number() OVER (PARTITION BY stream ORDER BY frame DESC) AS k FROM f_cf) WHERE k = 1 AND text <> '')"""
_LISTED = """ranked AS (SELECT *, row_number() OVER (PARTITION BY step ORDER BY "at", message) AS rank, count(*) OVER (PARTITION BY step) AS n FROM found) SELECT step, source, severity, CAST(rank AS INTEGER) AS rank, "at", message FROM ranked WHERE rank <= {most} UNION ALL SELECT DISTINCT step, source, 'Info', {most} + 1, CAST(NULL AS BIGINT), concat('Only the first {most} of ', CAST(n AS VARCHAR), ' are listed') FROM ranked WHERE n > {most}"""
_FOUND = """SELECT 0 AS step, 'header' AS source, 'Diff' AS severity, section AS "at", concat(CAST(n AS VARCHAR), ' {said}') AS message FROM s UNION ALL SELECT 1, 'payload', 'Diff', ordinal, kind FROM z"""
_FOUND_LAST = """UNION ALL SELECT {recon}, 'reconstruction', 'Diff', "at", concat('Reconstruction differs in ', CAST(k AS VARCHAR), ' samples, pixel (x, y) = (', CAST(px AS VARCHAR), ', ', CAST(py AS VARCHAR), ')') FROM rc UNION ALL SELECT {decoder}, 'decoder', 'Error', "at", trim(text) FROM live"""


def _grids(t):
    """One plane and its changed copy."""
    changed = F.when((F.col("frame") % 2 == 1) & (F.col("x") % 13 == 5), (F.col("v") + 1) % 256).otherwise(F.col("v"))
    return t.withColumn("plane", F.lit(0)), t.withColumn("plane", F.lit(0)).withColumn("v", changed)


def _live(c):
    text = F.when(F.col("stream") % 3 == 0, "").otherwise(F.col("frame_type")).alias("text")
    return fr.latest_error(c.select("stream", "frame", text), "stream", "frame", "text").select(F.col("stream").alias("item"), "text")


_DF18 = f"""WITH RECURSIVE {_LC}, {_PL}, {_RECON}, {_LIVE}, {_diff_sql()}, s AS (SELECT section, differences AS n FROM lc WHERE differences > 0),
shown AS (SELECT ordinal AS coded_id, row_number() OVER (ORDER BY ordinal) - 1 AS display_index FROM f_pl_a WHERE ordinal % 3 <> 2), fi AS (SELECT arg_min(display_index, ordinal) AS frame FROM z JOIN shown ON ordinal = coded_id),
bs AS (SELECT sb_row, sb_col, arg_min(kind, {{'r': mi_row, 'c': mi_col, 'k': kind}}) AS kind, CAST(sum(positions) AS BIGINT) AS n FROM dd JOIN fi ON dd.frame = fi.frame GROUP BY sb_row, sb_col),
found AS ({_FOUND.format(said='element differences')} UNION ALL SELECT 2, 'block', 'Diff', sb_row * 2 + sb_col, concat(CAST(n AS VARCHAR), ' positions differ in SB(', CAST(sb_row AS VARCHAR), ', ', CAST(sb_col AS VARCHAR), '): ', kind) FROM bs {_FOUND_LAST.format(recon=3, decoder=4)}), {_LISTED.format(most=df.PROBLEM_ROWS)}"""


@query("df18_find_diff", "f_sx_a", "f_sx_c", "f_pl_a", "f_pl_b", "f_bl_a", "f_bl_b", "f_gr", "f_cf", oracle=_DF18)
def df18(sa, sb, pa, pb, ba, bb, g, c):
    # Every unit is a frame; each third one is hidden and shown by the unit after it.
    n = F.col("ordinal")
    headers = pa.select(F.lit(0).alias("stream"), n.alias("pos"), n.alias("coded_id"), F.lit(0).alias("show_existing"), (n % 8).alias("map_idx"), F.when(n % 3 == 2, 0).otherwise(1).alias("show_frame"), F.lit(1).cast("long").alias("refresh_flags"))
    return find_diff(sa, sb, pa, pb, ba, bb, headers, *_grids(g), _live(c), 128, 128)


_PTS = "pt AS (SELECT DISTINCT frame, CAST(px AS BIGINT) AS px, CAST(py AS BIGINT) AS py FROM f_bl_a, range(5, 128, 30) a(px), range(3, 128, 41) b(py))"


def _points(a):
    seq = lambda lo, step: F.explode(F.sequence(F.lit(lo).cast("long"), F.lit(127).cast("long"), F.lit(step).cast("long")))
    return a.select("frame").distinct().select("frame", seq(5, 30).alias("px")).select("frame", "px", seq(3, 41).alias("py"))


@query("jn16_blocks_at", "f_bl_a", oracle=f"WITH {_PTS} SELECT pt.frame, px, py, x, y, w, h, syntax FROM pt JOIN f_bl_a b ON b.frame = pt.frame AND px >= x AND px < x + w AND py >= y AND py < y + h")
def jn16(a):
    return df.blocks_at(_points(a), a).select("frame", "px", "py", "x", "y", "w", "h", "syntax")


def _at(t, v):
    return f"(SELECT frame, px, py, substr(e, 1, instr(e, '=') - 1) AS name, min(substr(e, instr(e, '=') + 1)) AS {v} FROM (SELECT pt.frame, px, py, unnest(string_split(syntax, '|')) AS e FROM pt JOIN {t} b ON b.frame = pt.frame AND px >= x AND px < x + w AND py >= y AND py < y + h) GROUP BY 1, 2, 3, 4)"


@query("jn17_compare_at_pixel", "f_bl_a", "f_bl_b", oracle=f"WITH {_PTS} SELECT frame, px, py, name, value_a, value_b, value_a IS NOT DISTINCT FROM value_b AS equal FROM {_at('f_bl_a', 'value_a')} FULL JOIN {_at('f_bl_b', 'value_b')} USING (frame, px, py, name)")
def jn17(a, b):
    return df.compare_at_pixel(_points(a), a, b)


@query("so2_distinct_blocks", "f_bl_a", "f_bl_b", oracle="SELECT DISTINCT frame, x, y, w, h FROM (SELECT * FROM f_bl_a UNION ALL SELECT * FROM f_bl_b)")
def so2(a, b):
    return df.distinct_blocks(a.unionByName(b)).select("frame", "x", "y", "w", "h")


@query("so4_unchanged", "f_bl_a", "f_bl_b", oracle="SELECT frame, x, y, w, h, bit_start, bit_end, syntax FROM f_bl_a INTERSECT SELECT frame, x, y, w, h, bit_start, bit_end, syntax FROM f_bl_b")
def so4(a, b):
    return df.unchanged(a, b)


@query("so4_only_in_a", "f_bl_a", "f_bl_b", oracle="SELECT frame, x, y, w, h, bit_start, bit_end, syntax FROM f_bl_a EXCEPT ALL SELECT frame, x, y, w, h, bit_start, bit_end, syntax FROM f_bl_b")
def so4_only(a, b):
    return df.only_in(a, b)


@query("so5_replace_slice", "f_mv", oracle="SELECT frame, algorithm, x, y, native_cost FROM f_mv WHERE NOT (algorithm = 'A' AND frame < 10) UNION ALL SELECT frame, algorithm, x, y, native_cost + 1 FROM f_mv WHERE algorithm = 'A' AND frame < 10 AND x < 64")
def so5(t):
    s = t.select("frame", "algorithm", "x", "y", "native_cost")
    keep = s.where("NOT (algorithm = 'A' AND frame < 10 AND x < 64)")
    new = s.where("algorithm = 'A' AND frame < 10 AND x < 64").withColumn("native_cost", F.col("native_cost") + 1)
    return df.replace_slice(keep, new, ["algorithm", "frame"])


@query("so6_dedupe_paths", "pages", oracle="SELECT page_id, canonical, url FROM (SELECT page_id, url, CASE WHEN page_id % 4 = 0 THEN NULL ELSE concat('p', CAST(page_id % 9 AS VARCHAR)) END AS canonical, row_number() OVER (PARTITION BY page_id % 4 = 0, CASE WHEN page_id % 4 = 0 THEN url ELSE concat('p', CAST(page_id % 9 AS VARCHAR)) END ORDER BY page_id) AS k FROM pages) WHERE k = 1")
def so6(p):
    items = p.select("page_id", F.when(F.col("page_id") % 4 != 0, F.concat(F.lit("p"), (F.col("page_id") % 9).cast("string"))).alias("canonical"), "url")
    return df.dedupe_paths(items, "canonical", "url", "page_id")


@query("jn12_compare_goldens", "f_md", oracle="SELECT frame, expected, actual, CASE WHEN actual IS NULL THEN 'not produced' WHEN expected = actual THEN 'ok' ELSE 'differs' END AS state FROM f_md")
def jn12(t):
    return df.compare_goldens(t)


@query("df7_cap_rows", "f_sx_a", oracle="SELECT section, idx, name, FALSE AS info FROM (SELECT section, idx, name, row_number() OVER (PARTITION BY section ORDER BY idx) AS k FROM f_sx_a) WHERE k <= 2 UNION ALL SELECT section, NULL, NULL, TRUE FROM f_sx_a GROUP BY section HAVING count(*) > 2")
def df7(a):
    return df.cap_rows(a.select("section", "idx", "name"), ["section"], ["idx"], 2)


@query("tk1_raster_sort", "f_bl_a", oracle="SELECT frame, y, x, bit_start FROM f_bl_a ORDER BY frame, y, x")
def tk1(a):
    return df.raster_sort(a.select("frame", "y", "x", "bit_start"))


@query("tk2_first_n_text", "f_sx_a", oracle="WITH r AS (SELECT section, name, row_number() OVER (PARTITION BY section ORDER BY idx) AS k, count(*) OVER (PARTITION BY section) AS n FROM f_sx_a) SELECT section, CASE WHEN max(n) > 3 THEN concat(string_agg(name, ', ' ORDER BY k) FILTER (k <= 3), ' ... ', CAST(max(n) - 3 AS VARCHAR), ' more') ELSE string_agg(name, ', ' ORDER BY k) FILTER (k <= 3) END AS summary FROM r GROUP BY section")
def tk2(a):
    return df.first_n_text(a, "section", "idx", "name", 3)


@query("tk2_first_n", "f_sx_a", "f_sx_c", oracle=f"WITH RECURSIVE {_LC} SELECT section, coalesce(index_a, index_b) AS idx, kind FROM le WHERE side = 'Both' AND kind IS NOT NULL ORDER BY section, idx, kind LIMIT 20")
def tk2_n(a, b):
    return df.diff_elements(a, b).select("section", F.coalesce("index_a", "index_b").alias("idx"), "kind").orderBy("section", "idx", "kind").limit(20)


def _so1(most):
    sections = "s AS (SELECT section, differences AS n FROM lc WHERE differences > 0)"
    found = f"found AS ({_FOUND.format(said='differences')} {_FOUND_LAST.format(recon=2, decoder=3)})"
    return f"WITH RECURSIVE {_LC}, {_PL}, {_RECON}, {_LIVE}, {sections}, {found}, {_LISTED.format(most=most)}"


def _findings(sa, sb, pa, pb, g, c):
    s = df.diff_sections(sa, sb).where("differences > 0").select(F.col("section").alias("at"), F.concat(F.col("differences").cast("string"), F.lit(" differences")).alias("message"))
    payloads = df.diff_payloads(pa, pb).select(F.col("ordinal").alias("at"), F.col("kind").alias("message"))
    return {"header": s, "payload": payloads, "reconstruction": df.recon_findings(gr.plane_diff(*_grids(g), ("frame", "plane"))), "decoder": df.decoder_findings(_live(c), "item", "text")}


@query("so1_problems", "f_sx_a", "f_sx_c", "f_pl_a", "f_pl_b", "f_gr", "f_cf", oracle=_so1(1_000_000_000))
def so1(*views):
    """All findings of every source."""
    return df.problems(_findings(*views), {"decoder": "Error"}, most=1_000_000_000)


@query("so1_problems_listed", "f_sx_a", "f_sx_c", "f_pl_a", "f_pl_b", "f_gr", "f_cf", oracle=_so1(5))
def so1_listed(*views):
    return df.problems(_findings(*views), {"decoder": "Error"}, most=5)
