"""Queries of the rate-distortion family (RD) and its joins."""

from pyspark.sql import functions as F

from ..operators import rd
from ..registry import query

P = "CASE WHEN samples > 0 AND sse > 0 THEN 10 * log10(65025.0 * samples / sse) END"
SUMS = "sum(bits) AS bits, sum(sse) AS sse, CAST(sum(samples) AS BIGINT) AS samples"


def shown_percent(df):
    """Two digits after the point, and of large numbers seven in all: the synthetic curves cross wildly."""
    p = F.col("percent")
    return df.withColumn("percent", F.when(F.abs(p) < 100000, F.round(p, 2)).when(p.isNotNull(), F.format_string("%.6e", p).cast("double")))


def _rounded(df, **digits):
    # Sums of prices end on exact halves of a digit, which the order of adding tips either way: errors are moved off them.
    return df.withColumns({c: F.round(F.col(c) + 0.000000033 if c == "sse" else c, d) for c, d in digits.items()})


def _totals(keys, where="1 = 1"):
    return f"SELECT {keys}, round(bits, 2) AS bits, round(sse + 0.000000033::DOUBLE, 6) AS sse, samples, round({P}, 4) AS psnr FROM (SELECT {keys}, {SUMS} FROM f_rd WHERE {where} GROUP BY {keys})"


@query("rd1_frame_totals", "f_rd", oracle=_totals("frame, grp, point"))
def rd1(t):
    return _rounded(rd.frame_totals(t), bits=2, sse=6, psnr=4)


@query("rd2_sequence_totals", "f_rd", oracle=_totals("sb_row, sb_col, grp, point", "frame BETWEEN 2 AND 5"))
def rd2(t):
    return _rounded(rd.sequence_totals(t, 2, 5, ("sb_row", "sb_col")), bits=2, sse=6, psnr=4)


@query("rd3_totals_cube", "f_rd", oracle=f"SELECT frame, sb_row, sb_col, grp, point, round(bits, 2) AS bits, round(sse + 0.000000033::DOUBLE, 6) AS sse, samples, level, round({P}, 4) AS psnr FROM (SELECT frame, sb_row, sb_col, grp, point, {SUMS}, CASE WHEN grouping(frame) = 0 THEN 'frame' WHEN grouping(sb_row) = 0 THEN 'block' ELSE 'sequence' END AS level FROM f_rd GROUP BY GROUPING SETS ((frame, grp, point), (sb_row, sb_col, grp, point), (grp, point)))")
def rd3(t):
    return _rounded(rd.totals_cube(t), bits=2, sse=6, psnr=4)


@query("rd4_common_range", "f_rd", oracle="SELECT a AS first, b AS last, CASE WHEN a <= b THEN 'ok' ELSE 'empty' END AS status FROM (SELECT max(a) AS a, min(b) AS b FROM (SELECT min(frame) AS a, max(frame) AS b FROM f_rd GROUP BY grp, point))")
def rd4(t):
    return rd.common_range(t)


@query("rd5_complete_frames", "f_rd", oracle="SELECT sb_col, grp, point, frame, count(*) AS blocks FROM f_rd GROUP BY sb_col, grp, point, frame HAVING count(*) = count(sse)")
def rd5(t):
    return rd.complete_frames(t, ("sb_col", "grp", "point"))


TOTALS = f"tot AS (SELECT *, {P} AS psnr FROM (SELECT sb_row, sb_col, grp, point, {SUMS} FROM f_rd GROUP BY sb_row, sb_col, grp, point))"
CURVE = "cv AS (SELECT sb_row, sb_col, grp, psnr, min(bits + 1) AS rate, max(samples) AS samples FROM tot WHERE samples > 0 AND psnr IS NOT NULL AND bits + 1 > 0 GROUP BY sb_row, sb_col, grp, psnr)"


@query("rd6_curve", "f_rd", oracle=f"WITH {TOTALS}, {CURVE} SELECT sb_row, sb_col, grp, round(psnr, 4) AS psnr, round(rate, 2) AS rate, samples FROM cv")
def rd6(t):
    c = rd.curve(rd.sequence_totals(t, by=("sb_row", "sb_col")), ("sb_row", "sb_col", "grp"))
    return _rounded(c, psnr=4, rate=2)


@query("rd7_poly_fit", "f_rd", oracle=f"WITH {TOTALS}, {CURVE}, g AS (SELECT grp, count(*) AS n, avg(psnr) AS centre, regr_slope(ln(rate), psnr) AS c1, avg(ln(rate)) AS c0 FROM cv GROUP BY grp) SELECT grp, n, round(centre, 4) AS centre, round(c0, 4) AS c0, round(c1, 4) AS c1 FROM g")
def rd7(t):
    c = rd.curve(rd.sequence_totals(t, by=("sb_row", "sb_col")), ("sb_row", "sb_col", "grp")).withColumn("y", F.ln("rate"))
    return _rounded(rd.poly_fit(c, ("grp",), "psnr", "y", 1), centre=4, c0=4, c1=4)


@query("rd8_fit_points", "f_rd", oracle=f"WITH {TOTALS}, {CURVE}, g AS (SELECT grp, avg(psnr) AS centre, regr_slope(ln(rate), psnr) AS c1, avg(ln(rate)) AS c0 FROM cv GROUP BY grp) SELECT grp, CAST(s AS INTEGER) AS step, round(centre - 2 + 4.0::DOUBLE * s / 8, 4) AS x, round(c0 + c1 * (-2 + 4.0::DOUBLE * s / 8), 4) AS y FROM g, range(0, 9) r(s)")
def rd8(t):
    c = rd.curve(rd.sequence_totals(t, by=("sb_row", "sb_col")), ("sb_row", "sb_col", "grp")).withColumn("y", F.ln("rate"))
    fits = rd.poly_fit(c, ("grp",), "psnr", "y", 1)
    return _rounded(rd.fit_points(fits, ("grp",), 1, F.col("centre") - 2, F.col("centre") + 2, 8), x=4, y=4)


def _fit(prefix, source, keys):
    """SQL twin of the fit: the orthogonal basis over the points, one table expression a term."""
    dot = lambda term: f"list_sum(list_transform(range(1, len(us) + 1), lambda i: {term}))"
    out = [f"{prefix}0 AS (SELECT {keys}, degree, us, ys, list_transform(us, lambda x: 0.0::DOUBLE) AS old, list_transform(us, lambda x: 1.0::DOUBLE) AS now, 0.0::DOUBLE AS o0, 0.0::DOUBLE AS o1, 1.0::DOUBLE AS n0, 1.0::DOUBLE AS n1, 0.0::DOUBLE AS s0, 0.0::DOUBLE AS s1, 1.0::DOUBLE AS size FROM {source})"]
    for k in range(4):
        out.append(f"{prefix}a{k} AS (SELECT *, CASE WHEN {dot('now[i] * now[i]')} >= 1e-12 THEN {dot('now[i] * now[i]')} END AS sq, {dot('ys[i] * now[i]')} AS yn, {dot('us[i] * now[i] * now[i]')} AS un FROM {prefix}{k})")
        ratio = "0.0" if k == 0 else "sq / size"
        out.append(f"{prefix}b{k} AS (SELECT *, CASE WHEN degree >= {k} THEN yn / sq ELSE 0.0 END AS share, un / sq AS shift, {ratio} AS ratio FROM {prefix}a{k})")
        out.append(f"{prefix}{k + 1} AS (SELECT {keys}, degree, us, ys, now AS old, list_transform(range(1, len(us) + 1), lambda i: (us[i] - shift) * now[i] - ratio * old[i]) AS now, n0 AS o0, n1 AS o1, (-power(3.0::DOUBLE, -0.5) - shift) * n0 - ratio * o0 AS n0, (power(3.0::DOUBLE, -0.5) - shift) * n1 - ratio * o1 AS n1, s0 + share * n0 AS s0, s1 + share * n1 AS s1, sq AS size FROM {prefix}b{k})")
    out.append(f"{prefix}c AS (SELECT {keys}, (s0 + s1) / 2 AS mean FROM {prefix}4)")
    return ", ".join(out)


BD = f"""
{TOTALS}, {CURVE}, sp AS (SELECT sb_row, sb_col, grp, count(*) AS n, min(psnr) AS lo, max(psnr) AS hi, max(rate) AS rate, max(samples) AS samples FROM cv GROUP BY sb_row, sb_col, grp),
pr AS (SELECT t.sb_row, t.sb_col, t.grp AS test, coalesce(a.n, 0) AS n_a, coalesce(b.n, 0) AS n_b, greatest(a.lo, b.lo) AS plo, least(a.hi, b.hi) AS phi, least(3, coalesce(a.n, 0) - 1, coalesce(b.n, 0) - 1) AS degree,
  a.rate AS bits_a_max, a.hi AS psnr_a_max, a.samples, b.rate AS bits_b_max, b.hi AS psnr_b_max
  FROM (SELECT DISTINCT sb_row, sb_col, grp FROM tot WHERE grp <> 'A') t LEFT JOIN sp a ON a.sb_row = t.sb_row AND a.sb_col = t.sb_col AND a.grp = 'A' LEFT JOIN sp b ON b.sb_row = t.sb_row AND b.sb_col = t.sb_col AND b.grp = t.grp),
pe AS (SELECT *, CASE WHEN n_a = 0 OR n_b = 0 THEN NULL ELSE plo END AS psnr_lo, CASE WHEN n_a = 0 OR n_b = 0 THEN NULL ELSE phi END AS psnr_hi, CASE WHEN n_a = 0 OR n_b = 0 THEN 'Degenerate' WHEN degree < 1 THEN 'NotEnoughPoints' WHEN phi <= plo THEN 'NoPsnrOverlap' END AS early FROM pr),
pa AS (SELECT sb_row, sb_col, test, degree, list(u ORDER BY u) AS us, list(yy ORDER BY u) AS ys FROM (SELECT p.*, (c.psnr - (plo + phi) / 2) / ((phi - plo) / 2) AS u, log10(c.rate) AS yy FROM pe p JOIN cv c ON c.sb_row = p.sb_row AND c.sb_col = p.sb_col AND c.grp = 'A' WHERE early IS NULL) GROUP BY sb_row, sb_col, test, degree),
pb AS (SELECT sb_row, sb_col, test, degree, list(u ORDER BY u) AS us, list(yy ORDER BY u) AS ys FROM (SELECT p.*, (c.psnr - (plo + phi) / 2) / ((phi - plo) / 2) AS u, log10(c.rate) AS yy FROM pe p JOIN cv c ON c.sb_row = p.sb_row AND c.sb_col = p.sb_col AND c.grp = p.test WHERE early IS NULL) GROUP BY sb_row, sb_col, test, degree),
{_fit('qa', 'pa', 'sb_row, sb_col, test')}, {_fit('qb', 'pb', 'sb_row, sb_col, test')},
bd AS (SELECT p.*, (power(10.0, b.mean - a.mean) - 1) * 100 AS pct FROM pe p LEFT JOIN qac a USING (sb_row, sb_col, test) LEFT JOIN qbc b USING (sb_row, sb_col, test))"""
_PERCENT = "CASE WHEN isinf(pct) THEN NULL WHEN abs(pct) < 100000 THEN round(pct, 2) ELSE CAST(format('{:.6e}', pct) AS DOUBLE) END"
_COLS = f"sb_row, sb_col, test, coalesce(early, CASE WHEN pct IS NULL OR isinf(pct) THEN 'Degenerate' ELSE 'Ok' END) AS status, {_PERCENT} AS percent, CAST(greatest(degree, 0) AS BIGINT) AS degree, round(psnr_lo, 4) AS psnr_lo, round(psnr_hi, 4) AS psnr_hi, n_a, n_b"


@query("rd9_bd_rate", "f_rd", oracle=f"WITH {BD} SELECT {_COLS} FROM bd")
def rd9(t):
    keys = ("sb_row", "sb_col")
    totals = rd.sequence_totals(t, by=keys)
    out = rd.bd_rate(rd.curve(totals, (*keys, "grp")), "A", keys, totals)
    return _rounded(shown_percent(out), psnr_lo=4, psnr_hi=4)


@query("rd10_bd_rate_report", "f_rd", oracle=f"WITH {BD} SELECT {_COLS}, round(bits_a_max, 2) AS bits_a_max, round(psnr_a_max, 4) AS psnr_a_max, samples, round(bits_b_max, 2) AS bits_b_max, round(psnr_b_max, 4) AS psnr_b_max FROM bd")
def rd10(t):
    return _rounded(shown_percent(rd.bd_rate_report(t, "A")), psnr_lo=4, psnr_hi=4, bits_a_max=2, psnr_a_max=4, bits_b_max=2, psnr_b_max=4)


@query("rd11_undefined_count", "f_rd", oracle=f"WITH {BD} SELECT status, count(*) AS regions FROM (SELECT {_COLS} FROM bd) GROUP BY status")
def rd11(t):
    return rd.undefined_count(rd.bd_rate_report(t, "A"))


_DIM = "SELECT c_nationkey AS g, CASE WHEN c_nationkey = 3 THEN NULL ELSE c_custkey % 4 END AS point, CASE WHEN c_nationkey % 7 = 2 AND c_custkey % 2 = 0 THEN 1280 WHEN c_nationkey % 5 = 4 THEN 640 ELSE 1920 END AS width, c_nationkey = 0 OR c_nationkey = 9 AS original, c_custkey % 50 <> 7 AS known FROM customer"


@query("rd12_validate_groups", "customer", oracle=f"""
WITH d AS ({_DIM}), e AS (SELECT g, count(point) AS points, count(DISTINCT width) AS shapes, min(width) AS shape, max(CAST(original AS INTEGER)) AS original, sum(CASE WHEN known THEN 0 ELSE 1 END) AS missing FROM d GROUP BY g), f AS (SELECT e.*, (SELECT shape FROM e ORDER BY g LIMIT 1) AS first_shape FROM e)
SELECT CAST(g AS VARCHAR) AS grp, 'no streams' AS rule FROM f WHERE points = 0 UNION ALL SELECT CAST(g AS VARCHAR), 'one point' FROM f WHERE points = 1 UNION ALL SELECT CAST(g AS VARCHAR), 'mixed geometry' FROM f WHERE shapes > 1
UNION ALL SELECT CAST(g AS VARCHAR), 'other geometry than the first group' FROM f WHERE shapes = 1 AND shape <> first_shape UNION ALL SELECT CAST(g AS VARCHAR), 'missing bits' FROM f WHERE missing > 0
UNION ALL SELECT '*', 'not exactly one original' FROM (SELECT sum(original) AS n FROM f) WHERE n <> 1""")
def rd12(c):
    return _groups(c)


def _groups(c):
    n, k = F.col("c_nationkey"), F.col("c_custkey")
    dim = c.select(
        n.alias("grp"), F.when(n != 3, k % 4).alias("point"), F.when((n % 7 == 2) & (k % 2 == 0), 1280).when(n % 5 == 4, 640).otherwise(1920).alias("width"), F.lit(1080).alias("height"), F.lit(64).alias("sb_size"), ((n == 0) | (n == 9)).alias("original"), (k % 50 != 7).alias("bits_known")
    )
    return rd.validate_groups(dim)


@query("rd13_group_name", "customer", oracle="""
WITH g AS (SELECT c_nationkey AS k, count(*) AS n, min(c_name) AS a, max(c_name) AS b FROM customer GROUP BY c_nationkey),
p AS (SELECT *, row_number() OVER (ORDER BY k) AS rn, regexp_replace(substr(a, 1, coalesce((SELECT max(i) FROM range(1, 60) r(i) WHERE substr(a, 1, i) = substr(b, 1, i) AND i <= length(a) AND i <= length(b)), 0)), '[_.qQ-]+$', '') AS pre FROM g)
SELECT k, CASE WHEN n = 1 THEN regexp_replace(regexp_extract(a, '([^/]*)$', 1), '\\.[^.]*$', '') WHEN length(pre) >= 2 THEN pre ELSE concat('Group ', CAST(rn AS VARCHAR)) END AS group_name FROM p""")
def rd13(c):
    return rd.group_name(c.select(F.col("c_nationkey").alias("k"), "c_name"), "k", "c_name")


@query("rd14_unique_names", "customer", oracle="""
WITH b AS (SELECT c_custkey AS id, c_mktsegment AS name, concat('dir', CAST(c_nationkey AS VARCHAR)) AS dir FROM customer), f AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY id) AS k FROM b), w AS (SELECT *, CASE WHEN k = 1 THEN name ELSE dir END AS wanted FROM f),
z AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY wanted ORDER BY CASE WHEN k > 1 THEN 1 ELSE 0 END, id) > 1 THEN 1 ELSE 0 END AS lost FROM w)
SELECT id, name, dir, CASE WHEN lost = 0 THEN wanted ELSE concat(name, ' (', CAST(CAST(sum(lost) OVER (PARTITION BY name ORDER BY id ROWS UNBOUNDED PRECEDING) + 1 AS BIGINT) AS VARCHAR), ')') END AS unique_name FROM z""")
def rd14(c):
    return rd.unique_names(c.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("name"), F.concat(F.lit("dir"), F.col("c_nationkey").cast("string")).alias("dir")), "name", "dir", "id")


@query("jn1_join_bits_sse", "f_rd", oracle="SELECT a.frame, a.sb_row, a.sb_col, a.grp, a.point, a.bits, b.sse FROM (SELECT frame, sb_row, sb_col, grp, point, sum(bits) AS bits FROM f_rd GROUP BY 1, 2, 3, 4, 5) a JOIN (SELECT frame, sb_row, sb_col, grp, point, round(sum(sse) + 0.000000033::DOUBLE, 6) AS sse FROM f_rd WHERE frame % 2 = 0 GROUP BY 1, 2, 3, 4, 5) b USING (frame, sb_row, sb_col, grp, point)")
def jn1(t):
    keys = ("frame", "sb_row", "sb_col", "grp", "point")
    return rd.join_bits_sse(t.groupBy(*keys).agg(F.sum("bits").alias("bits")), t.where("frame % 2 = 0").groupBy(*keys).agg(F.round(F.sum("sse") + 0.000000033, 6).alias("sse")), keys)


@query("jn2_anchor_pairs", "f_rd", oracle=f"WITH {TOTALS}, {CURVE} SELECT t.sb_row, t.sb_col, t.grp AS test, count(*) AS pairs, round(max(t.psnr - a.psnr), 3) AS most FROM cv t JOIN cv a ON a.sb_row = t.sb_row AND a.sb_col = t.sb_col AND a.grp = 'A' AND t.grp <> 'A' GROUP BY 1, 2, 3")
def jn2(t):
    c = rd.curve(rd.sequence_totals(t, by=("sb_row", "sb_col")), ("sb_row", "sb_col", "grp"))
    return rd.anchor_pairs(c, "A", ("sb_row", "sb_col")).groupBy("sb_row", "sb_col", "test").agg(F.count("*").alias("pairs"), F.round(F.max(F.col("test_point.psnr") - F.col("anchor_point.psnr")), 3).alias("most"))


@query("df21_dump_completeness", "f_rd", oracle="SELECT * FROM (SELECT sb_row, sb_col, frame, grp, point FROM (SELECT DISTINCT sb_row, sb_col FROM f_rd), (SELECT DISTINCT frame FROM f_rd), (SELECT DISTINCT grp, point FROM f_rd)) EXCEPT SELECT sb_row, sb_col, frame, grp, point FROM f_rd")
def df21(t):
    return rd.dump_completeness(t)
