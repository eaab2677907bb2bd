"""Queries of the grid family (GR, GM3, JN13, DF17)."""

from pyspark.sql import functions as F

from ..operators import grid as gr
from ..registry import query

_B = "SELECT frame, y, x, (v * 3 + x) % 256 AS v FROM f_gr"
_E = "e AS (SELECT frame, max(x) AS mx, max(y) AS my FROM f_gr GROUP BY frame)"


def _near(r, extra="1 = 1"):
    """SQL twin of the scatter: gather with clamped coordinates."""
    return f"{_E}, w AS (SELECT g.frame, g.y, g.x, g.v AS c, CAST(dy AS BIGINT) AS dy, CAST(dx AS BIGINT) AS dx, n.v AS w FROM f_gr g JOIN e ON e.frame = g.frame, range({-r}, {r + 1}) a(dy), range({-r}, {r + 1}) b(dx) JOIN f_gr n ON n.frame = g.frame AND n.y = least(greatest(g.y + dy, 0), my) AND n.x = least(greatest(g.x + dx, 0), mx) WHERE {extra})"


_INT = "CAST(least(255, greatest(0, floor({} + 0.5))) AS BIGINT)"


def _kernel(k):
    r = len(k) // 2
    return "CASE " + " ".join(f"WHEN dy = {i - r} AND dx = {j - r} THEN {float(v)}" for i, row in enumerate(k) for j, v in enumerate(row)) + " END::DOUBLE"


def _other(t):
    return t.withColumn("v", (F.col("v") * 3 + F.col("x")) % 256)


@query("gr1_block_stats", "f_gr", oracle=f"WITH o AS ({_B}) SELECT g.frame, CAST(floor(g.y / 16) AS BIGINT) AS block_y, CAST(floor(g.x / 16) AS BIGINT) AS block_x, round(avg(g.v), 5) AS mean, round(var_pop(g.v), 4) AS variance, min(g.v) AS low, max(g.v) AS high, count(*) AS n, CAST(sum((g.v - o.v) * (g.v - o.v)) AS BIGINT) AS sse FROM f_gr g JOIN o ON o.frame = g.frame AND o.y = g.y AND o.x = g.x GROUP BY 1, 2, 3")
def gr1(t):
    return gr.block_stats(t, 16, _other(t)).withColumns({"mean": F.round("mean", 5), "variance": F.round("variance", 4)})


@query("gr2_histogram", "f_gr", oracle="SELECT f.frame, r.v, count(g.v) AS n FROM (SELECT DISTINCT frame FROM f_gr) f, (SELECT unnest(range(0, 256)) AS v) r LEFT JOIN f_gr g ON g.frame = f.frame AND g.v = r.v GROUP BY f.frame, r.v")
def gr2(t):
    return gr.histogram(t)


_PD = f"WITH o AS ({_B}), p AS (SELECT g.frame, CAST(sum((g.v - o.v) * (g.v - o.v)) AS BIGINT) AS sse, count(*) AS n, CAST(sum(CASE WHEN g.v <> o.v THEN 1 ELSE 0 END) AS BIGINT) AS differing, min(CASE WHEN g.v <> o.v THEN g.y * 1000 + g.x END) AS f FROM f_gr g JOIN o ON o.frame = g.frame AND o.y = g.y AND o.x = g.x GROUP BY g.frame)"
_PC = "frame, sse, n, differing, CAST(floor(f / 1000) AS BIGINT) AS first_y, f % 1000 AS first_x, round(10 * log10(65025.0 * n / sse), 4) AS psnr"


@query("gr3_plane_diff", "f_gr", oracle=f"{_PD} SELECT {_PC} FROM p")
def gr3(t):
    return gr.plane_diff(t, _other(t)).withColumn("psnr", F.round("psnr", 4))


@query("df17_diff_recon", "f_gr", oracle=f"{_PD} SELECT {_PC}, (SELECT min(frame) FROM p WHERE differing > 0) AS first_frame, (SELECT count(*) FROM p WHERE differing > 0) AS frames_differing FROM p")
def df17(t):
    return gr.diff_recon(t, _other(t)).withColumn("psnr", F.round("psnr", 4))


@query("gr4_luma_diff", "f_gr", oracle=f"WITH o AS ({_B}), {_E} SELECT g.frame, CAST(sum(abs(g.v - o.v)) AS BIGINT) AS sad, max(abs(g.v - o.v)) AS largest FROM f_gr g JOIN e ON e.frame = g.frame JOIN o ON o.frame = g.frame AND o.x = least(greatest(g.x + 9, 0), mx) AND o.y = least(greatest(g.y - 4, 0), my) WHERE g.x BETWEEN 40 AND 63 AND g.y BETWEEN 2 AND 21 GROUP BY g.frame")
def gr4(t):
    return gr.luma_diff(t, _other(t), (40, 2, 24, 20), 9, -4)


@query("jn13_shifted_join", "f_gr", oracle=f"WITH o AS ({_B}), {_E} SELECT g.frame, g.y, g.x, g.v, o.v AS w FROM f_gr g JOIN e ON e.frame = g.frame JOIN o ON o.frame = g.frame AND o.x = least(greatest(g.x - 3, 0), mx) AND o.y = least(greatest(g.y + 2, 0), my)")
def jn13(t):
    return gr.shifted_join(t, _other(t), -3, 2)


_PRE = "p AS (SELECT *, CAST(coalesce(sum(v) OVER (PARTITION BY frame, y ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS row_sum, CAST(coalesce(sum(v) OVER (PARTITION BY frame, x ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS col_sum FROM f_gr)"


@query("gr6_prefix_sums", "f_gr", oracle=f"WITH {_PRE} SELECT * FROM p")
def gr6(t):
    return gr.prefix_sums(t)


@query("gm3_project_profiles", "f_gr", oracle="SELECT frame, CAST(k AS INTEGER) AS \"window\", y, CAST(sum(v) AS BIGINT) AS total FROM f_gr, range(0, 4) w(k) WHERE x BETWEEN k * 16 AND k * 16 + 15 AND y BETWEEN 3 AND 18 GROUP BY 1, 2, 3")
def gm3(t):
    w = t.select("frame").distinct().select("frame", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("window")).withColumns({"x0": (F.col("window") * 16).cast("long"), "x1": (F.col("window") * 16 + 15).cast("long"), "y0": F.lit(3), "y1": F.lit(18)})
    return gr.project_profiles(t, w)


_K = [[1, 2, 1], [0, 3, 0], [-1, 2, -1]]


@query("gr7_stencil", "f_gr", oracle=f"WITH {_near(1)} SELECT frame, y, x, {_INT.format(f'sum(w * {_kernel(_K)}) / {float(sum(map(sum, _K)))}')} AS v FROM w GROUP BY frame, y, x")
def gr7(t):
    return gr.stencil(t, _K)


@query("gr8_box", "f_gr", oracle=f"WITH {_near(2)} SELECT frame, y, x, {_INT.format('round(avg(w), 6)')} AS v FROM w GROUP BY frame, y, x")
def gr8(t):
    return gr.box(t, 5)


_G = gr.gaussian_kernel(5, 1.1)


@query("gr8_gauss", "f_gr", oracle=f"WITH {_near(2)} SELECT frame, y, x, {_INT.format(f'round(sum(w * {_kernel([[a * b for b in _G] for a in _G])}), 6)')} AS v FROM w GROUP BY frame, y, x")
def gr8_gauss(t):
    return gr.gauss(t, 5, 1.1)


@query("gr9_median", "f_gr", oracle=f"WITH {_near(1)} SELECT frame, y, x, list(w ORDER BY w)[5] AS v FROM w GROUP BY frame, y, x")
def gr9(t):
    return gr.median_filter(t, 3)


def _grad(kind, gain):
    k = gr.GRADIENTS[kind]
    size = f"sqrt(power(sum(w * {_kernel(k[0])}), 2) + power(sum(w * {_kernel(k[1])}), 2))" if len(k) == 2 else f"abs(sum(w * {_kernel(k[0])}))"
    return f"SELECT '{kind}' AS kind, frame, y, x, {_INT.format(f'round({size} * {gain}::DOUBLE, 6)')} AS v FROM w GROUP BY frame, y, x"


@query("gr10_gradient", "f_gr", oracle=f"WITH {_near(1)} {_grad('sobel', 0.25)} UNION ALL {_grad('scharr', 0.125)} UNION ALL {_grad('laplacian', 0.5)}")
def gr10(t):
    one = lambda kind, gain: gr.gradient(t, kind, gain).select(F.lit(kind).alias("kind"), *gr.AT, "v")
    return one("sobel", 0.25).unionByName(one("scharr", 0.125)).unionByName(one("laplacian", 0.5))


_U = gr.gaussian_kernel(7, 1.0)


@query("gr11_unsharp", "f_gr", oracle=f"WITH {_near(3)} SELECT frame, y, x, {_INT.format(f'round(c + 0.7::DOUBLE * (c - sum(w * {_kernel([[a * b for b in _U] for a in _U])})), 6)')} AS v FROM w GROUP BY frame, y, x, c")
def gr11(t):
    return gr.unsharp(t, 1.0, 0.7)


@query("gr12_morphology", "f_gr", oracle=f"WITH {_near(1)} SELECT frame, y, x, min(w) AS erode, max(w) AS dilate, max(w) - min(w) AS gradient, max(CASE WHEN dy = 0 OR dx = 0 THEN w END) AS dilate_cross FROM w GROUP BY frame, y, x")
def gr12(t):
    m = lambda name, op, shape="rect": gr.morphology(t, op, shape).withColumnRenamed("v", name)
    return m("erode", "erode").join(m("dilate", "dilate"), gr.AT).join(m("gradient", "gradient"), gr.AT).join(m("dilate_cross", "dilate", "cross"), gr.AT)


@query("gr12_tophat", "f_gr", oracle=f"WITH {_near(1)}, er AS (SELECT frame, y, x, min(w) AS v FROM w GROUP BY 1, 2, 3), op AS (SELECT g.frame, g.y, g.x, max(n.v) AS v FROM f_gr g JOIN e ON e.frame = g.frame, range(-1, 2) a(dy), range(-1, 2) b(dx) JOIN er n ON n.frame = g.frame AND n.y = least(greatest(g.y + dy, 0), my) AND n.x = least(greatest(g.x + dx, 0), mx) GROUP BY 1, 2, 3) SELECT g.frame, g.y, g.x, g.v - op.v AS v FROM f_gr g JOIN op USING (frame, y, x)")
def gr12_tophat(t):
    return gr.morphology(t, "tophat")


_OTSU = "h AS (SELECT frame, v, count(*) AS n FROM f_gr GROUP BY frame, v), c AS (SELECT *, sum(n) OVER (PARTITION BY frame ORDER BY v ROWS UNBOUNDED PRECEDING)::DOUBLE AS n0, sum(n * v) OVER (PARTITION BY frame ORDER BY v ROWS UNBOUNDED PRECEDING)::DOUBLE AS s0, sum(n) OVER (PARTITION BY frame)::DOUBLE AS nn, sum(n * v) OVER (PARTITION BY frame)::DOUBLE AS ss FROM h), b AS (SELECT frame, v, CASE WHEN nn > n0 THEN round(n0 * (nn - n0) * power(s0 / n0 - (ss - s0) / (nn - n0), 2), 3) END AS b FROM c), l AS (SELECT frame, v AS level FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY b DESC NULLS LAST, v) AS rn FROM b) WHERE rn = 1)"


@query("gr13_threshold_otsu", "f_gr", oracle=f"WITH {_OTSU} SELECT g.frame, y, x, CAST(CASE WHEN v > level THEN 255 ELSE 0 END AS BIGINT) AS v FROM f_gr g JOIN l ON l.frame = g.frame")
def gr13(t):
    return gr.threshold(t)


@query("gr13_threshold", "f_gr", oracle="SELECT frame, y, x, CAST(CASE WHEN v > 140 THEN 0 ELSE 255 END AS BIGINT) AS v FROM f_gr")
def gr13_fixed(t):
    return gr.threshold(t, 140, inverted=True)


@query("gr14_adaptive_threshold", "f_gr", oracle=f"WITH {_near(2)} SELECT frame, y, x, CAST(CASE WHEN c > round(avg(w), 6) - 3 THEN 255 ELSE 0 END AS BIGINT) AS v FROM w GROUP BY frame, y, x, c")
def gr14(t):
    return gr.adaptive_threshold(t, 5, 3.0)


@query("gr15_equalize", "f_gr", oracle="WITH h AS (SELECT frame, v, count(*) AS n FROM f_gr GROUP BY frame, v), c AS (SELECT *, sum(n) OVER (PARTITION BY frame ORDER BY v ROWS UNBOUNDED PRECEDING) AS cum, first_value(n) OVER (PARTITION BY frame ORDER BY v) AS c0, sum(n) OVER (PARTITION BY frame) AS nn FROM h) SELECT g.frame, y, x, CAST(floor((cum - c0) * 255.0::DOUBLE / (nn - c0) + 0.5) AS BIGINT) AS v FROM f_gr g JOIN c ON c.frame = g.frame AND c.v = g.v")
def gr15(t):
    return gr.equalize(t)


@query("gr16_bilateral", "f_gr", oracle=f"WITH {_near(1, 'dy * dy + dx * dx <= 1')} SELECT frame, y, x, {_INT.format('round(sum(w * exp(-(dy * dy + dx * dx) / 8.0::DOUBLE - (w - c) * (w - c) / 800.0::DOUBLE)) / sum(exp(-(dy * dy + dx * dx) / 8.0::DOUBLE - (w - c) * (w - c) / 800.0::DOUBLE)), 6)')} AS v FROM w GROUP BY frame, y, x")
def gr16(t):
    return gr.bilateral(t, 3, 20.0, 2.0)


@query("gr17_downscale", "f_gr", oracle=f"WITH {_E}, a AS (SELECT f_gr.frame, CAST(floor(y / 2) AS BIGINT) AS y, CAST(floor(x / 2) AS BIGINT) AS x, floor((sum(v) + 2) / 4) AS v FROM f_gr JOIN e ON e.frame = f_gr.frame WHERE floor(x / 2) * 2 < mx AND floor(y / 2) * 2 < my GROUP BY 1, 2, 3), e2 AS (SELECT frame, max(x) AS mx, max(y) AS my FROM a GROUP BY frame) SELECT a.frame, CAST(floor(y / 2) AS BIGINT) AS y, CAST(floor(x / 2) AS BIGINT) AS x, CAST(floor((sum(v) + 2) / 4) AS BIGINT) AS v FROM a JOIN e2 ON e2.frame = a.frame WHERE floor(x / 2) * 2 < mx AND floor(y / 2) * 2 < my GROUP BY 1, 2, 3")
def gr17(t):
    return gr.downscale(t, 2)


@query("gr17_subsample", "f_gr", oracle="SELECT frame, CAST(floor(y / 4) AS BIGINT) AS y, CAST(floor(x / 4) AS BIGINT) AS x, v FROM f_gr WHERE x % 4 = 2 AND y % 4 = 2")
def gr17_sub(t):
    return gr.subsample(t, 4)


@query("gr18_pad_edges", "f_gr", oracle=f"WITH {_E} SELECT e.frame, py AS y, px AS x, g.v FROM e, LATERAL (SELECT unnest(range(-3, my + 4)) AS py) a, LATERAL (SELECT unnest(range(-3, mx + 4)) AS px) b JOIN f_gr g ON g.frame = e.frame AND g.y = least(greatest(py, 0), my) AND g.x = least(greatest(px, 0), mx)")
def gr18(t):
    return gr.pad_edges(t, 3)


@query("gr19_warp", "f_gr", oracle=f"""WITH {_E}, s AS (SELECT g.frame, g.y, g.x, mx, my, 1.3::DOUBLE + 0.98::DOUBLE * (g.x + 0.5::DOUBLE) + 0.05::DOUBLE * (g.y + 0.5::DOUBLE) - 0.5::DOUBLE AS sx, -0.7::DOUBLE + -0.05::DOUBLE * (g.x + 0.5::DOUBLE) + 0.98::DOUBLE * (g.y + 0.5::DOUBLE) - 0.5::DOUBLE AS sy FROM f_gr g JOIN e ON e.frame = g.frame),
c AS (SELECT s.*, CAST(floor(sx) AS BIGINT) + a AS tx, CAST(floor(sy) AS BIGINT) + b AS ty, (CASE WHEN a = 1 THEN sx - floor(sx) ELSE 1 - (sx - floor(sx)) END) * (CASE WHEN b = 1 THEN sy - floor(sy) ELSE 1 - (sy - floor(sy)) END) AS wt FROM s, range(0, 2) p(a), range(0, 2) q(b))
SELECT c.frame, c.y, c.x, {_INT.format('round(sum(n.v * wt), 6)')} AS v FROM c JOIN f_gr n ON n.frame = c.frame AND n.x = least(greatest(tx, 0), mx) AND n.y = least(greatest(ty, 0), my) GROUP BY 1, 2, 3""")
def gr19(t):
    return gr.warp(t, [1.3, -0.7, 0.98, 0.05, -0.05, 0.98])


@query("gr20_flip", "f_gr", oracle=f"WITH {_E} SELECT f_gr.frame, my - y AS y, mx - x AS x, v FROM f_gr JOIN e ON e.frame = f_gr.frame")
def gr20(t):
    return gr.flip(t, True, True)


@query("gr21_blend", "f_gr", oracle="SELECT frame, y, x, CASE WHEN x < 20 THEN CAST(floor(((x * 12) * (255 - v) + (255 - x * 12) * v + 127) / 255) AS BIGINT) ELSE v END AS v FROM f_gr")
def gr21(t):
    top = t.where("x < 20").select(*gr.AT, (255 - F.col("v")).alias("v"), (F.col("x") * 12).alias("alpha"))
    return gr.blend(top, t)


@query("gr22_chain", "f_gr")
def gr22(t):
    return gr.chain(t, [("box", (3.0,), True), ("median", (3.0,), False), ("gauss", (5.0,), True), ("equalize", (), True)])


@query("gr23_fitted_range", "f_bl_a", oracle="SELECT frame, w AS type, min(bit_end - bit_start) AS low, max(bit_end - bit_start) AS high FROM f_bl_a GROUP BY frame, w")
def gr23(t):
    return gr.fitted_range(t.select("frame", F.col("w").alias("type"), (F.col("bit_end") - F.col("bit_start")).alias("n")), ["frame", "type"], "n")
