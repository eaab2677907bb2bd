"""Queries of the motion family (MV, GM, TK3, TK4, JN14)."""

from pyspark.sql import functions as F

from ..operators import motion as mv
from ..registry import query

_FIT = "pts AS (SELECT frame, algorithm, x AS block_x, y AS block_y, x + 8.0::DOUBLE AS px, y + 8.0::DOUBLE AS py, x + 8 + mv_x_q8 / 8.0::DOUBLE AS qx, y + 8 + mv_y_q8 / 8.0::DOUBLE AS qy FROM f_mv WHERE size = 16 AND x + 16 <= 128 AND y + 16 <= 128)"
_MOM = "mo AS (SELECT frame, algorithm, count(*) AS n, avg(px) AS mpx, avg(py) AS mpy, avg(qx) AS mqx, avg(qy) AS mqy, var_pop(px) AS sxx, var_pop(py) AS syy, covar_pop(px, py) AS sxy, covar_pop(px, qx) AS sxu, covar_pop(px, qy) AS sxv, covar_pop(py, qx) AS syu, covar_pop(py, qy) AS syv FROM pts GROUP BY frame, algorithm)"
_RZ = f"{_FIT}, {_MOM}, ab AS (SELECT *, (sxu + syv) / CASE WHEN sxx + syy > 1e-12 THEN sxx + syy END AS a, (sxv - syu) / CASE WHEN sxx + syy > 1e-12 THEN sxx + syy END AS b FROM mo), rz AS (SELECT frame, algorithm, n, mqx - a * mpx + b * mpy AS p0, mqy - b * mpx - a * mpy AS p1, a AS p2, -b AS p3, b AS p4, a AS p5 FROM ab)"
_P = ("p0", "p1", "p2", "p3", "p4", "p5")
_RP = ", ".join(f"round({p}, 5) AS {p}" for p in _P)


def _points(t):
    return mv.fit_points(t, 16, 128, 128)


def _round(df, cols=_P, digits=5):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query("mv5_compare_algorithms", "f_mv", oracle="SELECT frame, size, x, y, " + ", ".join(f"max(CASE WHEN algorithm = '{a}' THEN {c} END) AS {a.lower()}_{c}" for a in "ANR" for c in ("mv_x_q8", "mv_y_q8", "native_cost", "common_sad")) + " FROM f_mv GROUP BY frame, size, x, y")
def mv5(t):
    p = mv.compare_algorithms(t, ["A", "N", "R"])
    return p.select("frame", F.col("size").cast("int").alias("size"), "x", "y", *[F.col(f"{a}_{c}").alias(f"{a.lower()}_{c}") for a in "ANR" for c in ("mv_x_q8", "mv_y_q8", "native_cost", "common_sad")])


@query("mv6_size_filter", "f_mv", oracle="SELECT algorithm, count(*) AS n FROM f_mv WHERE (2 & CAST(size / 8 AS INTEGER)) <> 0 GROUP BY algorithm")
def mv6(t):
    return mv.size_filter(t, 2).groupBy("algorithm").agg(F.count("*").alias("n"))


@query("mv7_fit_points", "f_mv", oracle=f"WITH {_FIT} SELECT * FROM pts")
def mv7(t):
    return _points(t)


@query("mv8_fit_translation", "f_mv", oracle=f"WITH {_FIT} SELECT frame, algorithm, count(*) AS n, round(avg(qx - px), 5) AS p0, round(avg(qy - py), 5) AS p1 FROM pts GROUP BY frame, algorithm")
def mv8(t):
    return _round(mv.fit_translation(_points(t)), ("p0", "p1"))


@query("mv9_fit_rotzoom", "f_mv", oracle=f"WITH {_RZ} SELECT frame, algorithm, n, {_RP} FROM rz")
def mv9(t):
    return _round(mv.fit_rotzoom(_points(t)))


@query("mv9_fit_affine", "f_mv", oracle=f"WITH {_FIT}, {_MOM}, d AS (SELECT *, CASE WHEN abs(sxx * syy - sxy * sxy) > 1e-9 THEN sxx * syy - sxy * sxy END AS det FROM mo), q AS (SELECT *, (sxu * syy - syu * sxy) / det AS p2, (syu * sxx - sxu * sxy) / det AS p3, (sxv * syy - syv * sxy) / det AS p4, (syv * sxx - sxv * sxy) / det AS p5 FROM d), r AS (SELECT *, mqx - p2 * mpx - p3 * mpy AS p0, mqy - p4 * mpx - p5 * mpy AS p1 FROM q) SELECT frame, algorithm, n, {_RP} FROM r")
def mv9_affine(t):
    return _round(mv.fit_affine(_points(t)))


@query("mv10_fit_robust", "f_mv")
def mv10(t):
    return mv.fit_robust(_points(t))


_ERR = "e AS (SELECT pts.*, sqrt(power(p0 + p2 * px + p3 * py - qx, 2) + power(p1 + p4 * px + p5 * py - qy, 2)) AS error FROM pts JOIN rz USING (frame, algorithm))"


@query("mv11_inliers", "f_mv", oracle=f"WITH {_RZ}, {_ERR} SELECT frame, algorithm, count(*) AS total, CAST(sum(CASE WHEN error < 1.25 THEN 1 ELSE 0 END) AS BIGINT) AS inliers, round(sqrt(avg(CASE WHEN error < 1.25 THEN error * error END)), 5) AS rms FROM e GROUP BY frame, algorithm")
def mv11(t):
    p = _points(t)
    return _round(mv.inlier_summary(p, mv.fit_rotzoom(p)), ("rms",))


@query("mv12_model_field", "f_mv", oracle=f"WITH {_RZ} SELECT frame, algorithm, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST(sign(u) * floor(abs(u) + 0.5) AS BIGINT) AS mv_x_q8, CAST(sign(v) * floor(abs(v) + 0.5) AS BIGINT) AS mv_y_q8 FROM (SELECT frame, algorithm, x, y, round((round(p0, 5) + round(p2, 5) * (x + 16) + round(p3, 5) * (y + 16) - x - 16) * 8, 4) AS u, round((round(p1, 5) + round(p4, 5) * (x + 16) + round(p5, 5) * (y + 16) - y - 16) * 8, 4) AS v FROM rz, (SELECT unnest(range(0, 128, 32)) AS y) a, (SELECT unnest(range(0, 128, 32)) AS x) b)".replace("round((round", "((round").replace(", 4) AS u", ") AS u").replace(", 4) AS v", ") AS v"))
def mv12(t):
    return mv.model_field(_round(mv.fit_rotzoom(_points(t))), 120, 100, 32)


def _gates(g1_num="16", g1_den="15", g2="2", source="f_gm"):
    axis = ", ".join(f"d{a}_coarse <> 0 AND cost_best_{a} * {g1_num} < cost_zero_{a} * {g1_den} AS gate_{a}, sad2d_best * {g2} < sad2d_no_{a} AS gate_pair_{a}" for a in "xy")
    return f"g AS (SELECT *, {axis}, sad2d_best * {g2} < sad2d_zero AS gate_pair FROM {source}), a AS (SELECT *, gate_x AND gate_pair AND gate_pair_x AS accept_x, gate_y AND gate_pair AND gate_pair_y AS accept_y FROM g)"


_GATE = _gates()
_AXES = "CAST(sum(CAST(accept_x AS INTEGER) + CAST(accept_y AS INTEGER)) AS BIGINT) AS accepted, 2 * count(*) AS axes"
_GATES = ("gate_x", "gate_y", "gate_pair", "gate_pair_x", "gate_pair_y", "accept_x", "accept_y")


@query("gm6_gates", "f_gm", oracle=f"WITH {_GATE} SELECT poc, win_i, win_j, {', '.join(_GATES)} FROM a")
def gm6(t):
    return mv.gates(t).select("poc", "win_i", "win_j", *_GATES)


@query("gm6_gate_sweep", "f_gm", oracle=f"WITH w AS (SELECT * FROM f_gm, (VALUES (16, 15, 2), (8, 7, 2), (16, 15, 3)) s(g1_num, g1_den, g2)), {_gates('g1_num', 'g1_den', 'g2', 'w')} SELECT g1_num, g1_den, g2, {_AXES} FROM a GROUP BY g1_num, g1_den, g2")
def gm6_sweep(t):
    return mv.gate_sweep(t, t.sparkSession.createDataFrame([(16, 15, 2), (8, 7, 2), (16, 15, 3)], "g1_num int, g1_den int, g2 int"))


@query("gm7_accepted_vectors", "f_gm", oracle=f"WITH {_GATE}, c AS (SELECT *, CAST(accept_x AS INTEGER) + CAST(accept_y AS INTEGER) AS accepted FROM a) SELECT poc, win_i, win_j, CASE WHEN accept_x THEN dx_qpel ELSE 0 END AS dx_qpel, CASE WHEN accept_y THEN dy_qpel ELSE 0 END AS dy_qpel, accepted, 'used' AS kind FROM c WHERE accepted > 0 UNION ALL SELECT poc, win_i, win_j, dx_qpel, dy_qpel, accepted, 'raw' FROM c WHERE accepted < 2")
def gm7(t):
    return mv.accepted_vectors(mv.gates(t))


@query("gm8_window_rect", "f_gm", oracle="SELECT p AS poc, CAST(i AS BIGINT) AS i, CAST(j AS INTEGER) AS j, CAST(j * 480 AS INTEGER) AS x, CAST(i * 264 AS BIGINT) AS y, CAST(CASE WHEN j = 3 THEN 1922 - j * 480 ELSE 480 END AS INTEGER) AS w, CAST(CASE WHEN i = 3 THEN 1082 - i * 264 ELSE 264 END AS BIGINT) AS h FROM (SELECT DISTINCT poc AS p FROM f_gm), range(0, 4) a(i), range(0, 4) b(j)")
def gm8(t):
    return mv.window_rect(t.select("poc").distinct(), 1922, 1082, 3)


@query("gm1_frame_summary", "f_gm", oracle=f"WITH {_GATE}, s AS (SELECT poc, CAST(sum(CAST(accept_x AS INTEGER)) AS BIGINT) AS accepted_x, CAST(sum(CAST(accept_y AS INTEGER)) AS BIGINT) AS accepted_y, list(CAST(dx_qpel / 4 AS BIGINT) ORDER BY dx_qpel) FILTER (accept_x) AS lx, list(CAST(dy_qpel / 4 AS BIGINT) ORDER BY dy_qpel) FILTER (accept_y) AS ly, CAST(max(greatest(abs(dx_qpel / 4 - dx_coarse), abs(dy_qpel / 4 - dy_coarse))) AS BIGINT) AS moved FROM a GROUP BY poc) SELECT poc, accepted_x, accepted_y, lx[CAST(floor(len(lx) / 2) + 1 AS INTEGER)] AS median_dx, ly[CAST(floor(len(ly) / 2) + 1 AS INTEGER)] AS median_dy, moved FROM s")
def gm1(t):
    return mv.frame_summary(mv.gates(t))


@query("gm2_totals", "f_gm", oracle=f"WITH {_GATE} SELECT {_AXES} FROM a")
def gm2(t):
    return mv.totals(mv.gates(t))


_REF = "r AS (SELECT frame, y, x, (v * 7 + y) % 256 AS v FROM f_gr), c AS (SELECT frame, y, x, v FROM f_gr)"


def _pair(t):
    """The picture and a reference made from it."""
    return t, t.withColumn("v", (F.col("v") * 7 + F.col("y")) % 256)


_SEARCH = f"""{_REF}, h AS (SELECT frame, CAST(floor((max(y) + 1) / 8) * 8 AS BIGINT) AS height, max(y) + 1 AS nrows FROM c GROUP BY frame),
k AS (SELECT c.frame, CAST(floor(c.y / 8) AS BIGINT) AS block_y, CAST(floor(c.x / 8) AS BIGINT) AS block_x, CAST(dy AS INTEGER) AS dy, CAST(dx AS INTEGER) AS dx, CAST(sum(abs(c.v - r.v)) AS BIGINT) AS cost FROM c JOIN h ON h.frame = c.frame AND c.y < h.height, range(-2, 3) a(dy), range(-2, 3) b(dx) JOIN r ON r.frame = c.frame AND r.y = c.y + dy AND r.x = c.x + dx
WHERE floor(c.y / 8) * 8 + dy >= 0 AND floor(c.y / 8) * 8 + 7 + dy < nrows AND floor(c.x / 8) * 8 + dx >= 0 AND floor(c.x / 8) * 8 + 8 + dx <= 64 GROUP BY 1, 2, 3, 4, 5)"""


@query("mv2_block_match", "f_gr", oracle=f"WITH {_SEARCH} SELECT frame, block_y, block_x, cost, dy, dx FROM (SELECT *, row_number() OVER (PARTITION BY frame, block_y, block_x ORDER BY cost, dy, dx) AS rn FROM k) WHERE rn = 1")
def mv2(t):
    return mv.block_match(*_pair(t), 8, 2)



def _moved_sad(cur, ref):
    vectors = cur.select("frame", F.floor(F.col("y") / 8).alias("block_y"), F.floor(F.col("x") / 8).alias("block_x")).distinct().select("*", F.lit(1).alias("dx"), F.lit(-1).alias("dy"))
    return mv.common_sad(cur, ref, vectors, 8)


@query("mv1_common_sad", "f_gr", oracle=f"WITH {_REF}, e AS (SELECT frame, max(x) AS mx, max(y) AS my FROM r GROUP BY frame) SELECT c.frame, CAST(floor(c.y / 8) AS BIGINT) AS block_y, CAST(floor(c.x / 8) AS BIGINT) AS block_x, CAST(sum(abs(c.v - r.v)) AS BIGINT) AS sad FROM c JOIN e USING (frame) JOIN r ON r.frame = c.frame AND r.x = least(greatest(c.x + 1, 0), mx) AND r.y = least(greatest(c.y - 1, 0), my) GROUP BY 1, 2, 3")
def mv1(t):
    return _moved_sad(*_pair(t))



@query("mv3_static_blocks", "f_gr", oracle="WITH s AS (SELECT frame, CAST(floor(y / 8) AS BIGINT) AS block_y, CAST(floor(x / 8) AS BIGINT) AS block_x, CAST(sum(abs(v - (v + (y * x) % 5))) AS BIGINT) AS sad, count(*) AS n FROM f_gr GROUP BY 1, 2, 3) SELECT * FROM s WHERE sad <= 2 * n")
def mv3(t):
    return mv.static_blocks(t, t.withColumn("v", F.col("v") + (F.col("y") * F.col("x")) % 5), 8)


_C8 = "c8 AS (SELECT frame, CAST(floor(y / 8) AS BIGINT) AS block_y, CAST(floor(x / 8) AS BIGINT) AS block_x, CAST(dy AS BIGINT) AS dy, CAST(dx AS BIGINT) AS dx, CAST(sum((v * (dy + 3) + dx * 11) % 97) AS BIGINT) AS cost FROM f_gr, range(-1, 2) a(dy), range(-1, 2) b(dx) GROUP BY 1, 2, 3, 4, 5)"


def _costs(t):
    d = F.sequence(F.lit(-1).cast("long"), F.lit(1).cast("long"))
    each = t.select("frame", "y", "x", "v", F.explode(d).alias("dy")).select("*", F.explode(d).alias("dx"))
    return each.groupBy("frame", F.floor(F.col("y") / 8).alias("block_y"), F.floor(F.col("x") / 8).alias("block_x"), "dy", "dx").agg(F.sum((F.col("v") * (F.col("dy") + 3) + F.col("dx") * 11) % 97).alias("cost"))


@query("mv4_size_pyramid", "f_gr", oracle=f"WITH {_C8}, s AS (SELECT frame, CAST(n * 8 AS INTEGER) AS size, CAST(floor(block_y / n) AS BIGINT) AS block_y, CAST(floor(block_x / n) AS BIGINT) AS block_x, dy, dx, CAST(sum(cost) AS BIGINT) AS cost FROM c8, (VALUES (1), (2), (4), (8)) l(n) GROUP BY 1, 2, 3, 4, 5, 6) SELECT frame, size, block_y, block_x, cost, dy, dx FROM (SELECT *, row_number() OVER (PARTITION BY frame, size, block_y, block_x ORDER BY cost, dy, dx) AS rn FROM s) WHERE rn = 1")
def mv4(t):
    return mv.size_pyramid(_costs(t))


@query("tk3_argmin_stable", "f_gr", oracle=f"WITH {_C8} SELECT frame, block_y, block_x, cost, dy, dx FROM (SELECT *, row_number() OVER (PARTITION BY frame, block_y, block_x ORDER BY cost, dy, dx) AS rn FROM c8) WHERE rn = 1")
def tk3(t):
    return mv.argmin_stable(_costs(t), ["frame", "block_y", "block_x"], "cost", ["dy", "dx"])


@query("tk4_best_two", "f_gr", oracle=f"WITH {_C8} SELECT frame, block_y, block_x, dy, dx, cost, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY frame, block_y, block_x ORDER BY cost, dy, dx) AS rank FROM c8) WHERE rank <= 2")
def tk4(t):
    return mv.best_two(_costs(t), ["frame", "block_y", "block_x"], "cost", ["dy", "dx"])


@query("jn14_candidate_search", "f_gr", oracle=f"WITH {_SEARCH} SELECT frame, block_y, block_x, min(cost) AS cost, count(*) AS candidates FROM k GROUP BY frame, block_y, block_x")
def jn14(t):
    return mv.candidate_search(*_pair(t), 8, 2).select("frame", "block_y", "block_x", "cost", "candidates")

