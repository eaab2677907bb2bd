"""Queries of the trajectory family (TR, GM4, GM5, GR5, JN15)."""

from functools import reduce

from pyspark.sql import functions as F

from ..operators import trajectory as tr
from ..registry import query

_FILL = "g AS (SELECT s.series, r.frame, CASE WHEN r.frame = 0 THEN 0.0 ELSE coalesce(f.v, 0.0) END AS v FROM (SELECT DISTINCT series FROM f_ts) s, (SELECT unnest(range(0, 720)) AS frame) r LEFT JOIN f_ts f ON f.series = s.series AND f.frame = r.frame)"


@query("tr1_accumulate", "f_ts", oracle=f"WITH {_FILL} SELECT series, frame, round(sum(v) OVER (PARTITION BY series ORDER BY frame ROWS UNBOUNDED PRECEDING), 3) AS raw_v FROM g")
def tr1(t):
    return tr.accumulate(t, 0, 719, ("v",)).withColumn("raw_v", F.round("raw_v", 3))


@query("tr2_moving_average", "f_ts", oracle="SELECT series, frame, round(avg(v) OVER (PARTITION BY series ORDER BY frame ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING), 5) AS smooth FROM f_ts")
def tr2(t):
    return tr.moving_average(t, 7).select("series", "frame", F.round("smooth", 5).alias("smooth"))


@query("tr3_gaussian_smooth", "f_ts", oracle="WITH n AS (SELECT series, frame, v, row_number() OVER (PARTITION BY series ORDER BY frame) AS i FROM f_ts) SELECT a.series, a.frame, round(sum(b.v * exp(-power(b.i - a.i, 2) / 8.0)) / sum(exp(-power(b.i - a.i, 2) / 8.0)), 5) AS smooth FROM n a JOIN n b ON b.series = a.series AND b.i BETWEEN a.i - 6 AND a.i + 6 GROUP BY a.series, a.frame")
def tr3(t):
    return tr.gaussian_smooth(t, 2.0).select("series", "frame", F.round("smooth", 5).alias("smooth"))


#: The filter by recursion: f the states and covariances, with the predictions (m, n; a, b, d) before each update.
_FILTER = """z AS (SELECT series, frame, CAST(v AS DOUBLE) AS v, row_number() OVER (PARTITION BY series ORDER BY frame) AS k FROM f_ts),
f AS (SELECT series, frame, v, k, v AS m, 0.0::DOUBLE AS n, 4e6::DOUBLE AS a, 0.0::DOUBLE AS b, 4e6::DOUBLE AS d, v AS x0, 0.0::DOUBLE AS x1, 4e6::DOUBLE * 4 / (4e6::DOUBLE + 4) AS p00, 0.0::DOUBLE AS p01, 4e6::DOUBLE AS p11 FROM z WHERE k = 1
UNION ALL SELECT z.series, z.frame, z.v, z.k, m, n, a, b, d, m + a / (a + 4) * (z.v - m), n + b / (a + 4) * (z.v - m), (1 - a / (a + 4)) * a, (1 - a / (a + 4)) * b, d - b / (a + 4) * b
FROM (SELECT series, k, x0 + x1 AS m, x1 AS n, p00 + 2 * p01 + p11 + 0.0005::DOUBLE AS a, p01 + p11 + 0.001::DOUBLE AS b, p11 + 0.002::DOUBLE AS d FROM f) q JOIN z ON z.series = q.series AND z.k = q.k + 1)"""
#: The way back: what the step after a place adds to its state.
_BACK = """g AS (SELECT f.*, o.m AS om, o.n AS on_, (f.p00 + f.p01) / (o.a * o.d - o.b * o.b) AS c0, f.p01 / (o.a * o.d - o.b * o.b) AS c1, (f.p01 + f.p11) / (o.a * o.d - o.b * o.b) AS c2, f.p11 / (o.a * o.d - o.b * o.b) AS c3, o.a AS oa, o.b AS ob, o.d AS od FROM f LEFT JOIN f o ON o.series = f.series AND o.k = f.k + 1),
s AS (SELECT series, frame, v, k, x0 AS n0, x1 AS n1 FROM g WHERE om IS NULL
UNION ALL SELECT g.series, g.frame, g.v, g.k, g.x0 + (c0 * od - c1 * ob) * (s.n0 - om) + (c1 * oa - c0 * ob) * (s.n1 - on_), g.x1 + (c2 * od - c3 * ob) * (s.n0 - om) + (c3 * oa - c2 * ob) * (s.n1 - on_) FROM s JOIN g ON g.series = s.series AND g.k = s.k - 1)"""


@query("tr4_kalman_causal", "f_ts", oracle=f"WITH RECURSIVE {_FILTER} SELECT series, frame, v, round(x0, 4) AS smooth FROM f")
def tr4(t):
    return tr.kalman_causal(t, 0.002, 4.0).withColumn("smooth", F.round("smooth", 4))


@query("tr5_kalman_rts", "f_ts", oracle=f"WITH RECURSIVE {_FILTER}, {_BACK} SELECT series, frame, v, round(n0, 4) AS smooth FROM s")
def tr5(t):
    return tr.kalman_rts(t, 0.002, 4.0).withColumn("smooth", F.round("smooth", 4))


_MA = "m AS (SELECT series, frame, v, avg(v) OVER (PARTITION BY series ORDER BY frame ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS smooth FROM f_ts)"


@query("tr6_correction", "f_ts", oracle=f"WITH {_MA} SELECT series, frame, round(smooth - v, 5) AS correction FROM m")
def tr6(t):
    return tr.correction(tr.moving_average(t, 7)).select("series", "frame", F.round("correction", 5).alias("correction"))


@query("tr6_largest_correction", "f_ts", oracle=f"WITH {_MA} SELECT round(max(sqrt(power(smooth - v, 2) + power((smooth - v) / 2, 2))), 5) AS largest, CAST(sum(CASE WHEN v > 200 THEN 1 ELSE 0 END) AS BIGINT) AS failed FROM m")
def tr6_largest(t):
    c = tr.correction(tr.moving_average(t, 7)).withColumn("half", F.col("correction") / 2)
    return tr.hypot_summary(c, "correction", "half", F.col("v") > 200).withColumn("largest", F.round("largest", 5))


@query("tr7_shake", "f_ts", oracle=f"WITH {_MA}, s AS (SELECT series, abs(v - lag(v) OVER w) AS a, abs(smooth - lag(smooth) OVER w) AS b FROM m WINDOW w AS (PARTITION BY series ORDER BY frame)) SELECT series, round(avg(a), 5) AS before, round(avg(b), 5) AS after, round((1 - avg(b) / avg(a)) * 100, 4) AS reduction FROM s GROUP BY series")
def tr7(t):
    s = tr.shake(tr.moving_average(t, 7))
    return s.select("series", F.round("before", 5).alias("before"), F.round("after", 5).alias("after"), F.round("reduction", 4).alias("reduction"))


@query("jn15_truth_join", "f_ts", oracle=f"WITH {_MA} SELECT series, round(avg(abs(smooth - v)), 5) AS mean_error, round(max(abs(smooth - v)), 5) AS max_error, round(sqrt(avg(power(smooth - v, 2))), 5) AS rms_error FROM m GROUP BY series")
def jn15(t):
    e = tr.truth_join(tr.moving_average(t, 7).select("series", "frame", F.col("smooth").alias("v")), t)
    return e.select("series", *[F.round(c, 5).alias(c) for c in ("mean_error", "max_error", "rms_error")])


@query("gr5_binomial_smooth", "f_ts", oracle="WITH i AS (SELECT series, frame, CAST(floor(v) AS BIGINT) AS v FROM f_ts), n AS (SELECT series, frame, v, coalesce(lag(v, 1) OVER w, first_value(v) OVER w) AS a1, coalesce(lag(v, 2) OVER w, first_value(v) OVER w) AS a2, coalesce(lead(v, 1) OVER w, last_value(v) OVER z) AS b1, coalesce(lead(v, 2) OVER w, last_value(v) OVER z) AS b2 FROM i WINDOW w AS (PARTITION BY series ORDER BY frame), z AS (PARTITION BY series ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) SELECT series, frame, CAST(floor((a2 + 4 * a1 + 6 * v + 4 * b1 + b2 + 8) / 16) AS BIGINT) AS five, CAST(floor((a1 + 2 * v + b1 + 2) / 4) AS BIGINT) AS three FROM n")
def gr5(t):
    i = t.select("series", "frame", F.floor("v").alias("v"))
    five = tr.binomial_smooth(i, 5).withColumnRenamed("smooth", "five")
    return tr.binomial_smooth(five, 3).select("series", "frame", "five", F.col("smooth").alias("three"))


_SHIFT = "p AS (SELECT a.series, CAST(d AS INTEGER) AS d, a.v AS o, b.v AS r FROM f_ts a, range(-6, 7) x(d) JOIN f_ts b ON b.series = a.series AND b.frame = a.frame + d), m AS (SELECT series, d, avg(o) AS mo, avg(r) AS mr FROM p GROUP BY series, d), c AS (SELECT p.series, p.d, round(avg(abs((o - mo) - (r - mr))), 6) AS cost FROM p JOIN m ON m.series = p.series AND m.d = p.d GROUP BY p.series, p.d)"


@query("gm4_profile_shift", "f_ts", oracle=f"WITH {_SHIFT.replace('b.frame = a.frame + d', 'b.frame = a.frame + d - 2')} SELECT series, arg_min(d, {{'c': cost, 's': abs(d), 'd': d}}) AS d, round(min(cost), 4) AS cost_best, round(max(CASE WHEN d = 0 THEN cost END), 4) AS cost_zero FROM c GROUP BY series")
def gm4(t):
    moved = t.withColumn("frame", F.col("frame") + 2)
    s = tr.profile_shift(t, moved, 6)
    return s.select("series", "d", F.round("cost_best", 4).alias("cost_best"), F.round("cost_zero", 4).alias("cost_zero"))


@query("gm5_profile_gain", "f_ts", oracle="WITH p AS (SELECT a.series, a.v AS o, b.v AS r FROM f_ts a JOIN f_ts b ON b.series = a.series AND b.frame = a.frame + 1), g AS (SELECT series, covar_pop(o, r) AS c, var_pop(r) AS v FROM p GROUP BY series), w AS (SELECT * FROM g, (VALUES (1), (2), (40), (100)) x(width)) SELECT series, width, CAST(CASE WHEN v <= width * width THEN 4096 ELSE least(8192, greatest(2048, sign(c) * floor(abs(c / v * 4096) + 0.5))) END AS BIGINT) AS gain_q12 FROM w")
def gm5(t):
    by_width = [tr.profile_gain(t, t, 1, profile_width=w).select("series", F.lit(w).alias("width"), "gain_q12") for w in (1, 2, 40, 100)]
    return reduce(lambda a, b: a.unionAll(b), by_width)


