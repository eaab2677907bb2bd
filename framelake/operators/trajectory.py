"""Trajectories: accumulation, smoothing, correction, and one-dimensional registration of profiles."""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import round_half_away
from ..sources.store import written

_SO_FAR = (Window.unboundedPreceding, 0)


def accumulate(models: DataFrame, first: int, last: int, components: tuple[str, ...], key: str = "series") -> DataFrame:
    """key, frame and raw_* for every frame of [first, last]: running sums; a missing model is no motion, the first frame is zero."""
    frames = models.select(key).distinct().select(key, F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long"))).alias("frame"))
    w = Window.partitionBy(key).orderBy("frame").rowsBetween(*_SO_FAR)
    step = lambda c: F.when(F.col("frame") == first, 0.0).otherwise(F.coalesce(F.col(c), F.lit(0.0)))
    return frames.join(models, [key, "frame"], "left").select(key, "frame", *[F.sum(step(c)).over(w).alias(f"raw_{c}") for c in components])


def moving_average(series: DataFrame, radius: int, value: str = "v", key: str = "series") -> DataFrame:
    """`smooth`: mean of the rows within the radius; at the ends of those there are."""
    return series.withColumn("smooth", F.avg(value).over(Window.partitionBy(key).orderBy("frame").rowsBetween(-radius, radius)))


def gaussian_smooth(series: DataFrame, sigma: float, value: str = "v", key: str = "series") -> DataFrame:
    """Weights exp(-d^2 / 2 sigma^2) over 3 sigma rows a side, renormalised at the ends; sigma <= 0 changes nothing."""
    if sigma <= 0:
        return series.withColumn("smooth", F.col(value))
    half = math.ceil(3 * sigma)
    w = Window.partitionBy(key).orderBy("frame")
    weights = [(d, math.exp(-d * d / (2 * sigma * sigma))) for d in range(-half, half + 1)]
    at = {d: F.lag(value, -d).over(w) if d < 0 else F.lead(value, d).over(w) if d else F.col(value) for d, _ in weights}
    near = series.withColumns({f"near_{d + half}": at[d] for d, _ in weights})
    top, bottom = F.lit(0.0), F.lit(0.0)
    for d, weight in weights:
        c = F.col(f"near_{d + half}")
        top, bottom = top + F.coalesce(c * weight, F.lit(0.0)), bottom + F.when(c.isNotNull(), weight).otherwise(0.0)
    return near.withColumn("smooth", top / bottom).drop(*[f"near_{d + half}" for d, _ in weights])


CHUNK = 1 << 14  # frame numbers of a series worked on at once


class Gains:
    """What the constant-velocity filter of variances q and r does at the k-th value of any series: its covariances do not depend on the values.

    `filter(k)`: the two gains. `smoother(k)`: the gain of the backward pass as (g00, g01, g10, g11). Both are found once, in turn, and stay
    as they are from where the covariance no longer changes.
    """

    def __init__(self, q: float, r: float):
        self.q, self.r = q, r
        self.now = (1e6 * max(r, 1e-9), 0.0, 1e6 * max(r, 1e-9))
        self.forward: list[tuple[float, float]] = []
        self.back: list[tuple[float, float, float, float]] = []
        self.settled = False

    def _next(self) -> None:
        p00, p01, p11 = self.now
        g0, g1 = p00 / (p00 + self.r), p01 / (p00 + self.r)
        p00, p01, p11 = (1 - g0) * p00, (1 - g0) * p01, p11 - g1 * p01
        a, b, d = p00 + 2 * p01 + p11 + self.q / 4, p01 + p11 + self.q / 2, p11 + self.q
        det = a * d - b * b
        # Backward gain: P F' (predicted covariance)^-1, F = [[1, 1], [0, 1]].
        c00, c01, c10, c11 = p00 + p01, p01, p01 + p11, p11
        self.forward.append((g0, g1))
        self.back.append(((c00 * d - c01 * b) / det, (c01 * a - c00 * b) / det, (c10 * d - c11 * b) / det, (c11 * a - c10 * b) / det) if det else (0.0, 0.0, 0.0, 0.0))
        self.settled = (a, b, d) == self.now
        self.now = (a, b, d)

    def _upto(self, k: int) -> int:
        while len(self.forward) <= k and not self.settled:
            self._next()
        return min(k, len(self.forward) - 1)

    def filter(self, k: int) -> tuple[float, float]:
        return self.forward[self._upto(k)]

    def smoother(self, k: int) -> tuple[float, float, float, float]:
        return self.back[self._upto(k)]


_gains: dict[tuple[float, float], Gains] = {}


def gains(q: float, r: float) -> Gains:
    """One table a Python worker and pair of variances."""
    return _gains.setdefault((q, r), Gains(q, r))


def filtered(z: list[float], first: int, state: tuple[float, float] | None, g: Gains) -> list[tuple[float, float]]:
    """States after each value of a piece of a series that begins with its `first`-th value, given the state before it (None at the start)."""
    out = []
    for k, v in enumerate(z, first):
        x0, x1 = (v, 0.0) if state is None else (state[0] + state[1], state[1])
        g0, g1 = g.filter(k)
        state = x0 + g0 * (v - x0), x1 + g1 * (v - x0)
        out.append(state)
    return out


def smoothed(states: list[tuple[float, float]], first: int, after: tuple[float, float] | None, g: Gains) -> list[tuple[float, float]]:
    """The backward pass over the filtered states of a piece, given the smoothed state after it (None at the end)."""
    out, n = [], after
    for k in range(len(states) - 1, -1, -1):
        x0, x1 = states[k]
        if n is None:
            n = x0, x1
        else:
            g00, g01, g10, g11 = g.smoother(first + k)
            e0, e1 = n[0] - x0 - x1, n[1] - x1
            n = x0 + g00 * e0 + g01 * e1, x1 + g10 * e0 + g11 * e1
        out.append(n)
    return out[::-1]


_MAP = "m00 double, m01 double, m10 double, m11 double, b0 double, b1 double"


def _composed(step: Callable[[list, tuple[float, float]], tuple[float, float]], own: list, zero: list) -> tuple[float, ...]:
    """The affine map of a piece from the state on one side of it to that on the other: what it makes of a state of zero, and a piece of zeros of either unit state."""
    b, x, y = step(own, (0.0, 0.0)), step(zero, (1.0, 0.0)), step(zero, (0.0, 1.0))
    return x[0], y[0], x[1], y[1], b[0], b[1]


def _states(maps: DataFrame, key: str, backwards: bool) -> DataFrame:
    """key, block and the state (s0, s1) that each block starts from, from the maps of blocks (one row each): null for the first."""
    own = F.array_sort(F.collect_list(F.struct((-F.col("block") if backwards else F.col("block")).alias("at"), "block", "map")))

    def go(state, m):  # noqa: ANN001, ANN202
        first = state["s0"].isNull()
        s0, s1 = F.coalesce(state["s0"], F.lit(0.0)), F.coalesce(state["s1"], F.lit(0.0))
        n0 = m["map"]["m00"] * s0 + m["map"]["m01"] * s1 + m["map"]["b0"]
        n1 = m["map"]["m10"] * s0 + m["map"]["m11"] * s1 + m["map"]["b1"]
        told = F.struct(m["block"].alias("block"), F.when(~first, s0).alias("s0"), F.when(~first, s1).alias("s1"))
        return F.struct(F.concat(state["out"], F.array(told)).alias("out"), n0.alias("s0"), n1.alias("s1"))

    none = F.lit(None).cast("double")
    start = F.struct(F.array().cast("array<struct<block: bigint, s0: double, s1: double>>").alias("out"), none.alias("s0"), none.alias("s1"))
    return maps.groupBy(key).agg(own.alias("maps")).select(key, F.explode(F.aggregate("maps", start, go)["out"]).alias("o")).select(key, "o.block", "o.s0", "o.s1")


def _kalman(series: DataFrame, q: float, r: float, back: bool, value: str, key: str, chunk: int) -> DataFrame:
    frame = dict(series.dtypes)["frame"]
    rows = series.select(key, "frame", F.col(value).cast("double").alias("v"), F.floor(F.col("frame") / chunk).alias("block"))
    counts = rows.groupBy(key, "block").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first")
    pieces = rows.groupBy(key, "block").agg(F.array_sort(F.collect_list(F.struct("frame", "v"))).alias("rows"))
    pieces = pieces.join(counts.select(key, "block", before), [key, "block"]).select(key, "block", "rows", F.transform("rows.v", lambda v: F.coalesce(v, F.lit(float("nan")))).alias("z"), "first")
    pair = lambda a, b: [(None if x is None else (x, y)) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)]

    def forward_map(z: pa.Array, first: pa.Array) -> pa.Array:
        g, out = gains(q, r), []
        for own, k in zip(z.to_pylist(), first.to_pylist(), strict=True):
            if k == 0:
                x0, x1 = filtered(own, 0, None, g)[-1]
                out.append((0.0, 0.0, 0.0, 0.0, x0, x1))
            else:
                out.append(_composed(lambda v, s, k=k: filtered(v, k, s, g)[-1], own, [0.0] * len(own)))
        return _maps(out)

    def run_forward(z: pa.Array, first: pa.Array, s0: pa.Array, s1: pa.Array) -> pa.Array:
        g = gains(q, r)
        return pa.array([[{"x0": a, "x1": b} for a, b in filtered(own, k, s, g)] for own, k, s in zip(z.to_pylist(), first.to_pylist(), pair(s0, s1), strict=True)], pa.list_(pa.struct([("x0", pa.float64()), ("x1", pa.float64())])))

    def backward_map(states: pa.Array, first: pa.Array, last: pa.Array) -> pa.Array:
        g, out = gains(q, r), []
        for own, k, end in zip(states.to_pylist(), first.to_pylist(), last.to_pylist(), strict=True):
            own = [(s["x0"], s["x1"]) for s in own]
            if end:
                out.append((0.0, 0.0, 0.0, 0.0, *smoothed(own, k, None, g)[0]))
            else:
                out.append(_composed(lambda v, n, k=k: smoothed(v, k, n, g)[0], own, [(0.0, 0.0)] * len(own)))
        return _maps(out)

    def run_backward(states: pa.Array, first: pa.Array, s0: pa.Array, s1: pa.Array) -> pa.Array:
        g = gains(q, r)
        return pa.array([[x for x, _ in smoothed([(s["x0"], s["x1"]) for s in own], k, n, g)] for own, k, n in zip(states.to_pylist(), first.to_pylist(), pair(s0, s1), strict=True)], pa.list_(pa.float64()))

    maps = pieces.select(key, "block", F.arrow_udf(forward_map, _MAP)("z", "first").alias("map"))
    states = F.arrow_udf(run_forward, "array<struct<x0: double, x1: double>>")("z", "first", "s0", "s1")
    found = pieces.join(_states(maps, key, False), [key, "block"]).select(key, "block", "rows", "first", states.alias("states"))
    if back:
        last = F.lead("block").over(Window.partitionBy(key).orderBy("block")).isNull().alias("last")
        found = written(found, "filtered").join(counts.select(key, "block", last), [key, "block"])
        maps = found.select(key, "block", F.arrow_udf(backward_map, _MAP)("states", "first", "last").alias("map"))
        found = found.join(_states(maps, key, True), [key, "block"]).select(key, "rows", F.arrow_udf(run_backward, "array<double>")("states", "first", "s0", "s1").alias("smooth"))
    else:
        found = found.select(key, "rows", F.col("states.x0").alias("smooth"))
    each = found.select(key, F.explode(F.arrays_zip(F.col("rows.frame").alias("frame"), F.col("rows.v").alias("v"), "smooth")).alias("r"))
    return each.select(key, F.col("r.frame").cast(frame).alias("frame"), F.col("r.v").alias(value), "r.smooth")


def _maps(rows: list[tuple[float, ...]]) -> pa.Array:
    names = [c.split()[0] for c in _MAP.split(", ")]
    return pa.array([dict(zip(names, m, strict=True)) for m in rows], pa.struct([(n, pa.float64()) for n in names]))


def kalman_causal(series: DataFrame, q: float, r: float, value: str = "v", key: str = "series", chunk: int = CHUNK) -> DataFrame:
    """key, frame, value, smooth: a constant-velocity filter along each series.

    A piece of a series takes the state before it to the state after it by an affine map. Pieces of `chunk` frame numbers find their maps
    apart, the maps of a series are gone through in turn (a row a piece), and pieces are then filtered from the states they start from.
    """
    return _kalman(series, q, r, False, value, key, chunk)


def kalman_rts(series: DataFrame, q: float, r: float, value: str = "v", key: str = "series", chunk: int = CHUNK) -> DataFrame:
    """The causal filter and a backward pass, both by pieces; filtered pieces are written in between."""
    return _kalman(series, q, r, True, value, key, chunk)


def correction(smoothed: DataFrame, value: str = "v") -> DataFrame:
    return smoothed.withColumn("correction", F.col("smooth") - F.col(value))


def shake(smoothed: DataFrame, value: str = "v", key: str = "series") -> DataFrame:
    """Mean change from frame to frame before and after smoothing, and the reduction in percent."""
    w = Window.partitionBy(key).orderBy("frame")
    steps = smoothed.select(key, F.abs(F.col(value) - F.lag(value).over(w)).alias("a"), F.abs(F.col("smooth") - F.lag("smooth").over(w)).alias("b"))
    return steps.groupBy(key).agg(F.avg("a").alias("before"), F.avg("b").alias("after")).withColumn("reduction", F.when(F.col("before") > 0, (1 - F.col("after") / F.col("before")) * 100))


def truth_join(estimate: DataFrame, truth: DataFrame, key: str = "series", value: str = "v") -> DataFrame:
    """Error of an estimate against the truth: mean, largest and root mean square."""
    e = estimate.select(key, "frame", F.col(value).alias("e")).join(truth.select(key, "frame", F.col(value).alias("t")), [key, "frame"])
    d = F.col("e") - F.col("t")
    return e.groupBy(key).agg(F.avg(F.abs(d)).alias("mean_error"), F.max(F.abs(d)).alias("max_error"), F.sqrt(F.avg(d * d)).alias("rms_error"))


def binomial_smooth(series: DataFrame, taps: int, value: str = "v", key: str = "series") -> DataFrame:
    """[1 2 1] / 4 or [1 4 6 4 1] / 16 in integers with rounding, ends replicated."""
    w = Window.partitionBy(key).orderBy("frame")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    near = lambda d: F.coalesce(F.lag(value, -d).over(w), F.first(value).over(whole)) if d < 0 else F.coalesce(F.lead(value, d).over(w), F.last(value).over(whole)) if d else F.col(value)
    kernel = {3: (1, 2, 1), 5: (1, 4, 6, 4, 1)}[taps]
    total = sum((near(d) * k for d, k in zip(range(-(taps // 2), taps // 2 + 1), kernel, strict=True)), F.lit(0))
    size = sum(kernel)
    return series.withColumn("smooth", F.floor((total + size // 2) / size).cast("long"))


def _shifted(o: DataFrame, r: DataFrame, radius: int, key: str, value: str) -> DataFrame:
    """o at t with r at t + d for every d of the radius: |d| <= radius copies of o meet r by equality."""
    shifts = o.select(key, "frame", F.col(value).alias("o"), F.explode(F.sequence(F.lit(-radius), F.lit(radius))).alias("d"))
    return shifts.withColumn("at", F.col("frame") + F.col("d")).join(r.select(key, F.col("frame").alias("at"), F.col(value).alias("r")), [key, "at"])


def profile_shift(o: DataFrame, r: DataFrame, radius: int, key: str = "series", value: str = "v") -> DataFrame:
    """Best shift of each key: the smallest mean absolute distance of mean-removed profiles, smaller |d| on ties; with the costs of the best and of no shift.

    Serves as a lag finder between any two series.
    """
    pairs = _shifted(o, r, radius, key, value)
    means = pairs.groupBy(key, "d").agg(F.avg("o").alias("mo"), F.avg("r").alias("mr"))
    cost = pairs.join(means, [key, "d"]).groupBy(key, "d").agg(F.avg(F.abs((F.col("o") - F.col("mo")) - (F.col("r") - F.col("mr")))).alias("cost"))
    rounded = cost.withColumn("cost", F.round("cost", 6))
    best = rounded.groupBy(key).agg(F.min(F.struct("cost", F.abs("d").alias("size"), "d")).alias("b"), F.max(F.when(F.col("d") == 0, F.col("cost"))).alias("cost_zero"))
    return best.select(key, F.col("b.d").alias("d"), F.col("b.cost").alias("cost_best"), "cost_zero")


def profile_gain(o: DataFrame, r: DataFrame, d: int, key: str = "series", value: str = "v", profile_width: int = 1, flat_grey_levels: float = 1.0) -> DataFrame:
    """Slope of o on r at a shift, in Q12, rounded half away from zero and clamped to 2048..8192.

    4096 where r is flat: its standard deviation is at most `flat_grey_levels` for each of the `profile_width` samples that a value sums up.
    """
    pairs = o.select(key, "frame", F.col(value).alias("o")).withColumn("at", F.col("frame") + d).join(r.select(key, F.col("frame").alias("at"), F.col(value).alias("r")), [key, "at"])
    g = pairs.groupBy(key).agg(F.covar_pop("o", "r").alias("c"), F.var_pop("r").alias("v"))
    flat = F.col("v") <= float(flat_grey_levels * profile_width) ** 2
    gain = F.least(F.lit(8192), F.greatest(F.lit(2048), round_half_away(F.col("c") / F.when(flat, None).otherwise(F.col("v")) * 4096)))
    return g.select(key, F.when(flat, F.lit(4096)).otherwise(gain).cast("long").alias("gain_q12"))


def hypot_summary(corrections: DataFrame, x: str, y: str, failed: Column) -> DataFrame:
    return corrections.agg(F.max(F.hypot(x, y)).alias("largest"), F.sum(failed.cast("long")).alias("failed"))
