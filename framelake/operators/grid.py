"""Two-dimensional sample grids in long form (frame, y, x, v): statistics, stencils, resampling, comparison.

Stencils work on rows: a row of samples is one array, the rows above and below come by window lags, and what a place needs are slices of
these arrays, so that no sample is sent more than once, however large the kernel. Planes are whole: x and y count from 0 without gaps.
Borders replicate: a sample on an edge also stands for those beyond it.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

AT = ["frame", "y", "x"]


def _edges(grid: DataFrame) -> DataFrame:
    return grid.groupBy("frame").agg(F.max("x").alias("mx"), F.max("y").alias("my"))


def _with_edges(grid: DataFrame) -> DataFrame:
    """Each frame has one row of edges; they are attached by a join that keeps the samples where they are if that is small enough for the session's limit."""
    return grid.join(_edges(grid), "frame")


def to_int(v: Column, low: int = 0, high: int = 255) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), F.floor(v + 0.5))).cast("long")


def _by_window(grid: DataFrame, reach: list[int], make: Callable[[Column, Column], Column]) -> DataFrame:
    """frame, y, x, v: `make(samples, centre)` for every place; samples: those of its window in raster order, of a row at distance d from it
    2 reach[|d|] + 1 (none where that is negative)."""
    most = len(reach) - 1
    row = grid.groupBy("frame", F.col("y").cast("long").alias("y")).agg(F.transform(F.array_sort(F.collect_list(F.struct("x", "v"))), lambda s: s["v"]).alias("row"))
    w = Window.partitionBy("frame").orderBy("y")
    beside = lambda move, d: F.coalesce(*[move("row", k).over(w) for k in range(d, 0, -1)], F.col("row"))  # noqa: E731  beyond the edge: the row nearest to it
    rows = [beside(F.lag, -d) if d < 0 else beside(F.lead, d) for d in range(-most, most + 1)]
    pad = max(reach)
    wide = lambda c: F.concat(F.array_repeat(F.get(c, F.lit(0)), pad), c, F.array_repeat(F.element_at(c, -1), pad))
    near = row.select("frame", "y", "row", *[r.alias(f"n{i}") for i, r in enumerate(rows)]).select("frame", "y", "row", *[wide(F.col(f"n{i}")).alias(f"n{i}") for i in range(len(rows))])
    parts = [(f"n{i}", reach[abs(i - most)]) for i in range(len(rows)) if reach[abs(i - most)] >= 0]
    window = lambda x: F.flatten(F.array(*[F.slice(F.col(n), x + (pad - r + 1), F.lit(2 * r + 1)) for n, r in parts]))
    made = F.transform(F.sequence(F.lit(0), F.size("row") - 1), lambda x: make(window(x), F.get(F.col("row"), x)))
    return near.select("frame", "y", F.posexplode(made).alias("x", "v")).select("frame", "y", F.col("x").cast("long").alias("x"), "v")


def _square(k: int) -> list[int]:
    return [k // 2] * (k // 2 + 1)


HISTOGRAMS = 1 << 24  # counts held at once; a band of more columns times values (16-bit samples) has its windows sorted instead
BAND = 64  # rows of a picture that a filter in arrays gets at once, besides those within its reach


def _by_band(grid: DataFrame, reach: int, kernel: Callable[[np.ndarray, int, int], np.ndarray]) -> DataFrame:
    """frame, y, x, v of whole bands of rows: `kernel` gets a band with the picture's rows within `reach` of it, and which of them are the band, and gives the band.

    Rows near an edge of their band also go to the next one, so that a row is sent 1 + 2 reach / BAND times.
    """
    row = grid.groupBy("frame", F.col("y").cast("long").alias("y")).agg(F.transform(F.array_sort(F.collect_list(F.struct("x", "v"))), lambda s: s["v"].cast("long")).alias("row"))
    touched = F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col("y") - reach) / BAND)), F.floor((F.col("y") + reach) / BAND)))
    bands = row.select("*", touched.alias("band")).groupBy("frame", "band").agg(F.array_sort(F.collect_list(F.struct("y", "row"))).alias("rows"))

    def run(rows: pa.Array, band: pa.Array) -> pa.Array:
        out = []
        for own, b in zip(rows, band.to_pylist(), strict=True):
            y, wide = own.values.field("y").to_numpy(), own.values.field("row")
            low, high = np.searchsorted(y, [b * BAND, b * BAND + BAND])
            if low == high:
                out.append([])
                continue
            table = wide.flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1)
            made = kernel(table, low, high)
            out.append([{"y": int(k), "row": r} for k, r in zip(y[low:high], made, strict=True)])
        return pa.array(out, pa.list_(pa.struct([("y", pa.int64()), ("row", pa.list_(pa.int64()))])))

    made = F.arrow_udf(run, "array<struct<y: bigint, row: array<bigint>>>")
    each = bands.select("frame", F.explode(made("rows", "band")).alias("r")).select("frame", "r.y", F.posexplode("r.row").alias("x", "v"))
    return each.select("frame", "y", F.col("x").cast("long").alias("x"), "v")


def _padded(table: np.ndarray, low: int, high: int, reach: int) -> np.ndarray:
    """Rows low to high of a table with `reach` samples more on every side, borders replicated."""
    own = table[max(0, low - reach) : high + reach]
    return np.pad(own, ((max(0, reach - low), max(0, reach - (len(table) - high))), (reach, reach)), "edge")


def _slide(a: np.ndarray, k: int, axis: int, pick: np.ufunc) -> np.ndarray:
    """Extremes of every k neighbours along an axis, two looks at each sample whatever k is: what a block of k has had so far, and what it has left
    (M. van Herk, 1992)."""
    a = np.moveaxis(a, axis, -1)
    n = a.shape[-1]
    blocks = np.pad(a, [(0, 0)] * (a.ndim - 1) + [(0, -n % k)], "edge").reshape(*a.shape[:-1], -1, k)
    before = pick.accumulate(blocks, axis=-1).reshape(*a.shape[:-1], -1)
    after = pick.accumulate(blocks[..., ::-1], axis=-1)[..., ::-1].reshape(*a.shape[:-1], -1)
    return np.moveaxis(pick(after[..., : n - k + 1], before[..., k - 1 : n]), -1, axis)


def _sliding_median(table: np.ndarray, r: int) -> np.ndarray:
    """Medians of the windows of 2r + 1 a side: histograms of columns that lose and gain a sample a row, and of windows that lose and gain a column."""
    values, codes = np.unique(table, return_inverse=True)
    codes = codes.reshape(table.shape)
    k, (height, width) = 2 * r + 1, (table.shape[0] - 2 * r, table.shape[1] - 2 * r)
    out = np.zeros((height, width), np.int64)
    if table.shape[1] * len(values) > HISTOGRAMS:
        windows = np.lib.stride_tricks.sliding_window_view(table, (k, k))
        for y in range(height):
            out[y] = np.partition(windows[y].reshape(width, -1), k * k // 2, axis=1)[:, k * k // 2]
        return out
    at = np.arange(table.shape[1])
    column = np.zeros((table.shape[1], len(values)), np.int32)
    for y in range(2 * r):
        column[at, codes[y]] += 1
    for y in range(height):
        column[at, codes[y + 2 * r]] += 1
        window = np.cumsum(column, axis=0)
        window[k:] = window[k:] - window[:-k]
        upto = np.cumsum(window[k - 1 :], axis=1)
        out[y] = values[(upto <= k * k // 2).sum(axis=1)]
        column[at, codes[y]] -= 1
    return out


def _weighted(samples: Column, kernel: list[list[float]]) -> Column:
    flat = F.array(*[F.lit(float(v)) for row in kernel for v in row])
    return F.aggregate(F.zip_with(samples, flat, lambda v, w: v * w), F.lit(0.0), lambda a, v: a + v)


def block_stats(grid: DataFrame, size: int, original: DataFrame | None = None) -> DataFrame:
    """Per block: mean, population variance, min, max, samples, and the squared error against an original (else null)."""
    g = grid
    if original is not None:
        g = g.join(original.select(*AT, F.col("v").alias("o")), AT, "left")
    else:
        g = g.withColumn("o", F.lit(None).cast("long"))
    d = F.col("v") - F.col("o")
    return g.groupBy("frame", F.floor(F.col("y") / size).alias("block_y"), F.floor(F.col("x") / size).alias("block_x")).agg(
        F.avg("v").alias("mean"), F.var_pop("v").alias("variance"), F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n"), F.sum(d * d).alias("sse"))


def histogram(grid: DataFrame, bins: int = 256) -> DataFrame:
    """Counts of every value of 0..bins-1 by frame, empty ones too."""
    every = grid.select("frame").distinct().select("frame", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("v"))
    return every.join(grid.groupBy("frame", "v").agg(F.count("*").alias("n")), ["frame", "v"], "left").select("frame", "v", F.coalesce("n", F.lit(0)).alias("n"))


def plane_diff(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("frame",)) -> DataFrame:
    """Per plane: squared error, samples, differing samples, the first in raster order, PSNR."""
    p = a.join(b.select(*keys, "y", "x", F.col("v").alias("w")), [*keys, "y", "x"])
    d = F.col("v") - F.col("w")
    out = p.groupBy(*keys).agg(F.sum(d * d).alias("sse"), F.count("*").alias("n"), F.sum((d != 0).cast("long")).alias("differing"), F.min(F.when(d != 0, F.struct("y", "x"))).alias("first"))
    return out.select(*keys, "sse", "n", "differing", F.col("first.y").alias("first_y"), F.col("first.x").alias("first_x"), F.when(F.col("sse") > 0, 10 * F.log10(65025.0 * F.col("n") / F.col("sse"))).alias("psnr"))


def shifted_join(grid: DataFrame, ref: DataFrame, dx: int, dy: int) -> DataFrame:
    """Every sample with the reference at (x + dx, y + dy), clamped to the edges."""
    e = _edges(ref)
    g = grid.join(e, "frame").withColumns({"rx": F.least(F.greatest(F.col("x") + dx, F.lit(0)), F.col("mx")), "ry": F.least(F.greatest(F.col("y") + dy, F.lit(0)), F.col("my"))}).drop("mx", "my")
    return g.join(ref.select("frame", F.col("x").alias("rx"), F.col("y").alias("ry"), F.col("v").alias("w")), ["frame", "rx", "ry"]).select(*AT, "v", "w")


def luma_diff(grid: DataFrame, ref: DataFrame, rect: tuple[int, int, int, int], dx: int, dy: int) -> DataFrame:
    """SAD and largest difference of a displaced crop (x, y, w, h)."""
    x, y, w, h = rect
    crop = grid.where(F.col("x").between(x, x + w - 1) & F.col("y").between(y, y + h - 1))
    d = F.abs(F.col("v") - F.col("w"))
    return shifted_join(crop, ref, dx, dy).groupBy("frame").agg(F.sum(d).alias("sad"), F.max(d).alias("largest"))


def diff_recon(a: DataFrame, b: DataFrame) -> DataFrame:
    """plane_diff of every common frame, with the first differing frame and how many differ."""
    d = plane_diff(a, b)
    s = d.agg(F.min(F.when(F.col("differing") > 0, F.col("frame"))).alias("first_frame"), F.sum((F.col("differing") > 0).cast("long")).alias("frames_differing"))
    return d.crossJoin(F.broadcast(s))  # one row


def prefix_sums(grid: DataFrame) -> DataFrame:
    """Exclusive running sums along rows and columns: the sum of a span is the difference of two."""
    before = (Window.unboundedPreceding, -1)
    return grid.withColumn("row_sum", F.coalesce(F.sum("v").over(Window.partitionBy("frame", "y").orderBy("x").rowsBetween(*before)), F.lit(0))).withColumn("col_sum", F.coalesce(F.sum("v").over(Window.partitionBy("frame", "x").orderBy("y").rowsBetween(*before)), F.lit(0)))


def project_profiles(grid: DataFrame, windows: DataFrame) -> DataFrame:
    """Row sums of every window (frame, window, x0, x1, y0, y1) from prefix sums: two samples a row instead of all."""
    p = prefix_sums(grid).withColumn("upto", F.col("row_sum") + F.col("v"))
    left = windows.join(p.select("frame", F.col("x").alias("x0"), "y", F.col("row_sum").alias("from")), ["frame", "x0"]).where("y BETWEEN y0 AND y1")
    return left.join(p.select("frame", F.col("x").alias("x1"), "y", "upto"), ["frame", "x1", "y"]).select("frame", "window", "y", (F.col("upto") - F.col("from")).alias("total"))


def stencil(grid: DataFrame, kernel: list[list[float]]) -> DataFrame:
    """Weighted sum over the kernel (a correlation), divided by the kernel's sum unless that vanishes, rounded and clipped."""
    total = sum(map(sum, kernel))
    return _by_window(grid, _square(len(kernel)), lambda w, _: to_int(_weighted(w, kernel) / (total if abs(total) >= 1e-12 else 1.0)))


def gaussian_kernel(k: int, sigma: float) -> list[float]:
    w = [math.exp(-((i - k // 2) ** 2) / (2 * sigma * sigma)) for i in range(k)]
    return [v / sum(w) for v in w]


def _separable(grid: DataFrame, weights: list[float]) -> DataFrame:
    """One axis after the other by window lags, borders replicated; `s` unrounded."""
    r = len(weights) // 2

    def along(df: DataFrame, value: str, part: str, order: str) -> DataFrame:
        w = Window.partitionBy("frame", part).orderBy(order)
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        first, last = F.first(value).over(whole), F.last(value).over(whole)
        near = {f"n{i}": (F.coalesce(F.lag(value, r - i).over(w), first) if i < r else F.coalesce(F.lead(value, i - r).over(w), last) if i > r else F.col(value)) for i in range(len(weights))}
        return df.withColumns(near).withColumn("s", sum((F.col(f"n{i}") * weights[i] for i in range(len(weights))), F.lit(0.0))).drop(*near)

    return along(along(grid.withColumn("s", F.col("v").cast("double")), "s", "y", "x"), "s", "x", "y")


def box(grid: DataFrame, k: int) -> DataFrame:
    return _separable(grid, [1.0 / k] * k).select(*AT, to_int(F.round("s", 6)).alias("v"))


def gauss(grid: DataFrame, k: int, sigma: float) -> DataFrame:
    return _separable(grid, gaussian_kernel(k, sigma)).select(*AT, to_int(F.round("s", 6)).alias("v"))


def median_filter(grid: DataFrame, k: int) -> DataFrame:
    """The middle one of k x k samples; what a sample costs depends on how many values there are, not on k."""
    return _by_band(grid, k // 2, lambda *band: _sliding_median(_padded(*band, k // 2), k // 2))


# The usual derivative kernels.
GRADIENTS = {"sobel": ([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]], [[-1, -2, -1], [0, 0, 0], [1, 2, 1]]), "scharr": ([[-3, 0, 3], [-10, 0, 10], [-3, 0, 3]], [[-3, -10, -3], [0, 0, 0], [3, 10, 3]]), "laplacian": ([[0, 1, 0], [1, -4, 1], [0, 1, 0]],)}


def gradient(grid: DataFrame, kind: str, gain: float = 1.0) -> DataFrame:
    """Magnitude of two kernels, or the absolute Laplacian; clipped."""
    kernels = GRADIENTS[kind]

    def make(w: Column, _: Column) -> Column:
        g = [_weighted(w, k) for k in kernels]
        return to_int(F.round((F.hypot(*g) if len(g) == 2 else F.abs(g[0])) * gain, 6))

    return _by_window(grid, _square(3), make)


def unsharp(grid: DataFrame, sigma: float, amount: float) -> DataFrame:
    k = 2 * math.ceil(3 * sigma) + 1
    s = _separable(grid, gaussian_kernel(k, sigma))
    return s.select(*AT, to_int(F.round(F.col("v") + amount * (F.col("v") - F.col("s")), 6)).alias("v"))


def _shape(shape: str, k: int) -> list[int]:
    """How far to either side a row at distance 0, 1, ... is taken; -1 for not at all."""
    r = k // 2
    if shape == "rect":
        return _square(k)
    if shape == "cross":
        return [r] + [0] * r
    return [math.isqrt(r * r - d * d) for d in range(r + 1)]


def _extreme(table: np.ndarray, reach: list[int], pick: np.ufunc) -> np.ndarray:
    """Extremes over a shape, which is the union of rectangles: each half-width with the rows that reach as far. A rectangle is slid along either axis."""
    r, (height, width) = len(reach) - 1, table.shape
    table = np.pad(table, r, "edge")
    parts = []
    for w in {w for w in reach if w >= 0}:
        d = max(d for d, own in enumerate(reach) if own >= w)
        part = table[r - d : r + d + height, r - w : r + w + width]
        parts.append(_slide(_slide(part, 2 * w + 1, 1, pick), 2 * d + 1, 0, pick))
    return functools.reduce(pick, parts)


#: What is taken one after the other, and what is then subtracted from what: the last of a list, or the samples themselves for an empty one.
MORPHOLOGY: dict[str, tuple[list[np.ufunc], list[np.ufunc] | None]] = {
    "erode": ([np.minimum], None), "dilate": ([np.maximum], None), "open": ([np.minimum, np.maximum], None), "close": ([np.maximum, np.minimum], None),
    "gradient": ([np.maximum], [np.minimum]), "tophat": ([], [np.minimum, np.maximum]), "blackhat": ([np.maximum, np.minimum], []),
}


def morphology(grid: DataFrame, op: str, shape: str = "rect", k: int = 3, iterations: int = 1) -> DataFrame:
    """All steps of an operation, and the difference of two, are done on a band at once, which sees as many rows as they reach together. Each step
    replicates the borders of what it gets; at a border that is not the picture's, only rows beyond the band come out wrong."""
    reach = _shape(shape, k)
    first, second = MORPHOLOGY[op]

    def kernel(table: np.ndarray, low: int, high: int) -> np.ndarray:
        after = lambda steps: functools.reduce(lambda t, pick: _extreme(t, reach, pick), [p for p in steps for _ in range(iterations)], table)[low:high]
        return after(first) if second is None else after(first) - after(second)

    return _by_band(grid, (len(reach) - 1) * iterations * max(len(first), len(second or [])), kernel)


def otsu_level(grid: DataFrame) -> DataFrame:
    """frame, level: the threshold of greatest between-class variance, from the histogram."""
    w = Window.partitionBy("frame")
    run = w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    h = grid.groupBy("frame", "v").agg(F.count("*").alias("n"))
    h = h.withColumns({"n0": F.sum("n").over(run), "s0": F.sum(F.col("n") * F.col("v")).over(run), "nn": F.sum("n").over(w), "ss": F.sum(F.col("n") * F.col("v")).over(w)})
    n1, s1 = F.col("nn") - F.col("n0"), F.col("ss") - F.col("s0")
    between = F.when(n1 > 0, F.round(F.col("n0").cast("double") * n1 * F.pow(F.col("s0") / F.col("n0") - s1 / n1, F.lit(2.0)), 3))
    return h.withColumn("b", between).groupBy("frame").agg(F.max_by("v", F.struct("b", -F.col("v"))).alias("level"))


def threshold(grid: DataFrame, level: int | None = None, inverted: bool = False) -> DataFrame:
    """255 above the level (Otsu's if none is given), else 0; or the other way round."""
    g = grid.join(otsu_level(grid), "frame") if level is None else grid.withColumn("level", F.lit(level))
    high, low = (0, 255) if inverted else (255, 0)
    return g.select(*AT, F.when(F.col("v") > F.col("level"), high).otherwise(low).cast("long").alias("v"))


def adaptive_threshold(grid: DataFrame, k: int, c: float) -> DataFrame:
    return _separable(grid, [1.0 / k] * k).select(*AT, F.when(F.col("v") > F.round(F.col("s"), 6) - c, 255).otherwise(0).cast("long").alias("v"))


def equalize(grid: DataFrame) -> DataFrame:
    """Values mapped through the normalised cumulative histogram."""
    w = Window.partitionBy("frame")
    h = grid.groupBy("frame", "v").agg(F.count("*").alias("n"))
    h = h.withColumns({"c": F.sum("n").over(w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)), "c0": F.first("n").over(w.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "nn": F.sum("n").over(w)})
    to = F.when(F.col("nn") > F.col("c0"), F.floor((F.col("c") - F.col("c0")) * 255.0 / (F.col("nn") - F.col("c0")) + 0.5)).otherwise(F.col("v"))
    return grid.join(h.select("frame", "v", to.cast("long").alias("to")), ["frame", "v"]).select(*AT, F.col("to").alias("v"))


def bilateral(grid: DataFrame, d: int, sigma_colour: float, sigma_space: float) -> DataFrame:
    """Weights by distance in space, in a disc, and in value."""
    reach = _shape("disc", d)
    far = [y * y + x * x for y in range(-len(reach) + 1, len(reach)) for x in range(-reach[abs(y)], reach[abs(y)] + 1)]
    space = F.array(*[F.lit(math.exp(-f / (2 * sigma_space**2))) for f in far])

    def make(w: Column, v: Column) -> Column:
        parts = F.zip_with(w, space, lambda s, k: F.struct(s.alias("w"), (k * F.exp(-((s - v) * (s - v)) / (2 * sigma_colour**2))).alias("k")))
        start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("d"))
        mean = F.aggregate(parts, start, lambda a, p: F.struct((a["n"] + p["w"] * p["k"]).alias("n"), (a["d"] + p["k"]).alias("d")), lambda a: a["n"] / a["d"])
        return to_int(F.round(mean, 6))

    return _by_window(grid, reach, make)


def downscale(grid: DataFrame, n: int = 1) -> DataFrame:
    """2 x 2 means with rounding, n times over; odd last rows and columns go."""
    for _ in range(n):
        e = _with_edges(grid).where((F.floor(F.col("x") / 2) * 2 < F.col("mx")) & (F.floor(F.col("y") / 2) * 2 < F.col("my")))
        grid = e.groupBy("frame", F.floor(F.col("y") / 2).alias("y"), F.floor(F.col("x") / 2).alias("x")).agg(F.floor((F.sum("v") + 2) / 4).alias("v"))
    return grid


def subsample(grid: DataFrame, step: int) -> DataFrame:
    """The centre sample of every step x step cell."""
    c = step // 2
    return grid.where((F.col("x") % step == c) & (F.col("y") % step == c)).select("frame", F.floor(F.col("y") / step).alias("y"), F.floor(F.col("x") / step).alias("x"), "v")


def pad_edges(grid: DataFrame, pad: int) -> DataFrame:
    """Edges replicated into a border; coordinates run from -pad."""
    e = _with_edges(grid)
    place = lambda at, edge: F.when((F.col(at) == 0) & (F.col(edge) == 0), F.sequence(F.lit(-pad).cast("long"), F.lit(pad).cast("long"))).when(F.col(at) == 0, F.sequence(F.lit(-pad).cast("long"), F.lit(0).cast("long"))).when(F.col(at) == F.col(edge), F.sequence(F.col(edge), F.col(edge) + pad)).otherwise(F.array(F.col(at)))
    return e.select("frame", "v", "x", "mx", F.explode(place("y", "my")).alias("y")).select("frame", "y", "v", F.explode(place("x", "mx")).alias("x")).select(*AT, "v")


def warp(grid: DataFrame, p: list[float]) -> DataFrame:
    """Inverse affine map, bilinear, pixel centres at one half, edges clamped: four corners of every target meet the samples by equality."""
    e = _with_edges(grid.withColumns({"x": F.col("x").cast("long"), "y": F.col("y").cast("long")}))
    cx, cy = F.col("x") + 0.5, F.col("y") + 0.5
    s = e.select("frame", "y", "x", "mx", "my", (p[0] + p[2] * cx + p[3] * cy - 0.5).alias("sx"), (p[1] + p[4] * cx + p[5] * cy - 0.5).alias("sy"))
    s = s.withColumns({"ix": F.floor("sx"), "iy": F.floor("sy")}).withColumns({"fx": F.col("sx") - F.col("ix"), "fy": F.col("sy") - F.col("iy")})
    corner = lambda a, b: F.struct((F.col("ix") + a).alias("x"), (F.col("iy") + b).alias("y"), ((F.col("fx") if a else 1 - F.col("fx")) * (F.col("fy") if b else 1 - F.col("fy"))).alias("weight"))
    c = s.select("frame", "y", "x", "mx", "my", F.explode(F.array(corner(0, 0), corner(1, 0), corner(0, 1), corner(1, 1))).alias("c"))
    c = c.select(*AT, F.least(F.greatest(F.col("c.x"), F.lit(0)), F.col("mx")).alias("rx"), F.least(F.greatest(F.col("c.y"), F.lit(0)), F.col("my")).alias("ry"), "c.weight")
    m = c.join(grid.select("frame", F.col("x").cast("long").alias("rx"), F.col("y").cast("long").alias("ry"), "v"), ["frame", "rx", "ry"])
    return m.groupBy(*AT).agg(F.sum(F.col("v") * F.col("weight")).alias("s")).select(*AT, to_int(F.round("s", 6)).alias("v"))


def flip(grid: DataFrame, horizontal: bool, vertical: bool) -> DataFrame:
    e = _with_edges(grid)
    return e.select("frame", (F.col("my") - F.col("y") if vertical else F.col("y")).alias("y"), (F.col("mx") - F.col("x") if horizontal else F.col("x")).alias("x"), "v")


def blend(top: DataFrame, bottom: DataFrame) -> DataFrame:
    """top (with alpha) over bottom: (a src + (255 - a) dst + 127) / 255 in integers; places without a top sample keep theirs."""
    m = bottom.join(top.select(*AT, F.col("v").alias("s"), F.col("alpha").alias("a")), AT, "left")
    return m.select(*AT, F.when(F.col("s").isNull(), F.col("v")).otherwise(F.floor((F.col("a") * F.col("s") + (255 - F.col("a")) * F.col("v") + 127) / 255)).alias("v"))


#: Stages of a chain: function and number of parameters.
STAGES: dict[str, tuple[Callable[..., DataFrame], int]] = {
    "box": (lambda g, k: box(g, int(k)), 1), "gauss": (lambda g, k, s: gauss(g, int(k), s), 2), "median": (lambda g, k: median_filter(g, int(k)), 1), "unsharp": (unsharp, 2),
    "threshold": (lambda g, t: threshold(g, int(t)), 1), "otsu": (lambda g: threshold(g), 0), "equalize": (lambda g: equalize(g), 0), "sobel": (lambda g, gain: gradient(g, "sobel", gain), 1),
}


def chain_key(stages: list[tuple[str, tuple[float, ...], bool]]) -> str:
    on = [f"{n}({','.join(format(p, '.17g') for p in ps)})" for n, ps, enabled in stages if enabled]
    return "chain:" + ("|".join(on) or "none")


def chain(grid: DataFrame, stages: list[tuple[str, tuple[float, ...], bool]]) -> DataFrame:
    """The enabled stages in order; a stage with the wrong number of parameters passes its input on; `chain_key` names what was done."""
    for name, parameters, enabled in stages:
        run, n = STAGES[name]
        if enabled and len(parameters) == n:
            grid = run(grid, *parameters)
    return grid.withColumn("chain_key", F.lit(chain_key(stages)))


def fitted_range(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    return values.groupBy(*keys).agg(F.min(value).alias("low"), F.max(value).alias("high"))
