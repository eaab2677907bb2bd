"""Motion fields: costs, searches, global models (least squares and robust) and gate tuning."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import round_half_away


def argmin_stable(candidates: DataFrame, keys: list[str], cost: str, order: list[str]) -> DataFrame:
    """The cheapest candidate of each key, the first in `order` on ties, with its columns."""
    rest = [c for c in candidates.columns if c not in (*keys, cost, *order)]
    best = candidates.groupBy(*keys).agg(F.min(F.struct(cost, *order, *rest)).alias("best"))
    return best.select(*keys, *[F.col(f"best.{c}").alias(c) for c in (cost, *order, *rest)])


def best_two(candidates: DataFrame, keys: list[str], cost: str, order: list[str]) -> DataFrame:
    """`rank` 1 and 2 of each key; the limit is applied before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(cost, *order)
    return candidates.withColumn("rank", F.row_number().over(w)).where("rank <= 2")


def _rows(grid: DataFrame, key: str) -> DataFrame:
    """One array of samples a row of the grid: searches work on whole rows, not on samples."""
    return grid.groupBy(key, "y").agg(F.transform(F.array_sort(F.collect_list(F.struct("x", "v"))), lambda s: s["v"]).alias("row"))


class BlockRow:
    """A row of `size` x `size` blocks and the reference rows within its reach: costs, and bounds of them from sums of sample rows.

    The error of a block is not below the sum, over its sample rows, of how far the row's total is from the reference's; totals of all places come
    from prefix sums. Displacements whose bound exceeds the best error so far are never summed.
    """

    def __init__(self, cur: np.ndarray, ref: np.ndarray, first: int, top: int, height: int, reach: int):
        self.size, self.count = len(cur), cur.shape[1] // len(cur)
        self.cur = cur[:, : self.count * self.size].reshape(self.size, self.count, self.size).swapaxes(0, 1)
        self.ref, self.top, self.first = ref, top, first
        moves = np.arange(-reach, reach + 1)
        dy = moves[(first + moves >= 0) & (first + self.size - 1 + moves < height)]
        self.moves = np.array([(y, x) for y in dy for x in moves]).reshape(-1, 2)
        starts = np.arange(self.count) * self.size + moves[:, None]
        inside = (starts >= 0) & (starts + self.size <= ref.shape[1])
        sums = np.zeros((len(ref), ref.shape[1] + 1), np.int64)
        np.cumsum(ref, axis=1, out=sums[:, 1:])
        at = np.where(inside, starts, 0)
        totals = sums[:, np.minimum(at + self.size, ref.shape[1])] - sums[:, at]
        own = self.cur.sum(axis=2).T
        bounds = [np.where(inside, np.abs(own[:, None] - totals[first + y - top : first + y - top + self.size]).sum(axis=0), -1) for y in dy]
        self.bounds = np.concatenate(bounds) if len(dy) else np.zeros((0, self.count), np.int64)

    def costs(self, move: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """Errors of some blocks, each at its displacement."""
        dy, dx = self.moves[move].T
        rows = (self.first - self.top + dy)[:, None, None] + np.arange(self.size)[:, None]
        columns = (blocks * self.size + dx)[:, None, None] + np.arange(self.size)
        return np.abs(self.cur[blocks] - self.ref[rows, columns]).sum(axis=(1, 2))

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Blocks with a displacement, the first cheapest one of each, its error, and how many were summed."""
        valid = self.bounds >= 0
        bounds = np.where(valid, self.bounds, np.iinfo(np.int64).max)
        blocks = np.flatnonzero(valid.any(axis=0))
        least, summed = np.full(self.count, np.iinfo(np.int64).max), np.zeros(self.count, np.int64)
        chosen = bounds.argmin(axis=0) if len(bounds) else np.zeros(self.count, np.int64)
        if len(blocks):
            least[blocks], summed[blocks] = self.costs(chosen[blocks], blocks), 1
        picked = chosen.copy()
        for move in range(len(bounds)):
            need = np.flatnonzero(valid[move] & (bounds[move] <= least) & (picked != move))
            if len(need):
                cost = self.costs(np.full(len(need), move), need)
                summed[need] += 1
                better = (cost < least[need]) | ((cost == least[need]) & (move < chosen[need]))
                least[need[better]], chosen[need[better]] = cost[better], move
        return blocks, chosen[blocks], least[blocks], summed[blocks]


def _matrix(rows: pa.ListArray) -> np.ndarray:
    """Sample rows as a matrix as wide as the shortest of them."""
    lengths = np.diff(rows.offsets.to_numpy())
    if len(set(lengths.tolist())) > 1:
        return np.array([r[: lengths.min()] for r in rows.to_pylist()], np.int64)
    return rows.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(rows), -1)


def block_match(cur: DataFrame, ref: DataFrame, size: int, reach: int, key: str = "frame", counted: bool = False) -> DataFrame:
    """key, block_x, block_y, dx, dy, cost: exhaustive search of every size x size block over |d| <= reach, displacements that leave the picture left
    out; with `counted` also `summed`, the displacements whose error was summed up.

    The first displacement in (dy, dx) order wins ties. A row of blocks meets the reference rows within its reach as one array of rows: a sample
    is shuffled in its row, once, and reference rows once for each row of blocks that can reach them.
    """
    a, b = _rows(cur, key), _rows(ref, key)
    lists = lambda df, name: df.groupBy(key, "block_y").agg(F.array_sort(F.collect_list(F.struct("y", "row"))).alias(name))
    height = a.groupBy(key).agg((F.max("y") + 1).alias("height"))
    own = lists(a.withColumn("block_y", F.floor(F.col("y") / size)), "cur").where(F.size("cur") == size)
    near = lists(b.withColumn("block_y", F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col("y") - reach) / size)), F.floor((F.col("y") + reach) / size)))), "ref")

    def run(cur: pa.Array, ref: pa.Array, block_y: pa.Array, height: pa.Array) -> pa.Array:
        out = []
        for c, r, y, h in zip(cur, ref, block_y.to_pylist(), height.to_pylist(), strict=True):
            c, r = c.values, r.values
            row = BlockRow(_matrix(c.field("row")), _matrix(r.field("row")), y * size, r.field("y")[0].as_py(), h, reach)
            blocks, move, cost, summed = row.best()
            out.append([{"block_x": int(i), "dy": int(row.moves[m][0]), "dx": int(row.moves[m][1]), "cost": int(k), "summed": int(n)} for i, m, k, n in zip(blocks, move, cost, summed, strict=True)])
        return pa.array(out, pa.list_(pa.struct([("block_x", pa.int64()), ("dy", pa.int32()), ("dx", pa.int32()), ("cost", pa.int64()), ("summed", pa.int64())])))

    search = F.arrow_udf(run, "array<struct<block_x: bigint, dy: int, dx: int, cost: bigint, summed: bigint>>")
    found = own.join(near, [key, "block_y"]).join(height, key).select(key, "block_y", F.explode(search("cur", "ref", "block_y", "height")).alias("b"))
    return found.select(key, "block_y", "b.block_x", "b.cost", "b.dy", "b.dx", *(["b.summed"] if counted else []))


def common_sad(cur: DataFrame, ref: DataFrame, vectors: DataFrame, size: int, key: str = "frame") -> DataFrame:
    """Plain SAD of a chosen whole-pixel displacement for each block, edges clamped.

    Parts of rows go to the reference row that they are compared with, which is not copied: it meets the list of all its parts.
    """
    a, b = _rows(cur, key), _rows(ref, key)
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("row") - 1) / size).cast("int")), lambda i: F.struct(i.cast("long").alias("block_x"), F.slice("row", i * size + 1, size).alias("part")))
    block = a.select(key, "y", F.floor(F.col("y") / size).alias("block_y"), F.explode(parts).alias("p")).select(key, "y", "block_y", "p.block_x", "p.part")
    edge = b.groupBy(key).agg(F.max("y").alias("bottom"))
    asked = block.join(vectors.select(key, "block_y", "block_x", "dx", "dy"), [key, "block_y", "block_x"]).join(edge, key)
    asked = asked.groupBy(key, F.least(F.greatest(F.col("y") + F.col("dy"), F.lit(0)), F.col("bottom")).alias("y")).agg(F.collect_list(F.struct("block_y", "block_x", "dx", "part")).alias("asked"))
    clamped = lambda p, i: F.get("row", F.least(F.greatest(p["block_x"] * size + p["dx"] + i, F.lit(0)), F.size("row") - 1).cast("int"))
    error = lambda p: F.aggregate(F.transform(p["part"], lambda v, i: F.abs(v - clamped(p, i))), F.lit(0).cast("long"), lambda acc, v: acc + v)
    costs = asked.join(b, [key, "y"]).select(key, F.explode(F.transform("asked", lambda p: F.struct(p["block_y"].alias("block_y"), p["block_x"].alias("block_x"), error(p).alias("sad")))).alias("c"))
    return costs.groupBy(key, "c.block_y", "c.block_x").agg(F.sum("c.sad").alias("sad"))


def static_blocks(cur: DataFrame, ref: DataFrame, size: int, most: int = 2, key: str = "frame") -> DataFrame:
    """Blocks whose error without displacement is at most `most` a sample: decided without a search."""
    s = cur.join(ref.select(key, "x", "y", F.col("v").alias("w")), [key, "x", "y"]).groupBy(key, F.floor(F.col("y") / size).alias("block_y"), F.floor(F.col("x") / size).alias("block_x")).agg(F.sum(F.abs(F.col("v") - F.col("w"))).alias("sad"), F.count("*").alias("n"))
    return s.where(F.col("sad") <= most * F.col("n"))


def size_pyramid(costs: DataFrame, key: str = "frame") -> DataFrame:
    """costs: key, block_y, block_x (8x8 blocks), dy, dx, cost -> the best candidate of each 8, 16, 32 and 64 block, judged apart by size."""
    level = costs.select(key, "dy", "dx", "cost", "block_y", "block_x", F.explode(F.array(*[F.lit(n) for n in (1, 2, 4, 8)])).alias("n"))
    summed = level.groupBy(key, (F.col("n") * 8).alias("size"), F.floor(F.col("block_y") / F.col("n")).alias("block_y"), F.floor(F.col("block_x") / F.col("n")).alias("block_x"), "dy", "dx").agg(F.sum("cost").alias("cost"))
    return argmin_stable(summed, [key, "size", "block_y", "block_x"], "cost", ["dy", "dx"])


def compare_algorithms(blocks: DataFrame, algorithms: list[str]) -> DataFrame:
    """One row a block: vector, native cost and common error of each algorithm."""
    return blocks.groupBy("frame", "size", "x", "y").pivot("algorithm", algorithms).agg(F.first("mv_x_q8").alias("mv_x_q8"), F.first("mv_y_q8").alias("mv_y_q8"), F.first("native_cost").alias("native_cost"), F.first("common_sad").alias("common_sad"))


def size_filter(blocks: DataFrame, mask: int) -> DataFrame:
    """Blocks of the sizes whose bit (1: 8, 2: 16, 4: 32, 8: 64) is set."""
    return blocks.where(F.lit(mask).bitwiseAND(F.floor(F.col("size") / 8).cast("int")) != 0)


def fit_points(blocks: DataFrame, size: int, width: int, height: int) -> DataFrame:
    """Centres of the blocks inside the picture and where their vectors take them."""
    inside = blocks.where((F.col("size") == size) & (F.col("x") + size <= width) & (F.col("y") + size <= height))
    cx, cy = F.col("x") + size / 2, F.col("y") + size / 2
    return inside.select("frame", "algorithm", F.col("x").alias("block_x"), F.col("y").alias("block_y"), cx.alias("px"), cy.alias("py"), (cx + F.col("mv_x_q8") / 8.0).alias("qx"), (cy + F.col("mv_y_q8") / 8.0).alias("qy"))


_KEYS = ["frame", "algorithm"]


def fit_translation(points: DataFrame) -> DataFrame:
    return points.groupBy(*_KEYS).agg(F.count("*").alias("n"), F.avg(F.col("qx") - F.col("px")).alias("p0"), F.avg(F.col("qy") - F.col("py")).alias("p1"))


def _moments(points: DataFrame) -> DataFrame:
    return points.groupBy(*_KEYS).agg(
        F.count("*").alias("n"), *[F.avg(c).alias(f"m_{c}") for c in ("px", "py", "qx", "qy")], F.var_pop("px").alias("sxx"), F.var_pop("py").alias("syy"), F.covar_pop("px", "py").alias("sxy"),
        *[F.covar_pop(a, b).alias(f"s_{a}{b}") for a in ("px", "py") for b in ("qx", "qy")],
    )


def _model(m: DataFrame, p2: Column, p3: Column, p4: Column, p5: Column) -> DataFrame:
    t = m.withColumns({"p2": p2, "p3": p3, "p4": p4, "p5": p5})
    p0 = F.col("m_qx") - F.col("p2") * F.col("m_px") - F.col("p3") * F.col("m_py")
    p1 = F.col("m_qy") - F.col("p4") * F.col("m_px") - F.col("p5") * F.col("m_py")
    return t.select(*_KEYS, "n", p0.alias("p0"), p1.alias("p1"), "p2", "p3", "p4", "p5")


def fit_rotzoom(points: DataFrame) -> DataFrame:
    """Four unknowns by least squares; null where all points coincide. Sums combine before the shuffle."""
    m = _moments(points)
    d = F.col("sxx") + F.col("syy")
    d = F.when(d > 1e-12, d)
    a, b = (F.col("s_pxqx") + F.col("s_pyqy")) / d, (F.col("s_pxqy") - F.col("s_pyqx")) / d
    return _model(m, a, -b, b, a)


def fit_affine(points: DataFrame) -> DataFrame:
    """Six unknowns by least squares; null where the points lie on a line."""
    m = _moments(points)
    det = F.col("sxx") * F.col("syy") - F.col("sxy") * F.col("sxy")
    det = F.when(F.abs(det) > 1e-9, det)
    solve = lambda q: ((F.col(f"s_px{q}") * F.col("syy") - F.col(f"s_py{q}") * F.col("sxy")) / det, (F.col(f"s_py{q}") * F.col("sxx") - F.col(f"s_px{q}") * F.col("sxy")) / det)
    (p2, p3), (p4, p5) = solve("qx"), solve("qy")
    return _model(m, p2, p3, p4, p5)


INLIER = 1.25  # pixels


def inliers(points: DataFrame, models: DataFrame) -> DataFrame:
    """Points with error and `inlier` under their key's model."""
    p = points.join(models.drop("n"), _KEYS)
    ex = F.col("p0") + F.col("p2") * F.col("px") + F.col("p3") * F.col("py") - F.col("qx")
    ey = F.col("p1") + F.col("p4") * F.col("px") + F.col("p5") * F.col("py") - F.col("qy")
    return p.withColumn("error", F.hypot(ex, ey)).withColumn("inlier", F.col("error") < INLIER)


def inlier_summary(points: DataFrame, models: DataFrame) -> DataFrame:
    e = inliers(points, models)
    return e.groupBy(*_KEYS).agg(F.count("*").alias("total"), F.sum(F.col("inlier").cast("long")).alias("inliers"), F.sqrt(F.avg(F.when(F.col("inlier"), F.col("error") * F.col("error")))).alias("rms"))


TRIALS, REFITS = 20, 5


def _sampled(n: int, k: int, trials: int) -> np.ndarray:
    """trials x k places below n, distinct within a trial: the high bits of a 32-bit congruential sequence that starts at n."""
    # Multiplier and increment of the sequence.
    state, out = n & 0xFFFFFFFF, np.empty((trials, k), np.int64)
    for t in range(trials):
        got: list[int] = []
        while len(got) < k:
            state = (state * 1103515245 + 12345) & 0xFFFFFFFF
            at = (state * n) >> 32
            if at not in got:
                got.append(at)
        out[t] = got
    return out


def _solve(p: np.ndarray, q: np.ndarray, kind: str) -> np.ndarray | None:
    mp, mq = p.mean(0), q.mean(0)
    x, y = (p - mp).T
    u, v = (q - mq).T
    if kind == "translation":
        a, b, c, d = 1.0, 0.0, 0.0, 1.0
    elif kind == "rotzoom":
        size = (x * x + y * y).sum()
        if size <= 1e-12:
            return None
        a = d = (x * u + y * v).sum() / size
        c = (x * v - y * u).sum() / size
        b = -c
    else:
        xx, yy, xy = (x * x).sum(), (y * y).sum(), (x * y).sum()
        det = xx * yy - xy * xy
        if abs(det) <= 1e-9:
            return None
        a, b = ((x * u).sum() * yy - (y * u).sum() * xy) / det, ((y * u).sum() * xx - (x * u).sum() * xy) / det
        c, d = ((x * v).sum() * yy - (y * v).sum() * xy) / det, ((y * v).sum() * xx - (x * v).sum() * xy) / det
    return np.array([mq[0] - a * mp[0] - b * mp[1], mq[1] - c * mp[0] - d * mp[1], a, b, c, d])


def fit_robust(points: DataFrame, kind: str = "rotzoom") -> DataFrame:
    """frame, algorithm, ok, p0..p5, inliers, total, rms: trials of few points, most inliers (least error on ties), refits while they improve.

    A key is one frame's blocks, which the picture's size bounds; the trials and their scores stay in its task.
    """
    k = {"translation": 1, "rotzoom": 2, "affine": 3}[kind]

    def score(m: np.ndarray, p: np.ndarray, q: np.ndarray) -> tuple[int, float, np.ndarray]:
        e = np.hypot(m[0] + p @ m[2:4] - q[:, 0], m[1] + p @ m[4:6] - q[:, 1])
        near = e < INLIER
        return int(near.sum()), float((e[near] ** 2).sum()), near

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["block_y", "block_x"])
        p, q = pdf[["px", "py"]].to_numpy(), pdf[["qx", "qy"]].to_numpy()
        n, best = len(p), None
        if n >= 5 * k:
            for places in _sampled(n, k, TRIALS):
                m = _solve(p[places], q[places], kind)
                if m is not None:
                    c, e, near = score(m, p, q)
                    if best is None or (c, -e) > (best[0], -best[1]):
                        best = (c, e, near, m)
            if best is not None and best[0] < max(n // 10, k):
                best = None
            for _ in range(REFITS):
                if best is None:
                    break
                m = _solve(p[best[2]], q[best[2]], kind)
                if m is None:
                    break
                c, e, near = score(m, p, q)
                if (c, -e) <= (best[0], -best[1]):
                    break
                grew, best = c > best[0], (c, e, near, m)
                if not grew:  # less error with as many inliers is taken, and ends the refits
                    break
        row = {"frame": pdf["frame"].iloc[0], "algorithm": pdf["algorithm"].iloc[0], "ok": best is not None, "inliers": best[0] if best else 0, "total": n, "rms": float(np.sqrt(best[1] / best[0])) if best and best[0] else 0.0}
        model = best[3] if best else np.array([0, 0, 1, 0, 0, 1.0])
        return pd.DataFrame([row | {f"p{i}": float(model[i]) for i in range(6)}])

    kinds = dict(points.dtypes)
    return points.groupBy(*_KEYS).applyInPandas(run, f"frame {kinds['frame']}, algorithm {kinds['algorithm']}, ok boolean, inliers long, total long, rms double, " + ", ".join(f"p{i} double" for i in range(6)))


def model_field(models: DataFrame, width: int, height: int, size: int) -> DataFrame:
    """The model's vector at the centre of every block of the padded grid."""
    rows, cols = -(-height // 64) * 64, -(-width // 64) * 64
    at = models.select(*_KEYS, *[f"p{i}" for i in range(6)], F.explode(F.sequence(F.lit(0), F.lit(rows - size), F.lit(size))).alias("y")).select("*", F.explode(F.sequence(F.lit(0), F.lit(cols - size), F.lit(size))).alias("x"))
    cx, cy = F.col("x") + size / 2, F.col("y") + size / 2
    mx = round_half_away((F.col("p0") + F.col("p2") * cx + F.col("p3") * cy - cx) * 8)
    my = round_half_away((F.col("p1") + F.col("p4") * cx + F.col("p5") * cy - cy) * 8)
    return at.select(*_KEYS, "x", "y", mx.alias("mv_x_q8"), my.alias("mv_y_q8"))


def _gate_columns(g1_num: Column | int, g1_den: Column | int, g2: Column | int) -> dict[str, Column]:
    """Axis gates, the pair gate, and for each axis whether the pair beats itself without that axis."""
    best = F.col("sad2d_best") * g2
    own = {f"gate_{a}": (F.col(f"d{a}_coarse") != 0) & (F.col(f"cost_best_{a}") * g1_num < F.col(f"cost_zero_{a}") * g1_den) for a in "xy"}
    pair = {"gate_pair": best < F.col("sad2d_zero")} | {f"gate_pair_{a}": best < F.col(f"sad2d_no_{a}") for a in "xy"}
    return own | pair | {f"accept_{a}": own[f"gate_{a}"] & pair["gate_pair"] & pair[f"gate_pair_{a}"] for a in "xy"}


def gates(windows: DataFrame, g1_num: int = 16, g1_den: int = 15, g2: int = 2) -> DataFrame:
    """The gates and `accept_x`, `accept_y` from stored costs: thresholds can be tuned without a new search."""
    return windows.withColumns(_gate_columns(g1_num, g1_den, g2))


def gate_sweep(windows: DataFrame, settings: DataFrame) -> DataFrame:
    """settings (g1_num, g1_den, g2): accepted axes of all axes under each; the settings are a fixed short list."""
    s = windows.crossJoin(F.broadcast(settings)).withColumns(_gate_columns(F.col("g1_num"), F.col("g1_den"), F.col("g2")))
    return s.groupBy("g1_num", "g1_den", "g2").agg(_accepted_axes().alias("accepted"), (2 * F.count("*")).alias("axes"))


def _accepted_axes() -> Column:
    return F.sum(F.col("accept_x").cast("long") + F.col("accept_y").cast("long"))


def accepted_vectors(gated: DataFrame) -> DataFrame:
    """kind `used`: the vector of a window with an accepted axis, a rejected axis as 0; kind `raw`: the vector as found where an axis was rejected. Both with how many axes were accepted."""
    accepted = (F.col("accept_x").cast("int") + F.col("accept_y").cast("int")).alias("accepted")
    used = gated.where("accept_x OR accept_y").select("poc", "win_i", "win_j", *[F.when(F.col(f"accept_{a}"), F.col(f"d{a}_qpel")).otherwise(0).alias(f"d{a}_qpel") for a in "xy"], accepted, F.lit("used").alias("kind"))
    raw = gated.where("NOT (accept_x AND accept_y)").select("poc", "win_i", "win_j", "dx_qpel", "dy_qpel", accepted, F.lit("raw").alias("kind"))
    return used.unionByName(raw)


def window_rect(frames: DataFrame, width: int, height: int, n: int) -> DataFrame:
    """The 4 x 4 windows of a picture, measured on its 1 / 2^n size and scaled back; the last row and column reach the edge."""
    w, h = (width >> n) // 4, (height >> n) // 4
    r = frames.select("*", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("k")).withColumns({"i": F.floor(F.col("k") / 4), "j": F.col("k") % 4})
    right = F.when(F.col("j") == 3, F.lit(width)).otherwise((F.col("j") + 1) * w * (1 << n))
    bottom = F.when(F.col("i") == 3, F.lit(height)).otherwise((F.col("i") + 1) * h * (1 << n))
    return r.withColumns({"x": F.col("j") * w * (1 << n), "y": F.col("i") * h * (1 << n)}).withColumns({"w": right - F.col("x"), "h": bottom - F.col("y")}).drop("k")


def frame_summary(gated: DataFrame) -> DataFrame:
    """By frame: accepted axes, the upper median of their displacements in whole pixels (null without any), and how far refinement moved a vector at most."""
    full = {a: F.floor(F.col(f"d{a}_qpel") / 4) for a in "xy"}
    found = [F.sort_array(F.collect_list(F.when(F.col(f"accept_{a}"), full[a]))).alias(f"all_{a}") for a in "xy"]
    counts = [F.sum(F.col(f"accept_{a}").cast("long")).alias(f"accepted_{a}") for a in "xy"]
    g = gated.groupBy("poc").agg(*counts, *found, F.max(F.greatest(*[F.abs(full[a] - F.col(f"d{a}_coarse")) for a in "xy"])).alias("moved"))
    median = [F.try_element_at(f"all_{a}", (F.floor(F.size(f"all_{a}") / 2) + 1).cast("int")).alias(f"median_d{a}") for a in "xy"]
    return g.select("poc", "accepted_x", "accepted_y", *median, "moved")


def totals(gated: DataFrame) -> DataFrame:
    """Accepted axes of all axes, two a window."""
    return gated.agg(_accepted_axes().alias("accepted"), (2 * F.count("*")).alias("axes"))


def candidate_search(cur: DataFrame, ref: DataFrame, size: int, reach: int, key: str = "frame") -> DataFrame:
    """The cheapest displacement of every block and how many displacements stay inside the picture: key, block_y, block_x, cost, dy, dx, candidates."""
    best = block_match(cur, ref, size, reach, key)
    edge = cur.groupBy(key).agg((F.max("y") + 1).alias("rows"), (F.max("x") + 1).alias("columns"))
    room = lambda at, end: F.least(F.lit(reach), F.col(at) * size) + F.greatest(F.lit(0), F.least(F.lit(reach), F.col(end) - F.col(at) * size - size)) + 1
    return best.join(edge, key).select(*best.columns, (room("block_y", "rows") * room("block_x", "columns")).alias("candidates"))
