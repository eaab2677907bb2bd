"""Rate-distortion operators: totals, curves, polynomial fits and Bjontegaard-delta rate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import psnr_from_sse, rate_axis

SUMS = (("bits", "bits"), ("sse", "sse"), ("samples", "samples"))


def _sums() -> list[Column]:
    return [F.sum(c).alias(n) for c, n in SUMS]


def _with_psnr(df: DataFrame) -> DataFrame:
    """PSNR from summed errors, never a mean of decibels."""
    return df.withColumn("psnr", psnr_from_sse("sse", "samples"))


def frame_totals(samples: DataFrame) -> DataFrame:
    return _with_psnr(samples.groupBy("frame", "grp", "point").agg(*_sums()))


def sequence_totals(samples: DataFrame, first: int | None = None, last: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Totals over a range of frames for each group and point, or for each `by` (the superblock) too."""
    if first is not None:
        samples = samples.where(F.col("frame") >= first)
    if last is not None:
        samples = samples.where(F.col("frame") <= last)
    return _with_psnr(samples.groupBy(*by, "grp", "point").agg(*_sums()))


def totals_cube(samples: DataFrame) -> DataFrame:
    """Frame, superblock and sequence totals in one pass, told apart by `level`."""
    sets = [[F.col("frame"), F.col("grp"), F.col("point")], [F.col("sb_row"), F.col("sb_col"), F.col("grp"), F.col("point")], [F.col("grp"), F.col("point")]]
    out = samples.groupingSets(sets, "frame", "sb_row", "sb_col", "grp", "point").agg(F.grouping("frame").alias("no_frame"), F.grouping("sb_row").alias("no_sb"), *_sums())
    return _with_psnr(out.withColumn("level", F.when(F.col("no_frame") == 0, "frame").when(F.col("no_sb") == 0, "block").otherwise("sequence")).drop("no_frame", "no_sb"))


def common_range(frames: DataFrame, stream: tuple[str, ...] = ("grp", "point")) -> DataFrame:
    """The frames that every stream has: one row (first, last, status)."""
    each = frames.groupBy(*stream).agg(F.min("frame").alias("a"), F.max("frame").alias("b"))
    return each.agg(F.max("a").alias("first"), F.min("b").alias("last")).withColumn("status", F.when(F.col("first") <= F.col("last"), "ok").otherwise("empty"))


def complete_frames(samples: DataFrame, stream: tuple[str, ...] = ("grp", "point")) -> DataFrame:
    """Frames of a stream in which every superblock has its error."""
    return samples.groupBy(*stream, "frame").agg(F.count("*").alias("blocks"), F.count("sse").alias("known")).where("blocks = known").select(*stream, "frame", "blocks")


def curve(totals: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Points (rate, psnr) of each curve: known PSNR, rate above zero, of equal PSNR the lowest rate."""
    points = totals.where((F.col("samples") > 0) & F.col("psnr").isNotNull()).withColumn("rate", rate_axis("bits")).where("rate > 0")
    return points.groupBy(*keys, "psnr").agg(F.min("rate").alias("rate"), F.max("samples").alias("samples"))


def moments(x: Column, y: Column, degree: int = 3) -> list[Column]:
    """Sums that a fit of this degree needs; they combine before the shuffle."""
    power = lambda k: F.lit(1.0) if k == 0 else x if k == 1 else F.pow(x, F.lit(float(k)))
    return [F.sum(power(k)).alias(f"s{k}") for k in range(2 * degree + 1)] + [F.sum(power(k) * y).alias(f"t{k}") for k in range(degree + 1)]


def solve_moments(df: DataFrame, degree: Column | int, prefix: str = "", most: int = 3) -> DataFrame:
    """Adds coefficients {prefix}c0.. from moment columns {prefix}s*, {prefix}t* by elimination; null where a pivot vanishes or points are too few.

    Rows and columns beyond the degree are those of the identity, so one elimination serves every degree up to `most`.
    """
    n = most + 1
    d = F.lit(degree) if isinstance(degree, int) else degree
    m = {(i, j): F.when(d >= max(i, j), F.col(f"{prefix}s{i + j}")).otherwise(1.0 if i == j else 0.0) for i in range(n) for j in range(n)}
    df = df.withColumns({f"{prefix}m{i}{j}": m[i, j] for i in range(n) for j in range(n)} | {f"{prefix}b{i}": F.when(d >= i, F.col(f"{prefix}t{i}")).otherwise(0.0) for i in range(n)})
    at = lambda i, j: F.col(f"{prefix}m{i}{j}")
    for k in range(n - 1):
        step = {}
        for i in range(k + 1, n):
            f = at(i, k) / F.when(F.abs(at(k, k)) >= 1e-12, at(k, k))
            step |= {f"{prefix}m{i}{j}": at(i, j) - f * at(k, j) for j in range(k + 1, n)}
            step[f"{prefix}b{i}"] = F.col(f"{prefix}b{i}") - f * F.col(f"{prefix}b{k}")
        df = df.withColumns(step)
    for i in range(n - 1, -1, -1):
        rest = F.col(f"{prefix}b{i}")
        for j in range(i + 1, n):
            rest = rest - at(i, j) * F.col(f"{prefix}c{j}")
        df = df.withColumn(f"{prefix}c{i}", rest / F.when(F.abs(at(i, i)) >= 1e-12, at(i, i)))
    return df.drop(*[f"{prefix}m{i}{j}" for i in range(n) for j in range(n)], *[f"{prefix}b{i}" for i in range(n)], *[f"{prefix}s{k}" for k in range(2 * n - 1)], *[f"{prefix}t{k}" for k in range(n)])


def fitted_mean(df: DataFrame, points: str, degree: Column, most: int = 3) -> DataFrame:
    """Adds `mean`: that over [-1, 1] of the least-squares polynomial through an array of points (u, y); null where points do not fix the degree.

    The basis is orthogonal over the points themselves (each term from the two before it), so no normal equations are formed and nearly equal
    points cost no digits; two Gauss-Legendre places give the mean of a cubic exactly.
    """
    names = [c for c in df.columns if c != points]
    fold = lambda c, term: F.aggregate(c, F.lit(0.0), lambda acc, p: acc + term(p))
    root = 3**-0.5
    state = {"_at": F.transform(points, lambda p: F.struct(p["u"].alias("u"), p["y"].alias("y"), F.lit(0.0).alias("old"), F.lit(1.0).alias("now")))}
    state |= {f"_{n}{i}": F.lit(v) for i in (0, 1) for n, v in (("old", 0.0), ("now", 1.0), ("sum", 0.0))} | {"_size": F.lit(1.0)}
    df = df.select(*names, *[c.alias(n) for n, c in state.items()])
    for k in range(most + 1):
        df = df.withColumn("_square", fold("_at", lambda p: p["now"] * p["now"]))
        good = F.when(F.col("_square") >= 1e-12, F.col("_square"))
        share = fold("_at", lambda p: p["y"] * p["now"]) / good
        df = df.withColumns({"_share": share, "_shift": fold("_at", lambda p: p["u"] * p["now"] * p["now"]) / good, "_ratio": F.lit(0.0) if k == 0 else good / F.col("_size")})
        # Terms beyond the degree are not looked at: too few points leave them null.
        step = {f"_sum{i}": F.when(degree >= k, F.col(f"_sum{i}") + F.col("_share") * F.col(f"_now{i}")).otherwise(F.col(f"_sum{i}")) for i in (0, 1)}
        if k < most:
            step |= {f"_now{i}": (F.lit(x) - F.col("_shift")) * F.col(f"_now{i}") - F.col("_ratio") * F.col(f"_old{i}") for i, x in ((0, -root), (1, root))}
            step |= {f"_old{i}": F.col(f"_now{i}") for i in (0, 1)}
            step["_at"] = F.transform("_at", lambda p: F.struct(p["u"].alias("u"), p["y"].alias("y"), p["now"].alias("old"), ((p["u"] - F.col("_shift")) * p["now"] - F.col("_ratio") * p["old"]).alias("now")))
            step["_size"] = F.col("_square")
        df = df.withColumns(step)
    return df.select(*names, ((F.col("_sum0") + F.col("_sum1")) / 2).alias("mean"))


def poly_fit(points: DataFrame, keys: tuple[str, ...], x: str, y: str, degree: int) -> DataFrame:
    """Least squares about the mean of x: keys, n, centre and coefficients c0.. (of x - centre); null with fewer than degree + 1 points."""
    centre = points.groupBy(*keys).agg(F.avg(x).alias("centre"))
    sums = points.join(centre, list(keys)).groupBy(*keys, "centre").agg(F.count("*").alias("n"), *moments(F.col(x) - F.col("centre"), F.col(y), degree))
    out = solve_moments(sums, degree, most=degree)
    return out.withColumns({f"c{i}": F.when(F.col("n") > degree, F.col(f"c{i}")) for i in range(degree + 1)})


def poly_eval(coefficients: Column, x: Column) -> Column:
    """Horner's rule over an array of coefficients, lowest power first."""
    return F.aggregate(F.reverse(coefficients), F.lit(0.0), lambda acc, c: acc * x + c)


def fit_points(fits: DataFrame, keys: tuple[str, ...], degree: int, low: Column, high: Column, steps: int) -> DataFrame:
    """The fitted curve at steps + 1 places between low and high."""
    each = fits.select(*keys, "centre", F.array(*[F.col(f"c{i}") for i in range(degree + 1)]).alias("c"), low.alias("low"), high.alias("high"), F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("step"))
    at = F.col("low") + (F.col("high") - F.col("low")) * F.col("step") / steps
    return each.withColumn("x", at).select(*keys, "step", "x", poly_eval(F.col("c"), F.col("x") - F.col("centre")).alias("y"))


def anchor_pairs(curves: DataFrame, anchor: str, keys: tuple[str, ...]) -> DataFrame:
    """Every other group of a region against the anchor's curve of that region."""
    a = curves.where(F.col("grp") == anchor).select(*keys, F.struct("rate", "psnr").alias("anchor_point"))
    t = curves.where(F.col("grp") != anchor).select(*keys, F.col("grp").alias("test"), F.struct("rate", "psnr").alias("test_point"))
    return t.join(a, list(keys))


def join_bits_sse(bits: DataFrame, sse: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """One point a block: bits from the bitstream, error from the pictures."""
    return bits.join(sse, list(keys))


def _compared(curves: DataFrame, anchor: str, keys: tuple[str, ...], regions: DataFrame | None) -> DataFrame:
    """bd_rate's columns, `samples` of the anchor and each side's largest rate and PSNR.

    A region's curves are gathered once - a few points a group - and every test group is then worked on beside the anchor's array: spans, sums
    and tops are folds over arrays of points, so that nothing is joined.
    """
    every = curves.select(*keys, "grp", F.struct("psnr", "rate", "samples").alias("p"))
    if regions is not None:
        every = every.unionByName(regions.select(*keys, "grp", F.lit(None).cast(every.schema["p"].dataType).alias("p")))
    region = every.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(F.col("p").isNotNull(), F.struct("grp", "p")))).alias("points"), F.collect_set("grp").alias("names"))
    side = lambda g: F.transform(F.filter("points", lambda e: e["grp"] == g), lambda e: e["p"])
    pair = region.select(*keys, "points", F.explode(F.filter("names", lambda g: g != anchor)).alias("test")).select(*keys, "test", side(F.lit(anchor)).alias("a"), side(F.col("test")).alias("b"))
    of = lambda pick, c, name: pick(F.transform(c, lambda p: p[name]))
    numbers = {"n_a": F.size("a").cast("long"), "n_b": F.size("b").cast("long"), "samples": of(F.array_max, "a", "samples")}
    numbers |= {f"{kind}_{s}_{end}": of(pick, s, col) for s in "ab" for kind, col, end, pick in (("bits", "rate", "max", F.array_max), ("psnr", "psnr", "max", F.array_max), ("psnr", "psnr", "min", F.array_min))}
    pair = pair.withColumns(numbers)
    pair = pair.withColumns({"degree": F.least(F.lit(3), F.col("n_a") - 1, F.col("n_b") - 1), "psnr_lo": F.greatest("psnr_a_min", "psnr_b_min"), "psnr_hi": F.least("psnr_a_max", "psnr_b_max")})
    early = F.when((F.col("n_a") == 0) | (F.col("n_b") == 0), "Degenerate").when(F.col("degree") < 1, "NotEnoughPoints").when(F.col("psnr_hi") <= F.col("psnr_lo"), "NoPsnrOverlap")
    pair = pair.withColumn("early", early)
    # u runs from -1 to 1 over the overlap, where the mean of a cubic is c0 + c2 / 3.
    half = F.when(F.col("early").isNull(), (F.col("psnr_hi") - F.col("psnr_lo")) / 2)
    place = lambda p: F.struct(((p["psnr"] - (F.col("psnr_lo") + F.col("psnr_hi")) / 2) / half).alias("u"), F.log10(p["rate"]).alias("y"))
    # Both curves of a pair are fitted beside each other and meet again without a shuffle: they stay where their region is.
    kept = [c for c in pair.columns if c not in (*keys, "test", "a", "b")]
    both = pair.select(*keys, "test", "degree", F.struct(*kept).alias("kept"), F.posexplode(F.array(F.transform("a", place), F.transform("b", place))).alias("side", "at"))
    mean = fitted_mean(both, "at", F.col("degree"))
    side_mean = lambda i: F.max(F.when(F.col("side") == i, F.col("mean")))
    out = mean.groupBy(*keys, "test").agg(F.first("kept").alias("kept"), ((F.pow(F.lit(10.0), side_mean(1) - side_mean(0)) - 1) * 100).alias("percent")).select(*keys, "test", "kept.*", "percent")
    good = F.col("early").isNull() & (F.abs("percent") < float("inf"))
    out = out.withColumn("percent", F.when(good, F.col("percent")))
    return out.withColumns({"status": F.coalesce("early", F.when(F.col("percent").isNull(), "Degenerate").otherwise("Ok")), "degree": F.greatest("degree", F.lit(0)).cast("long")})


def bd_rate(curves: DataFrame, anchor: str, keys: tuple[str, ...], regions: DataFrame | None = None) -> DataFrame:
    """keys, test, status, percent, degree, psnr_lo, psnr_hi, n_a, n_b for every region and non-anchor group.

    The mean distance of two fits of log10(rate) over PSNR, degree min(3, fewer points - 1), over the common PSNR range. A failed computation
    is a status: Degenerate (an empty side, or a fit that has no solution), NotEnoughPoints, NoPsnrOverlap. `regions` (keys, grp) adds
    groups without a single point. What of a region meets in one task is its points: one for each group and rate.
    """
    return _compared(curves, anchor, keys, regions).select(*keys, "test", "status", "percent", "degree", *_lost(("psnr_lo", "psnr_hi")), "n_a", "n_b")


def _lost(names: tuple[str, ...]) -> list[Column]:
    """An overlap has two sides."""
    return [F.when((F.col("n_a") > 0) & (F.col("n_b") > 0), F.col(c)).alias(c) for c in names]


def bd_rate_report(samples: DataFrame, anchor: str, keys: tuple[str, ...] = ("sb_row", "sb_col")) -> DataFrame:
    """BD-rate of every group against the anchor for each superblock, with the largest rate and PSNR of both sides and the anchor's samples."""
    totals = sequence_totals(samples, by=keys)
    report = _compared(curve(totals, (*keys, "grp")), anchor, keys, totals)
    return report.select(*keys, "test", "status", "percent", "degree", *_lost(("psnr_lo", "psnr_hi")), "n_a", "n_b", "bits_a_max", "psnr_a_max", "samples", "bits_b_max", "psnr_b_max")


def undefined_count(report: DataFrame) -> DataFrame:
    return report.groupBy("status").agg(F.count("*").alias("regions"))


def validate_groups(dim: DataFrame) -> DataFrame:
    """One row for each broken rule: (grp, rule). dim: grp, point (null: the group has no stream), width, height, sb_size, original, bits_known."""
    each = dim.groupBy("grp").agg(F.count("point").alias("points"), F.count_distinct("width", "height", "sb_size").alias("shapes"), F.min(F.struct("width", "height", "sb_size")).alias("shape"), F.max(F.col("original").cast("int")).alias("original"), F.sum((~F.col("bits_known")).cast("int")).alias("missing"))
    first = each.agg(F.min_by("shape", "grp").alias("first_shape"))
    ranked = each.crossJoin(F.broadcast(first))
    rules = F.array(
        F.when(F.col("points") == 0, "no streams"), F.when(F.col("points") == 1, "one point"), F.when(F.col("shapes") > 1, "mixed geometry"),
        F.when((F.col("shapes") == 1) & (F.col("shape") != F.col("first_shape")), "other geometry than the first group"), F.when(F.col("missing") > 0, "missing bits"),
    )
    found = ranked.select(F.col("grp").cast("string").alias("grp"), F.explode(F.array_compact(rules)).alias("rule"))
    originals = each.agg(F.sum("original").alias("n")).where("n <> 1").select(F.lit("*").alias("grp"), F.lit("not exactly one original").alias("rule"))
    return found.unionByName(originals)


def group_name(names: DataFrame, key: str, name: str) -> DataFrame:
    """key, group_name: longest common prefix of the names, trailing `_ - . q Q` trimmed, shorter than two characters: Group N; one name: its base name."""
    g = names.groupBy(key).agg(F.count("*").alias("n"), F.min(name).alias("a"), F.max(name).alias("b"))
    # The common prefix of all is that of the first and the last in order.
    same = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length("a"), F.length("b")))), F.lit(0), lambda acc, i: F.when((acc == i - 1) & (F.col("a").substr(i, F.lit(1)) == F.col("b").substr(i, F.lit(1))), i).otherwise(acc))
    prefix = F.regexp_replace(F.substring(F.col("a"), F.lit(1), same), "[_.qQ-]+$", "")
    order = F.row_number().over(Window.orderBy(key))
    base = F.regexp_replace(F.regexp_extract("a", "([^/]*)$", 1), r"\.[^.]*$", "")
    return g.select(key, F.when(F.col("n") == 1, base).when(F.length(prefix) >= 2, prefix).otherwise(F.concat(F.lit("Group "), order.cast("string"))).alias("group_name"))


def unique_names(names: DataFrame, name: str, directory: str, order: str) -> DataFrame:
    """`unique_name`: the name; where taken, the directory's; where that is taken too, the name with (2), (3), ..."""
    w = Window.partitionBy(name).orderBy(order)
    first = names.withColumn("k", F.row_number().over(w)).withColumn("wanted", F.when(F.col("k") == 1, F.col(name)).otherwise(F.col(directory)))
    again = first.withColumn("k2", F.row_number().over(Window.partitionBy("wanted").orderBy((F.col("k") > 1).cast("int"), order)))
    kept = again.withColumn("lost", (F.col("k2") > 1).cast("int"))
    number = F.sum("lost").over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1
    return kept.withColumn("unique_name", F.when(F.col("lost") == 0, F.col("wanted")).otherwise(F.concat(F.col(name), F.lit(" ("), number.cast("string"), F.lit(")")))).drop("k", "k2", "wanted", "lost")


def dump_completeness(samples: DataFrame) -> DataFrame:
    """Combinations of superblock, frame, group and point that the dump lacks.

    The lists of all frames and of all streams are one row that every task gets; a superblock is held against the first by the frames it has, each
    frame of it against the second by its streams. Only what is missing is spread out.
    """
    streams, block = F.struct("grp", "point"), ["sb_row", "sb_col"]
    every = samples.agg(F.collect_set("frame").alias("frames"), F.collect_set(streams).alias("streams"))
    frames = samples.groupBy(*block, "frame").agg(F.collect_set(streams).alias("own"))
    held = frames.crossJoin(F.broadcast(every)).select(*block, "frame", F.explode(F.array_except("streams", "own")).alias("s"))
    blocks = samples.groupBy(*block).agg(F.collect_set("frame").alias("own"))
    none = blocks.crossJoin(F.broadcast(every)).select(*block, "streams", F.explode(F.array_except("frames", "own")).alias("frame")).select(*block, "frame", F.explode("streams").alias("s"))
    return held.unionByName(none).select(*block, "frame", "s.grp", "s.point")
