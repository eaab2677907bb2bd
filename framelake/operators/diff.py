"""Stream comparison: headers, payloads, bit windows, blocks and problems."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import read_bits
from . import align

MI = 4  # samples a side of a position


def pair_by_position(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Two ordered lists paired by ordinal; what is left over is OnlyInA or OnlyInB."""
    left = a.select(*keys, *[F.col(c).alias(f"{c}_a") for c in columns], F.lit(True).alias("in_a"))
    right = b.select(*keys, *[F.col(c).alias(f"{c}_b") for c in columns], F.lit(True).alias("in_b"))
    side = F.when(F.col("in_b").isNull(), "OnlyInA").when(F.col("in_a").isNull(), "OnlyInB").otherwise("Both")
    return left.join(right, keys, "full").withColumn("side", side).drop("in_a", "in_b")


CELLS = 4_000_000


def _steps(cells: int | None):
    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        found = []
        for na, nb in zip(left, right, strict=True):
            if not na.is_valid and not nb.is_valid:
                found.append(None)
                continue
            names = [*(na.as_py() or []), *(nb.as_py() or [])]
            codes, n = pd.factorize(np.array(names, dtype=object), use_na_sentinel=False)[0] if names else np.zeros(0, np.int64), len(na.as_py() or [])
            exact = cells is None or (n + 1) * (len(names) - n + 1) <= cells
            x, y = (align.common_subsequence if exact else align.resynchronised)(codes[:n], codes[n:])
            found.append({"a": x.tolist(), "b": y.tolist(), "degraded": not exact})
        return pa.array(found, pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32())), ("degraded", pa.bool_())]))

    return F.arrow_udf(run, "a array<int>, b array<int>, degraded boolean")


def aligned(a: DataFrame, b: DataFrame, cells: int | None = CELLS) -> DataFrame:
    """One row a section: side, left and right (its ordered elements: idx, name, value), steps (pairs of places in them, -1 for none), degraded.

    Elements are aligned by name: the longest common subsequence, at a mismatch the left element left out if that costs no pair. A section of
    more than `cells` table cells, (n + 1) (m + 1), is resynchronised within a window instead and marked degraded; with None none is.
    Sections whose ordered names are equal are paired by place in Spark; only the names of the others go to Python, a section at a time.
    """
    lists = lambda df, c: df.groupBy("section").agg(F.array_sort(F.collect_list(F.struct("idx", "name", "value"))).alias(c))
    both = lists(a, "left").join(lists(b, "right"), "section", "full")
    side = F.when(F.col("right").isNull(), "OnlyInA").when(F.col("left").isNull(), "OnlyInB").otherwise("Both")
    same = F.coalesce(F.col("left.name") == F.col("right.name"), F.lit(False))
    both = both.select("section", side.alias("side"), "left", "right", same.alias("same"))
    found = both.withColumn("found", _steps(cells)(F.when(~F.col("same"), F.col("left.name")), F.when(~F.col("same"), F.col("right.name"))))
    own = F.transform(F.sequence(F.lit(0), F.size("left") - 1), lambda i: F.struct(i.alias("a"), i.alias("b")))
    steps = F.when(F.col("same"), own).otherwise(F.transform(F.arrays_zip("found.a", "found.b"), lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"))))
    return found.select("section", "side", "left", "right", steps.alias("steps"), F.coalesce("found.degraded", F.lit(False)).alias("degraded"))


def _at(side: str, place: Column, field: str) -> Column:
    """A field of the element at a place of a side's list; null at -1."""
    return F.when(place >= 0, F.get(F.col(f"{side}.{field}"), place))


def align_names(a: DataFrame, b: DataFrame, cells: int | None = CELLS) -> DataFrame:
    """section, step, index_a, index_b, degraded: see `aligned`; a section of one side only has only unpaired steps."""
    rows = aligned(a, b, cells).select("section", "left", "right", "degraded", F.posexplode("steps").alias("step", "s"))
    return rows.select("section", F.col("step").cast("long").alias("step"), _at("left", F.col("s.a"), "idx").alias("index_a"), _at("right", F.col("s.b"), "idx").alias("index_b"), "degraded")


def _kind(s: Column) -> Column:
    """What a step of `aligned` is: OnlyInA, OnlyInB, ValueMismatch, or null for a pair of equal values."""
    differ = ~_at("left", s["a"], "value").eqNullSafe(_at("right", s["b"], "value"))
    return F.when(s["b"] < 0, "OnlyInA").when(s["a"] < 0, "OnlyInB").when(differ, "ValueMismatch")


def diff_elements(a: DataFrame, b: DataFrame, cells: int | None = CELLS) -> DataFrame:
    """ValueMismatch, OnlyInA and OnlyInB after alignment by name, in the sections that both sides have; pairs of equal values are left out."""
    rows = aligned(a, b, cells).where("side = 'Both'")
    steps = F.filter("steps", lambda s: _kind(s).isNotNull())
    rows = rows.select("section", "left", "right", F.explode(steps).alias("s"))
    at = {f"{f}_{x}": _at(side, F.col(f"s.{x}"), f) for side, x in (("left", "a"), ("right", "b")) for f in ("idx", "name", "value")}
    return rows.select("section", _kind(F.col("s")).alias("kind"), at["idx_a"].alias("index_a"), at["idx_b"].alias("index_b"), F.coalesce(at["name_a"], at["name_b"]).alias("name"), at["value_a"].alias("value_a"), at["value_b"].alias("value_b"))


def diff_sections(a: DataFrame, b: DataFrame, cells: int | None = CELLS) -> DataFrame:
    """section, side, differences, aligned_pairs, valuemismatch, onlyina, onlyinb, degraded of every section; one that a side lacks is one difference."""
    both = F.col("side") == "Both"
    kinds = F.transform("steps", _kind)
    count = lambda k: F.when(both, F.size(F.filter("kinds", lambda x: x == k))).otherwise(0).cast("long")
    rows = aligned(a, b, cells).withColumn("kinds", kinds)
    pairs = F.size(F.filter("steps", lambda s: (s["a"] >= 0) & (s["b"] >= 0))).cast("long")
    rows = rows.select("section", "side", F.when(both, pairs).otherwise(0).alias("aligned_pairs"), *[count(k).alias(k.lower()) for k in ("ValueMismatch", "OnlyInA", "OnlyInB")], (both & F.col("degraded")).alias("degraded"))
    return rows.select("section", "side", F.when(both, F.col("valuemismatch") + F.col("onlyina") + F.col("onlyinb")).otherwise(1).cast("long").alias("differences"), "aligned_pairs", "valuemismatch", "onlyina", "onlyinb", "degraded")


def diff_counts(sections: DataFrame) -> DataFrame:
    """Totals over the rows of `diff_sections`."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return sections.agg(*[total(c) for c in ("differences", "aligned_pairs", "valuemismatch", "onlyina", "onlyinb")], F.count_if(F.col("differences") > 0).alias("sections"), F.count_if(F.col("side") != "Both").alias("missing_sections"), F.count_if("degraded").alias("degraded_sections"))


def first_difference(rows: DataFrame, keys: list[str], order: list[str], real: Column | None = None) -> DataFrame:
    """The first real difference of each key in order; gaps (Unreadable, Missing) are none."""
    rows = rows if real is None else rows.where(real)
    rest = [c for c in rows.columns if c not in (*keys, *order)]
    best = rows.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("d"))
    return best.select(*keys, *[F.col(f"d.{c}").alias(c) for c in (*order, *rest)])


def first_differing(a: Column, b: Column) -> Column:
    """0-based place of the first difference of two strings or binaries, the shorter length where one starts the other; null when equal.

    Pieces are halved: heads of a power of two that are alike are dropped and counted, of others only the heads are kept. Every step looks at
    half as much as the one before, so that a pair takes time linear in its length.
    """
    top = F.floor(F.log2(F.greatest(F.length(a), F.length(b), F.lit(1)))).cast("int")
    halves = F.transform(F.sequence(top, F.lit(0), F.lit(-1)), lambda k: F.call_function("shiftleft", F.lit(1), k))
    start = F.struct(a.alias("a"), b.alias("b"), F.lit(0).alias("at"))

    def halve(s: Column, half: Column) -> Column:
        heads, tails = [[F.substring(s[c], begin, length) for c in "ab"] for begin, length in ((F.lit(1), half), (half + 1, F.lit(2**31 - 1)))]
        kept = lambda pieces, at: F.struct(pieces[0].alias("a"), pieces[1].alias("b"), at.alias("at"))
        return F.when(heads[0] == heads[1], kept(tails, s["at"] + half)).otherwise(kept(heads, s["at"]))

    return F.when(a != b, F.aggregate(halves, start, halve, lambda s: s["at"]).cast("long"))


def diff_payloads(a: DataFrame, b: DataFrame) -> DataFrame:
    """Units paired by ordinal; equal pairs left out: SizeDiffers, ContentDiffers, OnlyInA, OnlyInB and the first differing place."""
    p = pair_by_position(a, b, ["ordinal"], ["unit_type", "payload"])
    d = p.where((F.col("side") != "Both") | (F.col("payload_a") != F.col("payload_b")))
    kind = F.when(F.col("side") != "Both", F.col("side")).when(F.length("payload_a") != F.length("payload_b"), "SizeDiffers").otherwise("ContentDiffers")
    return d.select("ordinal", kind.alias("kind"), first_differing(F.col("payload_a"), F.col("payload_b")).alias("first_byte"))


def pair_by_raster(a: DataFrame, b: DataFrame) -> DataFrame:
    return pair_by_position(a, b, ["frame", "y", "x"], ["start_bit"])


def positions_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("frame", "y", "x").union(b.select("frame", "y", "x")).distinct()


def diff_bit_windows(probes_a: DataFrame, data_a: DataFrame, probes_b: DataFrame, data_b: DataFrame, bits: int = 24) -> DataFrame:
    """Equal, Differ, Unreadable or Missing for every probed position of either stream. data: frame, data."""
    p = pair_by_raster(probes_a, probes_b).join(data_a.select("frame", F.col("data").alias("data_a")), "frame", "left").join(data_b.select("frame", F.col("data").alias("data_b")), "frame", "left")
    wa, wb = read_bits("data_a", "start_bit_a", bits), read_bits("data_b", "start_bit_b", bits)
    state = F.when(F.col("side") != "Both", "Missing").when(F.col("wa").isNull() | F.col("wb").isNull(), "Unreadable").when(F.col("wa") == F.col("wb"), "Equal").otherwise("Differ")
    return p.withColumns({"wa": wa, "wb": wb}).select("frame", "y", "x", state.alias("state"))


def probe_blocks(blocks: DataFrame, base: Column, sb: int) -> DataFrame:
    """Earliest bit position of each superblock, counted from `base`; positions before it are dropped."""
    b = blocks.withColumn("start", F.col("bit_start") - base).where("start >= 0")
    return b.groupBy("frame", F.floor(F.col("y") / sb).alias("sb_row"), F.floor(F.col("x") / sb).alias("sb_col")).agg(F.min("start").alias("start_bit"))


CELL = 64  # samples a side of the cells by which blocks are dealt


def _celled(blocks: DataFrame, width: Column, height: Column, cell: Column) -> DataFrame:
    """Blocks that reach into the picture, once for each cell (`sb_row`, `sb_col`) that they touch; a block rarely touches more than one."""
    touched = lambda at, size, edge: F.sequence(F.floor(F.col(at) / cell), F.floor((F.least(F.col(at) + F.col(size), edge) - 1) / cell))
    inside = blocks.where((F.col("x") < width) & (F.col("y") < height) & (F.col("w") > 0) & (F.col("h") > 0))
    return inside.select("*", F.explode(touched("y", "h", height)).alias("sb_row")).select("*", F.explode(touched("x", "w", width)).alias("sb_col"))


def _opened(rows: DataFrame, width: Column, height: Column, cell: Column) -> DataFrame:
    """Rows of `_celled` once for each position of their cell that they cover, `mi_row` and `mi_col`."""

    def places(at: str, size: str, edge: Column, sb: str) -> Column:
        first = F.greatest(F.floor(F.col(at) / MI), F.floor(F.col(sb) * cell / MI))
        last = F.floor((F.least(F.col(at) + F.col(size), edge, (F.col(sb) + 1) * cell) - 1) / MI)
        return F.explode(F.sequence(first, last))

    return rows.select("*", places("y", "h", height, "sb_row").alias("mi_row")).select("*", places("x", "w", width, "sb_col").alias("mi_col"))


def mi_grid(blocks: DataFrame, width: int, height: int) -> DataFrame:
    """Every position with the block that answers first (by bit_start, then place), clipped to the picture.

    Blocks are dealt by cells of CELL samples and opened to positions behind the shuffle.
    """
    size = F.lit(width), F.lit(height), F.lit(CELL)
    dealt = _celled(blocks, *size).repartition("frame", "sb_row", "sb_col")
    rest = [c for c in blocks.columns if c not in ("frame", "bit_start", "y", "x")]
    first = _opened(dealt, *size).groupBy("frame", "sb_row", "sb_col", "mi_row", "mi_col").agg(F.min(F.struct("bit_start", "y", "x", *rest)).alias("b"))
    return first.select("frame", "mi_row", "mi_col", *[F.col(f"b.{c}").alias(c) for c in blocks.columns if c != "frame"])


def _cell_masks(blocks: DataFrame, width: int, height: int) -> DataFrame:
    """Rows of `_celled` with the positions of their cell that they cover as bits of four longs, `m0` to `m3`, of four rows of positions each."""
    side = CELL // MI

    def ends(at: str, size: str, edge: int, sb: str) -> tuple[Column, Column]:
        first = F.greatest(F.floor(F.col(at) / MI) - F.col(sb) * side, F.lit(0))
        last = F.floor((F.least(F.col(at) + F.col(size), F.lit(edge), (F.col(sb) + 1) * CELL) - 1) / MI) - F.col(sb) * side
        return first.cast("int"), last.cast("int")

    (top, bottom), (left, right) = ends("y", "h", height, "sb_row"), ends("x", "w", width, "sb_col")
    one = F.lit(1).cast("long")
    shifted = lambda v, n: F.call_function("shiftleft", v, n)
    rows = _celled(blocks, F.lit(width), F.lit(height), F.lit(CELL)).withColumns({"_top": top, "_bottom": bottom, "_line": shifted(shifted(one, right - left + 1) - one, left)})
    masks = {f"m{k}": sum((F.when(F.lit(4 * k + j).between(F.col("_top"), F.col("_bottom")), F.shiftleft("_line", 16 * j)).otherwise(0) for j in range(4)), F.lit(0).cast("long")) for k in range(4)}
    return rows.select("frame", "sb_row", "sb_col", "y", "x", *[m.alias(n) for n, m in masks.items()])


_MASKS = ("m0", "m1", "m2", "m3")


def _bits(columns: list[str]) -> Column:
    return F.coalesce(F.sum(sum((F.bit_count(c) for c in columns[1:]), F.bit_count(columns[0]))), F.lit(0))


def coverage(blocks: DataFrame, width: int, height: int, least: float = 95.0) -> DataFrame:
    """Percent of positions covered by frame, and whether the dump is complete. A cell is one row of 256 bits, not of positions."""
    total = -(-width // MI) * -(-height // MI)
    cells = _cell_masks(blocks, width, height).groupBy("frame", "sb_row", "sb_col").agg(*[F.bit_or(m).alias(m) for m in _MASKS])
    n = cells.groupBy("frame").agg(_bits(list(_MASKS)).alias("covered"))
    return n.withColumn("percent", F.col("covered") * 100.0 / total).withColumn("complete", F.col("percent") >= least)


def tiling_check(blocks: DataFrame, width: int, height: int) -> DataFrame:
    """Holes, overlaps and singly covered positions of every frame, and blocks given twice.

    Blocks of a cell are gone through once: the bits of those before tell which positions a block covers again. Holes are what is left of
    the picture, so that no grid is made.
    """
    total = -(-width // MI) * -(-height // MI)
    clipped = blocks.select("frame", *[F.greatest(at, F.lit(0)).alias(at) for at in ("x", "y")], *[(F.col(size) + F.least(at, F.lit(0))).alias(size) for at, size in (("x", "w"), ("y", "h"))])
    keys = ["frame", "sb_row", "sb_col"]
    before = Window.partitionBy(*keys).orderBy("y", "x").rowsBetween(Window.unboundedPreceding, -1)
    masks = _cell_masks(clipped, width, height).withColumns({f"again_{m}": F.col(m).bitwiseAND(F.coalesce(F.bit_or(m).over(before), F.lit(0))) for m in _MASKS})
    cells = masks.groupBy(*keys).agg(*[F.bit_or(c).alias(c) for m in _MASKS for c in (m, f"again_{m}")])
    c = cells.groupBy("frame").agg(_bits(list(_MASKS)).alias("covered"), _bits([f"again_{m}" for m in _MASKS]).alias("overlaps"))
    twice = blocks.where("frame IS NOT NULL").groupBy("frame", "x", "y", "w", "h").agg((F.count("*") - 1).alias("again")).groupBy("frame").agg(F.sum("again").alias("duplicates"))
    covered, overlaps = F.coalesce("covered", F.lit(0)), F.coalesce("overlaps", F.lit(0))
    return twice.join(c, "frame", "left").select("frame", (F.lit(total).cast("long") - covered).alias("holes"), overlaps.alias("overlaps"), (covered - overlaps).alias("single"), "duplicates")


def probe_sb_size(a: DataFrame, b: DataFrame) -> DataFrame:
    """128 if any block of either stream is wider or higher than 64, else 64."""
    return a.select("w", "h").unionByName(b.select("w", "h")).agg(F.when(F.max(F.greatest("w", "h")) > 64, 128).otherwise(64).alias("sb_size"))


def bit_range_check(blocks: DataFrame, packets: DataFrame) -> DataFrame:
    """Per frame: ranges that are empty or leave the packet, gaps between neighbours, percent covered, ok at 80. packets: frame, first_bit, last_bit."""
    w = Window.partitionBy("frame").orderBy("bit_start", "bit_end")
    b = blocks.join(packets, "frame").withColumn("next", F.lead("bit_start").over(w))
    good = F.col("bit_start") < F.col("bit_end")
    g = b.groupBy("frame", "first_bit", "last_bit").agg(F.count_if(~good).alias("empty"), F.count_if((F.col("bit_start") < F.col("first_bit")) | (F.col("bit_end") > F.col("last_bit"))).alias("outside"), F.count_if(F.col("next") > F.col("bit_end")).alias("gaps"), F.sum(F.when(good, F.col("bit_end") - F.col("bit_start")).otherwise(0)).alias("bits"))
    share = F.col("bits") * 100.0 / (F.col("last_bit") - F.col("first_bit"))
    return g.select("frame", "empty", "outside", "gaps", share.alias("percent"), (share >= 80).alias("ok"))


def bits_budget(blocks: DataFrame, frames: DataFrame, low: float = 70.0, high: float = 100.0) -> DataFrame:
    """Block bits of a frame as percent of its bits, and whether that lies within the bounds. frames: frame, bits."""
    s = blocks.groupBy("frame").agg(F.sum(F.col("bit_end") - F.col("bit_start")).alias("block_bits"))
    p = F.col("block_bits") * 100.0 / F.col("bits")
    return frames.join(s, "frame").select("frame", "block_bits", "bits", p.alias("percent"), p.between(low, high).alias("ok"))


def split_sb_values(blocks: DataFrame, names: tuple[str, ...], sb: int) -> tuple[DataFrame, DataFrame]:
    """(blocks without the values that describe a whole superblock, those values of each superblock's first block in raster order)."""
    parts = F.split("syntax", r"\|")
    mine = lambda e: F.substring_index(e, "=", 1).isin(*names)
    own = blocks.withColumn("syntax", F.array_join(F.filter(parts, lambda e: ~mine(e)), "|"))
    sbs = blocks.groupBy("frame", F.floor(F.col("y") / sb).alias("sb_row"), F.floor(F.col("x") / sb).alias("sb_col")).agg(F.min_by(F.array_join(F.filter(parts, mine), "|"), F.struct("y", "x")).alias("values"))
    return own, sbs


_RECT = ("x", "y", "w", "h")


def _compared(a: DataFrame, b: DataFrame, alike: bool) -> DataFrame:
    """Positions of both partitions (blocks with `width`, `height` and `sb` of their frame): frame, sb_row, sb_col, mi_row, mi_col, the answering
    blocks `a` and `b`, and `kind`, null where they agree. Superblocks whose blocks are the same in the same order are left out unless `alike`.

    A side's blocks of a superblock meet as one list, which is compared whole; the lists that differ are opened to positions where they
    are, so that only blocks are shuffled.
    """
    size = F.col("width"), F.col("height"), F.col("sb")
    keys = ["frame", "sb_row", "sb_col"]

    def lists(df: DataFrame, name: str) -> DataFrame:
        own = F.array_sort(F.collect_list(F.struct("bit_start", "y", "x", "w", "h", "syntax")))
        return _celled(df, *size).groupBy(*keys).agg(own.alias(name), F.first("width").alias(f"width_{name}"), F.first("height").alias(f"height_{name}"), F.first("sb").alias(f"sb_{name}"))

    both = lists(a, "a").join(lists(b, "b"), keys, "full")
    bare = lambda c: F.transform(c, lambda x: F.struct(*[x[f].alias(f) for f in (*_RECT, "syntax")]))
    if not alike:
        both = both.where(~F.coalesce(bare("a") == bare("b"), F.lit(False)))
    tagged = lambda c, i: F.transform(F.coalesce(c, F.array().cast(both.schema[c].dataType)), lambda x: F.struct(F.lit(i).alias("side"), x.alias("own")))
    sides = F.concat(tagged("a", 0), tagged("b", 1))
    each = both.select(*keys, *[F.coalesce(f"{c}_a", f"{c}_b").alias(c) for c in ("width", "height", "sb")], F.explode(sides).alias("block")).select(*keys, "width", "height", "sb", "block.side", "block.own", *[F.col(f"block.own.{c}").alias(c) for c in _RECT])
    at = _opened(each, *size).groupBy(*keys, "mi_row", "mi_col").agg(*[F.min(F.when(F.col("side") == i, F.col("own"))).alias(c) for i, c in enumerate("ab")])
    rect = lambda c: F.struct(*[F.col(f"{c}.{f}") for f in _RECT])
    kind = F.when(F.col("a").isNull(), "MissingInA").when(F.col("b").isNull(), "MissingInB").when(rect("a") != rect("b"), "GeometryDiffers").when(~F.col("a.syntax").eqNullSafe(F.col("b.syntax")), "SyntaxDiffers")
    return at.withColumn("kind", kind)


def _framed(blocks: DataFrame, width: int, height: int, sb: int) -> DataFrame:
    return blocks.withColumns({"width": F.lit(width), "height": F.lit(height), "sb": F.lit(sb)})


def _collapsed(positions: DataFrame) -> DataFrame:
    rect = lambda c: F.concat_ws(",", *[F.col(f"{c}.{f}").cast("string") for f in _RECT])
    d = positions.where("kind IS NOT NULL").withColumns({"rect_a": rect("a"), "rect_b": rect("b")})
    g = d.groupBy("frame", "sb_row", "sb_col", "kind", "rect_a", "rect_b").agg(F.min(F.struct("mi_row", "mi_col")).alias("first"), F.count("*").alias("positions"))
    return g.select("frame", "sb_row", "sb_col", "kind", "rect_a", "rect_b", F.col("first.mi_row").alias("mi_row"), F.col("first.mi_col").alias("mi_col"), "positions")


def diff_blocks(a: DataFrame, b: DataFrame, width: int, height: int, sb: int = 64) -> DataFrame:
    """Differences of two block partitions, collapsed inside a superblock: kind, both rectangles, first position and how many positions.

    Which block answers on a position that several cover depends on all of them, so a superblock is compared whole.
    """
    return _collapsed(_compared(_framed(a, width, height, sb), _framed(b, width, height, sb), False))


def block_counts(a: DataFrame, b: DataFrame, width: int, height: int, sb: int = 64) -> DataFrame:
    """frame, compared (positions that either side covers), differing, superblocks (that differ)."""
    at = _compared(_framed(a, width, height, sb), _framed(b, width, height, sb), True)
    each = at.groupBy("frame", "sb_row", "sb_col").agg(F.count("*").alias("compared"), F.count("kind").alias("differing"))
    return each.groupBy("frame").agg(F.sum("compared").alias("compared"), F.sum("differing").alias("differing"), F.count_if(F.col("differing") > 0).alias("superblocks"))


def diff_block_maps(a: DataFrame, b: DataFrame, maps_a: DataFrame, maps_b: DataFrame) -> DataFrame:
    """`diff_blocks` where every frame has its own width, height and sb (maps: frame, width, height, sb), with an `error` row for each frame that
    cannot be compared: pictures of other sizes (a frame that a side lacks has none), other superblock sizes, or no picture at all."""
    mi = lambda c, s: F.ceil(F.coalesce(F.col(f"{c}_{s}"), F.lit(0)) / MI)
    side = lambda df, s: df.select("frame", *[F.col(c).alias(f"{c}_{s}") for c in ("width", "height", "sb")])
    frames = side(maps_a, "a").join(side(maps_b, "b"), "frame", "full")
    text = lambda s: F.concat(mi("height", s).cast("string"), F.lit("x"), mi("width", s).cast("string"), F.lit(" MI"))
    other = (mi("height", "a") != mi("height", "b")) | (mi("width", "a") != mi("width", "b"))
    error = F.when(other, F.concat(F.lit("the two frames are not the same size: A "), text("a"), F.lit(", B "), text("b"))).when(~F.col("sb_a").eqNullSafe(F.col("sb_b")), "the two streams use different superblock sizes").when((mi("height", "a") <= 0) | (mi("width", "a") <= 0), "empty frame")
    judged = frames.withColumn("error", error)
    good = judged.where("error IS NULL").select("frame", F.col("width_a").alias("width"), F.col("height_a").alias("height"), F.col("sb_a").alias("sb"))
    found = _collapsed(_compared(a.join(good, "frame"), b.join(good, "frame"), False)).withColumn("error", F.lit(None).cast("string"))
    kinds = dict(found.dtypes)
    bad = judged.where("error IS NOT NULL").select("frame", *[F.lit(None).cast(kinds[c]).alias(c) for c in found.columns if c not in ("frame", "error")], "error")
    return found.unionByName(bad)


def first_sb(block_diffs: DataFrame, value_diffs: DataFrame) -> DataFrame:
    """Per frame the first superblock with a block difference, and the first with only differing totals strictly before it."""
    at = F.struct("sb_row", "sb_col")
    real = block_diffs.groupBy("frame").agg(F.min(at).alias("first"))
    totals = value_diffs.select("frame", at.alias("at")).join(real, "frame", "left").where("first IS NULL OR at < first").groupBy("frame").agg(F.min("at").alias("totals_only"))
    out = real.join(totals, "frame", "full")
    return out.select("frame", *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in ("first", "totals_only") for c in ("sb_row", "sb_col")])


def blocks_at(points: DataFrame, blocks: DataFrame) -> DataFrame:
    """Every block that covers a pixel: an equality on the 64-sample cell, then the exact test. points: frame, px, py."""
    cell = 64
    cover = lambda at, size: F.sequence(F.floor(F.col(at) / cell), F.floor((F.col(at) + F.col(size) - 1) / cell))
    b = blocks.where("w > 0 AND h > 0").select("*", F.explode(cover("y", "h")).alias("cy")).select("*", F.explode(cover("x", "w")).alias("cx"))
    p = points.withColumns({"cx": F.floor(F.col("px") / cell), "cy": F.floor(F.col("py") / cell)})
    return p.join(b, ["frame", "cx", "cy"]).where("px >= x AND px < x + w AND py >= y AND py < y + h").drop("cx", "cy")


def compare_at_pixel(points: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Values of two streams at a pixel, matched by element name: frame, px, py, name, value_a, value_b, equal."""
    values = lambda df, v: blocks_at(points, df).select("frame", "px", "py", F.explode(F.split("syntax", r"\|")).alias("e")).select("frame", "px", "py", F.substring_index("e", "=", 1).alias("name"), F.regexp_replace("e", "^[^=]*=", "").alias("value")).groupBy("frame", "px", "py", "name").agg(F.min("value").alias(v))
    return values(a, "value_a").join(values(b, "value_b"), ["frame", "px", "py", "name"], "full").withColumn("equal", F.col("value_a").eqNullSafe(F.col("value_b")))


def distinct_blocks(blocks: DataFrame) -> DataFrame:
    return blocks.dropDuplicates(["frame", "x", "y", "w", "h"])


def unchanged(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def only_in(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b)


def replace_slice(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows in place of the old ones with the same key."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def dedupe_paths(items: DataFrame, canonical: str, raw: str, order: str) -> DataFrame:
    """The first of each path; a path that does not resolve is compared as written and never with a resolved one."""
    w = Window.partitionBy(F.col(canonical).isNull(), F.coalesce(canonical, raw)).orderBy(order)
    return items.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def compare_goldens(checks: DataFrame) -> DataFrame:
    """ok, differs, missing expected or missing actual for every frame."""
    state = F.when(F.col("expected").isNull() & F.col("actual").isNull(), "missing").when(F.col("expected").isNull(), "no golden").when(F.col("actual").isNull(), "not produced").when(F.col("expected").eqNullSafe(F.col("actual")), "ok").otherwise("differs")
    return checks.withColumn("state", state)


def cap_rows(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The first n rows of each report (`info` false) and one row saying that there were more."""
    w = Window.partitionBy(*keys).orderBy(*order)
    kept = rows.withColumn("k", F.row_number().over(w)).where(F.col("k") <= n).drop("k").withColumn("info", F.lit(False))
    more = rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > n)
    kinds = dict(rows.dtypes)
    return kept.unionByName(more.select(*keys, *[F.lit(None).cast(kinds[c]).alias(c) for c in rows.columns if c not in keys], F.lit(True).alias("info")))


def first_n_text(rows: DataFrame, key: str, order: str, text: str, n: int) -> DataFrame:
    """The first n texts of each key joined, and `... k more`."""
    w = Window.partitionBy(key).orderBy(order)
    ranked = rows.withColumn("k", F.row_number().over(w))
    top = ranked.where(F.col("k") <= n).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", text))), lambda s: s[text]), ", ").alias("texts"))
    count = rows.groupBy(key).agg(F.count("*").alias("n"))
    return top.join(count, key).select(key, F.when(F.col("n") > n, F.concat("texts", F.lit(" ... "), (F.col("n") - n).cast("string"), F.lit(" more"))).otherwise(F.col("texts")).alias("summary"))


def raster_sort(df: DataFrame) -> DataFrame:
    return df.orderBy("frame", "y", "x")


PROBLEM_ROWS = 200  # of a source that are listed


def problems(findings: dict[str, DataFrame], severity: dict[str, str] | None = None, most: int = PROBLEM_ROWS) -> DataFrame:
    """step, source, severity, rank, at, message: the findings (at, message) of every source, sources in their order, each by `at`, then message.

    Of a source the first `most` are listed (rank counts from 1) and, where there are more, one Info row that says so (rank most + 1).
    Severity is Diff unless `severity` names another. Findings of null `at` come first. An empty source gives no row.
    """
    union = None
    for i, (source, df) in enumerate(findings.items()):
        part = df.select(F.lit(i).alias("step"), F.lit(source).alias("source"), F.lit((severity or {}).get(source, "Diff")).alias("severity"), F.col("at").cast("long").alias("at"), "message")
        union = part if union is None else union.unionByName(part)
    ranked = union.withColumn("rank", F.row_number().over(Window.partitionBy("step").orderBy(F.col("at").asc_nulls_first(), "message"))).where(F.col("rank") <= most)
    more = union.groupBy("step", "source").agg(F.count("*").alias("n")).where(F.col("n") > most)
    said = F.concat(F.lit(f"Only the first {most} of "), F.col("n").cast("string"), F.lit(" are listed"))
    info = more.select("step", "source", F.lit("Info").alias("severity"), F.lit(None).cast("long").alias("at"), said.alias("message"), F.lit(most + 1).alias("rank"))
    return ranked.unionByName(info).select("step", "source", "severity", "rank", "at", "message")


def recon_findings(frames: DataFrame) -> DataFrame:
    """Findings from plane_diff rows (frame, plane, differing, first_y, first_x): one for each frame that differs, with the samples of all its planes."""
    luma = F.max(F.when(F.col("plane") == 0, F.struct("first_x", "first_y")))
    g = frames.where("differing > 0").groupBy("frame").agg(F.sum("differing").alias("n"), luma.alias("p"))
    where = F.when(F.col("p.first_x").isNull(), "chroma").otherwise(F.concat(F.lit("pixel (x, y) = ("), F.col("p.first_x").cast("string"), F.lit(", "), F.col("p.first_y").cast("string"), F.lit(")")))
    return g.select(F.col("frame").alias("at"), F.concat(F.lit("Reconstruction differs in "), F.col("n").cast("string"), F.lit(" samples, "), where).alias("message"))


def decoder_findings(errors: DataFrame, item: str, text: str) -> DataFrame:
    """Findings from the live error of each item (`frames.latest_error`)."""
    return errors.select(F.col(item).alias("at"), F.trim(text).alias("message"))
