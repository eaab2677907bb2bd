"""Scalar functions: each takes and gives Columns (or column names) and stays inside Spark's expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def psnr_from_sse(sse: ColumnOrName, n: ColumnOrName, bit_depth: int = 8) -> Column:
    """10 log10(peak^2 n / sse); null for unknown, negative or zero error and for no samples."""
    sse, n = _c(sse), _c(n)
    peak = float((1 << bit_depth) - 1)
    return F.when((n > 0) & (sse > 0) & (sse < float("inf")), 10 * F.log10(peak * peak * n / sse))


def psnr_label(sse: ColumnOrName, psnr: ColumnOrName) -> Column:
    return F.when(_c(psnr).isNotNull(), F.format_string("%.3f", _c(psnr))).when(_c(sse) == 0, "lossless").otherwise("-")


def plane_label(sse: ColumnOrName, psnr: ColumnOrName) -> Column:
    return F.when(_c(sse) == 0, "identical").when(_c(psnr).isNotNull(), F.format_string("%.2f dB", _c(psnr))).otherwise("-")


def clipped_samples(x: ColumnOrName, y: ColumnOrName, size_w: ColumnOrName, size_h: ColumnOrName, width: int, height: int) -> Column:
    """Samples of a block that lie inside the picture."""
    w = F.greatest(F.lit(0), F.least(_c(x) + _c(size_w), F.lit(width)) - F.greatest(_c(x), F.lit(0)))
    h = F.greatest(F.lit(0), F.least(_c(y) + _c(size_h), F.lit(height)) - F.greatest(_c(y), F.lit(0)))
    return w * h


def rate_axis(bits: ColumnOrName) -> Column:
    """One bit more on every point, so that a block without bits has a logarithm."""
    return _c(bits) + 1


def to_eighth_pel(full: ColumnOrName) -> Column:
    return _c(full) * 8


def quarter_to_eighth_pel(quarter: ColumnOrName) -> Column:
    return _c(quarter) * 2


def whole_part(mv: ColumnOrName) -> Column:
    """Whole pixels of an eighth-pel vector, towards zero."""
    return (_c(mv) / 8).cast("long")


#: Tiers of vector rates: lowest magnitude and log2 of the step of each of four tables of 128 rates; magnitudes are clamped to RATE_LIMIT.
RATE_TIERS = ((0, 0), (128, 1), (384, 2), (896, 3))
RATE_LIMIT = 1919


def rate_place(d: ColumnOrName) -> Column:
    """Where a component's rate stands in the four tables laid end to end (0 to 511): by its clamped magnitude, in steps of 1, 2, 4 and 8."""
    m = F.least(F.abs(_c(d)), F.lit(RATE_LIMIT)).cast("int")
    out = F.lit(0)
    for i, (low, step) in enumerate(RATE_TIERS):
        out = F.when(m >= low, 128 * i + F.shiftright(m - low, step)).otherwise(out)
    return out


def magnitude_rate(d: ColumnOrName, tables: list[list[int]]) -> Column:
    """Rate of one component by an encoder's four tables, 128 rates each. They are measured and the encoder's own, so none come with the library."""
    if [len(t) for t in tables] != [128] * len(RATE_TIERS):
        raise ValueError("four tables of 128 rates are needed")
    return F.element_at(F.array(*[F.lit(v) for t in tables for v in t]), rate_place(d) + 1).cast("long")


def mv_rate(dx: ColumnOrName, dy: ColumnOrName, tables: list[list[int]]) -> Column:
    return magnitude_rate(dx, tables) + magnitude_rate(dy, tables)


def divide_round(a: ColumnOrName, b: ColumnOrName) -> Column:
    """a / b, rounded half away from zero, in integers (b > 0)."""
    a, b = _c(a), _c(b)
    return (F.signum(a) * F.floor((F.abs(a) + F.floor(b / 2)) / b)).cast("long")


def round_half_away(v: ColumnOrName) -> Column:
    v = _c(v)
    return (F.signum(v) * F.floor(F.abs(v) + 0.5)).cast("long")


def frame_type(code: ColumnOrName, show_existing: ColumnOrName) -> Column:
    # The four frame types of the format.
    names = F.when(_c(code) == 0, "KEY").when(_c(code) == 1, "INTER").when(_c(code) == 2, "INTRA_ONLY").when(_c(code) == 3, "SWITCH").otherwise("-")
    return F.when(_c(show_existing) == 1, "SHOW_EXISTING").otherwise(names)


def avc_frame_class(idr: ColumnOrName, slice_types: ColumnOrName) -> Column:
    """Key for IDR or I without P and B, BiPred with any B, else Inter."""
    has = lambda t: F.array_contains(_c(slice_types), t)
    return F.when(_c(idr) | (has("I") & ~has("P") & ~has("B")), "Key").when(has("B"), "BiPred").otherwise("Inter")


def slice_type_name(type_id: ColumnOrName) -> Column:
    # Slice types by number modulo five.
    names = F.array(*[F.lit(x) for x in ("P", "B", "I", "SP", "SI")])
    return F.when(_c(type_id) < 0, "?").otherwise(F.element_at(names, (F.pmod(_c(type_id), F.lit(5)) + 1).cast("int")))


def slice_poc(name: ColumnOrName) -> Column:
    return F.nullif(F.regexp_extract(_c(name), r"^NAL \d+: (1|5) Slice.* POC (-?\d+)", 2), F.lit("")).cast("long")


def bytes_text(n: ColumnOrName) -> Column:
    n = _c(n)
    return F.when(n >= 10 << 20, F.format_string("%.1f MB", n / float(1 << 20))).when(n >= 10 << 10, F.format_string("%.1f KB", n / 1024.0)).when(n.isNotNull(), F.concat(n.cast("string"), F.lit(" B")))


def rgb_to_yuv709(r: ColumnOrName, g: ColumnOrName, b: ColumnOrName) -> Column:
    """Limited-range BT.709 as struct(y, cb, cr), rounded and clipped to 0..255."""
    r, g, b = _c(r), _c(g), _c(b)
    luma = 0.2126 * r + 0.7152 * g + 0.0722 * b
    clip = lambda v: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(v + 0.5))).cast("long")
    return F.struct(clip(16 + luma * 219 / 255).alias("y"), clip(128 + (b - luma) / 1.8556 * 224 / 255).alias("cb"), clip(128 + (r - luma) / 1.5748 * 224 / 255).alias("cr"))


def yuv709_to_rgb(y: ColumnOrName, cb: ColumnOrName, cr: ColumnOrName) -> Column:
    """The 8.8 fixed-point inverse."""
    c, d, e = _c(y) - 16, _c(cb) - 128, _c(cr) - 128
    clip = lambda v: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((v + 128) / 256))).cast("long")
    return F.struct(clip(298 * c + 459 * e).alias("r"), clip(298 * c - 55 * d - 136 * e).alias("g"), clip(298 * c + 541 * d).alias("b"))


def to_8bit(v: ColumnOrName, bit_depth: int) -> Column:
    return F.shiftright(_c(v), bit_depth - 8)


def scaled_threshold(t: int, bit_depth: int) -> int:
    return t << (bit_depth - 8)


def read_bits(data: ColumnOrName, start_bit: ColumnOrName, n: int) -> Column:
    """n bits (at most 64) from a bit offset, most significant first; null past the end and for n = 0. With 64 bits the first one is the sign."""
    if not 0 < n <= 64:
        return F.lit(None).cast("long")
    if n > 56:
        return F.shiftleft(read_bits(data, start_bit, n - 32), 32).bitwiseOR(read_bits(data, _c(start_bit) + (n - 32), 32))
    data, start = _c(data), _c(start_bit)
    first = F.floor(start / 8).cast("int")
    last = F.floor((start + n - 1) / 8).cast("int")
    window = F.substring(data, first + 1, last - first + 1)
    value = F.conv(F.hex(window), 16, 10).cast("decimal(20,0)")
    drop = ((last + 1) * 8 - (start + n)).cast("int")
    shifted = F.floor(value / F.pow(F.lit(2.0), drop).cast("decimal(20,0)")).cast("decimal(20,0)")
    return F.when((start >= 0) & (start + n <= 8 * F.octet_length(data)), (shifted % F.lit(1 << n).cast("decimal(20,0)")).cast("long"))


def sync_from_flags(flags: ColumnOrName) -> Column:
    """A sample is a sync sample unless bit 0x10000 is set."""
    return _c(flags).bitwiseAND(F.lit(0x10000)) == 0


def model_apply(p: list[ColumnOrName], x: ColumnOrName, y: ColumnOrName) -> tuple[Column, Column]:
    """The affine map of a point: (p0 + p2 x + p3 y, p1 + p4 x + p5 y)."""
    p = [_c(v) for v in p]
    return p[0] + p[2] * _c(x) + p[3] * _c(y), p[1] + p[4] * _c(x) + p[5] * _c(y)


def model_mv(p: list[ColumnOrName], x: ColumnOrName, y: ColumnOrName) -> tuple[Column, Column]:
    u, v = model_apply(p, x, y)
    return round_half_away((u - _c(x)) * 8), round_half_away((v - _c(y)) * 8)


def model_scale_angle(p: list[ColumnOrName]) -> tuple[Column, Column]:
    p = [_c(v) for v in p]
    return F.sqrt(F.abs(p[2] * p[5] - p[3] * p[4])), F.degrees(F.atan2(p[4] - p[3], p[2] + p[5]))


def motion_from_model(p: list[ColumnOrName], width: float, height: float) -> tuple[Column, Column, Column, Column]:
    """Content motion (dx, dy, angle, log scale) as the inverse of a similarity about the centre; zeros for a vanishing scale."""
    p = [_c(v) for v in p]
    a, b = (p[2] + p[5]) / 2, (p[4] - p[3]) / 2
    scale, angle = F.hypot(a, b), F.atan2(b, a)
    cx, cy = width / 2, height / 2
    tx, ty = p[0] + p[2] * cx + p[3] * cy - cx, p[1] + p[4] * cx + p[5] * cy - cy
    good = scale > 1e-9
    dx = -(F.cos(angle) * tx + F.sin(angle) * ty) / scale
    dy = -(-F.sin(angle) * tx + F.cos(angle) * ty) / scale
    zero = F.lit(0.0)
    return tuple(F.when(good, v).otherwise(zero) for v in (dx, dy, -angle, -F.ln(F.when(good, scale).otherwise(1.0))))


def warp_params(dx: ColumnOrName, dy: ColumnOrName, angle: ColumnOrName, log_scale: ColumnOrName, width: float, height: float) -> Column:
    """The inverse affine map (6 numbers) that applies a correction about the centre."""
    inv = F.exp(-_c(log_scale))
    c, s = F.cos(_c(angle)) * inv, F.sin(_c(angle)) * inv
    cx, cy = width / 2, height / 2
    ox, oy = cx + _c(dx), cy + _c(dy)
    return F.array(cx - c * ox - s * oy, cy + s * ox - c * oy, c, s, -s, c)


def chroma_warp(p: ColumnOrName, siting_x: float = 0.0, siting_y: float = 0.5) -> Column:
    """The map for half-size chroma planes, samples sited at an offset of the luma grid."""
    q = [_c(p)[i] for i in range(6)]
    tx = (q[0] + q[2] * siting_x + q[3] * siting_y - siting_x) / 2
    ty = (q[1] + q[4] * siting_x + q[5] * siting_y - siting_y) / 2
    return F.array(tx, ty, *q[2:])


def looks_like_link(s: ColumnOrName) -> Column:
    return _c(s).rlike("^https?://") | _c(s).rlike("^[A-Za-z0-9_-]{11}$")


def unit_label(tu: ColumnOrName, idx: ColumnOrName, unit_type: ColumnOrName) -> Column:
    # The unit types with a name of their own.
    names = {1: "Sequence Header", 2: "Temporal Delimiter", 3: "Frame Header", 4: "Tile Group", 5: "Metadata", 6: "Frame", 7: "Redundant Frame Header", 8: "Tile List", 15: "Padding"}
    name = F.lit("Other")
    for k, v in names.items():
        name = F.when(_c(unit_type) == k, v).otherwise(name)
    return F.concat(F.lit("TU "), _c(tu).cast("string"), F.lit(" / OBU "), _c(idx).cast("string"), F.lit(": "), name)


def log_height(frames: DataFrame, size: str = "bytes", logarithmic: bool = True) -> DataFrame:
    """`height` of each bar: its size against the largest of the whole table, on a logarithmic or linear axis; one half where it is unknown.

    The largest size is one row, joined to all: no row moves.
    """
    most = frames.agg(F.max(size).alias("most"))
    part = F.log1p(F.col(size)) / F.log1p("most") if logarithmic else F.col(size) / F.col("most")
    return frames.crossJoin(F.broadcast(most)).withColumn("height", F.coalesce(part, F.lit(0.5))).drop("most")
