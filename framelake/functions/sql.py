"""The scalar functions and the table of a block's positions for SQL: temporary functions of a session over built-in expressions, no Python."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: name(arguments): (what it returns, its body)
FUNCTIONS: dict[str, tuple[str, str]] = {
    "psnr_from_sse(sse DOUBLE, n BIGINT)": ("DOUBLE", "CASE WHEN n > 0 AND sse > 0 AND sse < double('infinity') THEN 10 * log10(65025.0D * n / sse) END"),
    "psnr_label(sse DOUBLE, psnr DOUBLE)": ("STRING", "CASE WHEN psnr IS NOT NULL THEN format_string('%.3f', psnr) WHEN sse = 0 THEN 'lossless' ELSE '-' END"),
    "rate_axis(bits DOUBLE)": ("DOUBLE", "bits + 1"),
    "to_eighth_pel(pixels BIGINT)": ("BIGINT", "pixels * 8"),
    "quarter_to_eighth_pel(quarters BIGINT)": ("BIGINT", "quarters * 2"),
    "whole_part(mv BIGINT)": ("BIGINT", "mv DIV 8"),
    "divide_round(a BIGINT, b BIGINT)": ("BIGINT", "CAST(sign(a) AS BIGINT) * ((abs(a) + b DIV 2) DIV b)"),
    "round_half_away(v DOUBLE)": ("BIGINT", "CAST(sign(v) * floor(abs(v) + 0.5D) AS BIGINT)"),
    "frame_type(code INT, show_existing INT)": ("STRING", "CASE WHEN show_existing = 1 THEN 'SHOW_EXISTING' WHEN code BETWEEN 0 AND 3 THEN element_at(array('KEY', 'INTER', 'INTRA_ONLY', 'SWITCH'), code + 1) ELSE '-' END"),
    "slice_type_name(type_id INT)": ("STRING", "CASE WHEN type_id < 0 THEN '?' ELSE element_at(array('P', 'B', 'I', 'SP', 'SI'), type_id % 5 + 1) END"),
    "bytes_text(n BIGINT)": ("STRING", "CASE WHEN n >= 10485760 THEN format_string('%.1f MB', n / 1048576.0D) WHEN n >= 10240 THEN format_string('%.1f KB', n / 1024.0D) WHEN n IS NOT NULL THEN concat(CAST(n AS STRING), ' B') END"),
    "to_8bit(v INT, bit_depth INT)": ("INT", "shiftright(v, bit_depth - 8)"),
    "sync_from_flags(flags BIGINT)": ("BOOLEAN", "flags & 65536 = 0"),
    "looks_like_link(s STRING)": ("BOOLEAN", "s RLIKE '^https?://' OR s RLIKE '^[A-Za-z0-9_-]{11}$'"),
    "mi_positions(x BIGINT, y BIGINT, w BIGINT, h BIGINT)": (
        "TABLE (mi_row BIGINT, mi_col BIGINT)",
        "SELECT p.r, p.c FROM explode(CASE WHEN w > 0 AND h > 0 THEN flatten(transform(sequence(y DIV 4, (y + h - 1) DIV 4), r -> transform(sequence(x DIV 4, (x + w - 1) DIV 4), c -> struct(r AS r, c AS c)))) END) AS t(p)",
    ),
}


def register(spark: SparkSession) -> None:
    """Make the functions known to the session's SQL."""
    for signature, (kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {kind} RETURN {body}")
