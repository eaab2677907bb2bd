"""Where two streams part: header sections, payloads, the blocks of the first differing unit's frame, reconstruction, decoder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import diff as df
from ..operators import frames as fr
from ..operators import grid as gr


def find_diff(
    syntax_a: DataFrame, syntax_b: DataFrame, payload_a: DataFrame, payload_b: DataFrame, blocks_a: DataFrame, blocks_b: DataFrame, headers: DataFrame,
    grid_a: DataFrame, grid_b: DataFrame, errors: DataFrame, width: int, height: int, sb: int = 64,
) -> DataFrame:
    """The problems table of all steps (see `diff.problems`).

    The frame to compare by blocks is that of the first differing payload whose unit is displayed: headers (stream, pos, coded_id, ...; coded_id is a
    unit's ordinal) give the display map, the first differing unit in it the frame - a one-row semi join, by which both block scans are
    pruned. Reconstruction is compared on the frames that both grids have; errors (item, text) are the decoders' live ones.
    """
    sections = df.diff_sections(syntax_a, syntax_b).where("differences > 0").select(F.col("section").alias("at"), F.concat(F.col("differences").cast("string"), F.lit(" element differences")).alias("message"))
    payloads = df.diff_payloads(payload_a, payload_b)
    shown = fr.display_map(headers).groupBy("coded_id").agg(F.min("display_index").alias("display_index"))
    first = payloads.join(shown, F.col("ordinal") == F.col("coded_id")).agg(F.min_by("display_index", "ordinal").alias("frame"))
    only = lambda b: b.join(F.broadcast(first), "frame", "left_semi")  # noqa: E731  one row
    differing = df.diff_blocks(only(blocks_a), only(blocks_b), width, height, sb).groupBy("sb_row", "sb_col").agg(F.min(F.struct("mi_row", "mi_col", "kind")).alias("f"), F.sum("positions").alias("n"))
    said = F.concat(F.col("n").cast("string"), F.lit(" positions differ in SB("), F.col("sb_row").cast("string"), F.lit(", "), F.col("sb_col").cast("string"), F.lit("): "), F.col("f.kind"))
    blocks = differing.select((F.col("sb_row") * -(-width // sb) + F.col("sb_col")).alias("at"), said.alias("message"))
    findings = {
        "header": sections,
        "payload": payloads.select(F.col("ordinal").alias("at"), F.col("kind").alias("message")),
        "block": blocks,
        "reconstruction": df.recon_findings(gr.plane_diff(grid_a, grid_b, ("frame", "plane"))),
        "decoder": df.decoder_findings(errors, "item", "text"),
    }
    return df.problems(findings, {"decoder": "Error"})
