"""Queries of the frames and timeline family (FR) and its joins."""

from pyspark.sql import functions as F

from ..operators import frames as fr
from ..registry import query


@query("fr1_range_summary", "f_cf", oracle="""
SELECT stream, count(*) AS frames, CAST(sum(bytes) AS BIGINT) AS bytes, round(sum(bytes) * 8 * 25.0::DOUBLE / count(*) / 1000, 3) AS kbps, arg_max(frame, bytes * 1000000 - frame) AS largest, arg_min(frame, bytes * 1000000 + frame) AS smallest,
  count(*) FILTER (frame_type = '1-URGENT') AS urgent, CAST(coalesce(sum(bytes) FILTER (frame_type = '1-URGENT'), 0) AS BIGINT) AS urgent_bytes FROM f_cf WHERE frame BETWEEN 10 AND 60 GROUP BY stream""")
def fr1(t):
    s = fr.range_summary(t, 10, 60, 25.0)
    u = F.try_element_at("by_type", F.lit("1-URGENT"))
    return s.select("stream", "frames", "bytes", F.round("kbps", 3).alias("kbps"), "largest", "smallest", F.coalesce(u["n"], F.lit(0)).alias("urgent"), F.coalesce(u["bytes"], F.lit(0)).alias("urgent_bytes"))


@query("fr2_range_diff", "f_cf", oracle="""
SELECT 1 AS pair, CASE WHEN bool_and(b.bytes IS NOT NULL) AND sum(a.bytes) > 0 THEN round((sum(b.bytes) - sum(a.bytes)) * 100.0::DOUBLE / sum(a.bytes), 4) END AS percent FROM f_cf a LEFT JOIN f_cf b ON b.frame = a.frame AND b.stream = 4 WHERE a.stream = 3 AND a.frame BETWEEN 0 AND 20
UNION ALL SELECT 2, CASE WHEN bool_and(b.bytes IS NOT NULL) AND sum(a.bytes) > 0 THEN round((sum(b.bytes) - sum(a.bytes)) * 100.0::DOUBLE / sum(a.bytes), 4) END FROM f_cf a LEFT JOIN f_cf b ON b.frame = a.frame AND b.stream = 1 WHERE a.stream = 0 AND a.frame BETWEEN 0 AND 100000""")
def fr2(t):
    pick = lambda s: t.where(F.col("stream") == s)
    one = fr.range_diff(pick(3), pick(4), 0, 20).select(F.lit(1).alias("pair"), F.round("percent", 4).alias("percent"))
    return one.unionByName(fr.range_diff(pick(0), pick(1), 0, 100000).select(F.lit(2).alias("pair"), F.round("percent", 4).alias("percent")))


@query("fr3_align_check", "f_cf", oracle="""
WITH l AS (SELECT stream, max(frame) + stream % 2 AS last, count(*) AS n FROM f_cf GROUP BY stream)
SELECT l.stream, r.frame, CASE WHEN l.n = l.last + 1 THEN c.bytes END AS bytes FROM l, LATERAL (SELECT unnest(range(0, l.last + 1)) AS frame) r LEFT JOIN f_cf c ON c.stream = l.stream AND c.frame = r.frame""")
def fr3(t):
    return fr.align_check(t, t.groupBy("stream").agg((F.max("frame") + F.col("stream") % 2).alias("last")))


_PICT = """n AS (SELECT *, sum(CASE WHEN first_mb = 0 OR prev IS NULL OR prev <> poc THEN 1 ELSE 0 END) OVER (PARTITION BY stream ORDER BY pos ROWS UNBOUNDED PRECEDING) - 1 AS picture FROM (SELECT *, lag(poc) OVER (PARTITION BY stream ORDER BY pos) AS prev FROM f_sl)),
p AS (SELECT stream, CAST(picture AS BIGINT) AS coding_order, arg_min(poc, pos) AS poc, bool_or(nal_type = 5) AS idr, count(*) AS slices, list(slice_type_id ORDER BY pos) AS slice_type_ids FROM n GROUP BY stream, picture)"""


@query("fr4_assemble_pictures", "f_sl", oracle=f"WITH {_PICT} SELECT stream, coding_order, poc, idr, slices, array_to_string(slice_type_ids, ' ') AS types FROM p")
def fr4(t):
    return fr.assemble_pictures(t).select("stream", "coding_order", "poc", "idr", "slices", F.concat_ws(" ", F.col("slice_type_ids").cast("array<string>")).alias("types"))


@query("fr5_display_order", "f_sl", oracle=f"WITH {_PICT} SELECT stream, coding_order, poc, CAST(row_number() OVER (PARTITION BY stream ORDER BY poc, coding_order) - 1 AS BIGINT) AS display_order FROM p")
def fr5(t):
    return fr.display_order(fr.assemble_pictures(t)).select("stream", "coding_order", "poc", "display_order")


_CO = "c AS (SELECT *, CASE WHEN show_existing = 0 THEN CAST(sum(1 - show_existing) OVER w - 1 AS BIGINT) END AS coding_order, CASE WHEN show_frame = 1 OR show_existing = 1 THEN CAST(sum(CASE WHEN show_frame = 1 OR show_existing = 1 THEN 1 ELSE 0 END) OVER w - 1 AS BIGINT) END AS display_index FROM f_fh WINDOW w AS (PARTITION BY stream ORDER BY pos ROWS UNBOUNDED PRECEDING))"


@query("fr6_coding_order", "f_fh", oracle=f"WITH {_CO} SELECT stream, pos, coding_order FROM c")
def fr6(t):
    return fr.coding_order(t).select("stream", "pos", "coding_order")


@query("fr6_hidden_frames", "f_fh", oracle=f"WITH {_CO}, u AS (SELECT *, first_value(display_index IGNORE NULLS) OVER (PARTITION BY stream ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS unit FROM c) SELECT stream, unit AS display_index, coalesce(string_agg(CAST(coding_order AS VARCHAR), ' ' ORDER BY coding_order) FILTER (show_existing = 0 AND show_frame = 0), '') AS hidden FROM u WHERE unit IS NOT NULL GROUP BY stream, unit")
def fr6_hidden(t):
    return fr.hidden_frames(t).select("stream", "display_index", F.concat_ws(" ", F.col("hidden").cast("array<string>")).alias("hidden"))


@query("fr7_display_index", "f_fh", oracle=f"WITH {_CO} SELECT stream, pos, display_index FROM c")
def fr7(t):
    return fr.display_index(t).select("stream", "pos", "display_index")


_MAP = f"""{_CO}, e AS (SELECT stream, CAST(s AS BIGINT) AS slot, pos, coded_id, NULL AS shown_at FROM c, range(0, 8) r(s) WHERE show_existing = 0 AND (refresh_flags >> CAST(s AS INTEGER)) & 1 = 1 UNION ALL SELECT stream, map_idx, pos, NULL, display_index FROM c WHERE show_existing = 1),
h AS (SELECT stream, shown_at, last_value(coded_id IGNORE NULLS) OVER (PARTITION BY stream, slot ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM e),
m AS (SELECT stream, coded_id, max(display_index) AS display_index FROM (SELECT stream, coded_id, display_index FROM c WHERE show_existing = 0 AND show_frame = 1 UNION ALL SELECT stream, held, shown_at FROM h WHERE shown_at IS NOT NULL AND held IS NOT NULL) GROUP BY stream, coded_id)"""


@query("fr8_display_map", "f_fh", oracle=f"WITH {_MAP} SELECT * FROM m")
def fr8(t):
    return fr.display_map(t)


def _slots(c):
    """SQL: the eight slots after a unit; c: what is kept of a frame."""
    held, all_ = f"r.{c[0]}[CAST(map_idx + 1 AS INTEGER)]", "list_transform(range(0, 8), lambda i: {})"
    refreshed = f"CASE WHEN (frame_type = 0 AND show_frame = 1) OR frame_type = 3 OR (refresh_flags >> CAST(i AS INTEGER)) & 1 = 1 THEN {c[1]} ELSE r.{c[0]}[i + 1] END"
    return f"CASE WHEN show_existing = 1 AND r.t[CAST(map_idx + 1 AS INTEGER)] = 0 THEN {all_.format(held)} WHEN show_existing = 1 THEN r.{c[0]} ELSE {all_.format(refreshed)} END"


_FULL = f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY pos) AS k FROM f_fh),
r AS (SELECT stream, CAST(0 AS BIGINT) AS k, list_transform(range(0, 8), lambda i: CAST(NULL AS BIGINT)) AS c, list_transform(range(0, 8), lambda i: CAST(NULL AS BIGINT)) AS t, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS shown, CAST(NULL AS BIGINT) AS shown_at FROM (SELECT DISTINCT stream FROM e)
UNION ALL SELECT e.stream, e.k, {_slots(('c', 'coded_id'))}, {_slots(('t', 'CAST(frame_type AS BIGINT)'))}, r.n + CASE WHEN show_existing = 1 OR show_frame = 1 THEN 1 ELSE 0 END, CASE WHEN show_existing = 1 THEN r.c[CAST(map_idx + 1 AS INTEGER)] WHEN show_frame = 1 THEN coded_id END, r.n FROM r JOIN e ON e.stream = r.stream AND e.k = r.k + 1)
SELECT stream, shown AS coded_id, max(shown_at) AS display_index FROM r WHERE shown IS NOT NULL GROUP BY stream, shown"""


@query("fr9_display_map_full", "f_fh", oracle=_FULL)
def fr9(t):
    return fr.display_map_full(t)


@query("jn11_resolve_display", "f_fh", oracle=f"WITH {_MAP} SELECT f.stream, f.coded_id, coalesce(m.display_index, -1) AS display_index, CASE WHEN m.display_index IS NULL THEN 'never shown' END AS error FROM f_fh f LEFT JOIN m USING (stream, coded_id)")
def jn11(t):
    return fr.resolve_display(t.select("stream", "coded_id"), fr.display_map(t))


@query("jn10_keep_known", "f_cf", oracle="SELECT stream, frame, bytes FROM f_cf WHERE stream IN (SELECT stream FROM f_cf WHERE bytes > 400000)")
def jn10(t):
    return fr.keep_known(t.select("stream", "frame", "bytes"), t.where("bytes > 400000"), "stream")


@query("mn5_carry_config", "f_fh", oracle="WITH k AS (SELECT stream, pos, CASE WHEN frame_type = 0 THEN order_hint END AS config FROM f_fh) SELECT stream, pos, config, last_value(config IGNORE NULLS) OVER (PARTITION BY stream ORDER BY pos ROWS UNBOUNDED PRECEDING) AS current, first_value(config IGNORE NULLS) OVER (PARTITION BY stream ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS initial FROM k")
def mn5(t):
    return fr.carry_config(t.select("stream", "pos", F.when(F.col("frame_type") == 0, F.col("order_hint")).alias("config")), "stream", "pos", "config")


@query("mn6_latest_error", "f_cf", oracle="SELECT stream, frame, text FROM (SELECT stream, frame, CASE WHEN stream % 3 = 0 THEN '' ELSE frame_type END AS text, row_number() OVER (PARTITION BY stream ORDER BY frame DESC) AS k FROM f_cf) WHERE k = 1 AND text <> ''")
def mn6(t):
    return fr.latest_error(t.select("stream", "frame", F.when(F.col("stream") % 3 == 0, "").otherwise(F.col("frame_type")).alias("text")), "stream", "frame", "text")
