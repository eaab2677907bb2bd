"""Views over the test tables with the shapes of codec telemetry, in SQL that Spark and DuckDB both run; where SQL would put too much into one task, Spark builds the same rows by operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .operators.scan import SPAN, span
from .sources.store import written

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "conversations")

SQL = {
    "f_rd": """
SELECT l_linenumber AS frame, l_partkey % 10 AS sb_row, l_suppkey % 10 AS sb_col, l_returnflag AS grp,
       CAST(month(l_shipdate) % 4 AS BIGINT) AS point,
       l_quantity * (1 + month(l_shipdate) % 4) AS bits,
       CASE WHEN l_orderkey % 997 = 0 THEN NULL WHEN l_orderkey % 499 = 0 THEN 0.0
            WHEN l_returnflag = 'R' AND l_suppkey % 10 = 9 THEN l_extendedprice / (1 + month(l_shipdate) % 4) / 10000
            ELSE l_extendedprice / (1 + month(l_shipdate) % 4) END AS sse,
       CAST(CASE WHEN l_linenumber = 7 THEN 32 ELSE 64 END AS BIGINT) AS samples
FROM lineitem
WHERE NOT (l_returnflag = 'R' AND l_partkey % 10 = 9 AND month(l_shipdate) % 4 > 0)
""",
    "f_cf": """
SELECT o_custkey % 20 AS stream,
       CAST(row_number() OVER (PARTITION BY o_custkey % 20 ORDER BY o_orderdate, o_orderkey) - 1 AS BIGINT) AS frame,
       CASE WHEN o_orderkey % 101 = 0 THEN NULL ELSE CAST(floor(o_totalprice) AS BIGINT) END AS bytes,
       o_orderpriority AS frame_type, o_orderstatus = 'F' AS is_key
FROM orders
""",
    "f_fh": """
SELECT user_id AS stream,
       CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS pos,
       event_id AS coded_id, CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS show_existing, event_id % 8 AS map_idx,
       CASE WHEN event_type IN ('click', 'purchase') THEN 1 ELSE 0 END AS show_frame,
       (event_id * 37) % 256 AS refresh_flags, event_id % 128 AS order_hint,
       CASE WHEN event_id % 50 = 0 THEN 0 ELSE 1 + event_id % 3 END AS frame_type
FROM events
""",
    "f_sl": """
SELECT user_id AS stream,
       CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS pos,
       event_id % 3 AS first_mb, CAST(floor(value) AS BIGINT) AS poc, event_id % 7 - 1 AS slice_type_id,
       CASE WHEN event_type = 'signup' THEN 5 ELSE 1 END AS nal_type,
       concat('NAL ', CAST(event_id AS VARCHAR(20)), ': ', CASE WHEN event_type = 'signup' THEN '5' ELSE '1' END,
              ' Slice POC ', CAST(CAST(floor(value) AS BIGINT) AS VARCHAR(20))) AS name
FROM events
""",
    "f_sx_a": """
SELECT conv_id AS section, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS idx,
       role AS name, text AS value
FROM conversations
""",
    "f_sx_b": """
SELECT conv_id AS section, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS idx,
       role AS name, CASE WHEN conv_id % 7 = 0 AND turn = 1 THEN concat('~', text) ELSE text END AS value
FROM conversations WHERE NOT (conv_id % 5 = 3 AND turn = 2)
""",
    "f_sx_c": """
SELECT section, CAST(row_number() OVER (PARTITION BY section ORDER BY turn, place) - 1 AS BIGINT) AS idx, name, value
FROM (SELECT conv_id AS section, turn, 1 AS place, CASE WHEN conv_id % 9 = 2 AND turn = 3 THEN 'system' ELSE role END AS name,
             CASE WHEN conv_id % 7 = 0 AND turn = 1 THEN concat('~', text) ELSE text END AS value
      FROM conversations WHERE NOT (conv_id % 5 = 3 AND turn = 2) AND conv_id % 11 <> 4
      UNION ALL SELECT conv_id, turn, 0, 'note', text FROM conversations WHERE conv_id % 6 = 1 AND turn % 2 = 1 AND conv_id % 11 <> 4
      UNION ALL SELECT conv_id + 1000000000, turn, 1, role, text FROM conversations WHERE conv_id % 13 = 5) t
""",
    "f_pl_a": """
SELECT doc_id AS ordinal, doc_id % 9 AS unit_type, text AS payload
FROM documents
""",
    "f_pl_b": """
SELECT doc_id AS ordinal, doc_id % 9 AS unit_type,
       CASE WHEN doc_id % 7 = 0 THEN concat(substr(text, 1, 20), '#', substr(text, 22))
            WHEN doc_id % 13 = 0 THEN concat(text, '!') ELSE text END AS payload
FROM documents WHERE doc_id < (SELECT max(doc_id) - 9 FROM documents)
""",
    "f_bl_a": """
SELECT CAST(floor(p_partkey / 64) AS BIGINT) AS frame, (p_partkey % 8) * 16 AS x,
       CAST(floor((p_partkey % 64) / 8) AS BIGINT) * 16 AS y,
       CASE WHEN p_size % 10 = 0 THEN 8 WHEN p_size % 10 = 1 THEN 24 ELSE 16 END AS w, 16 AS h,
       p_partkey * 100 AS bit_start, p_partkey * 100 + p_size AS bit_end,
       concat('brand=', p_brand, '|type=', p_type, '|sb_qindex=', CAST(CAST(floor(p_partkey / 64) AS BIGINT) % 5 AS VARCHAR(20))) AS syntax
FROM part
""",
    "f_bl_b": """
SELECT CAST(floor(p_partkey / 64) AS BIGINT) AS frame, (p_partkey % 8) * 16 AS x,
       CAST(floor((p_partkey % 64) / 8) AS BIGINT) * 16 AS y,
       CASE WHEN p_partkey % 41 = 0 THEN 12 WHEN p_size % 10 = 0 THEN 8 WHEN p_size % 10 = 1 THEN 24 ELSE 16 END AS w,
       16 AS h, p_partkey * 100 + p_partkey % 3 AS bit_start, p_partkey * 100 + p_size AS bit_end,
       concat('brand=', CASE WHEN p_partkey % 31 = 0 THEN 'X' ELSE p_brand END, '|type=', p_type,
              '|sb_qindex=', CAST(CAST(floor(p_partkey / 64) AS BIGINT) % 5 + CASE WHEN p_partkey < 256 THEN 1 ELSE 0 END AS VARCHAR(20))) AS syntax
FROM part WHERE p_partkey % 97 <> 0
""",
    "f_st": """
SELECT track, CAST(row_number() OVER (PARTITION BY track ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, size) AS BIGINT) AS sample,
       CAST(dense_rank() OVER (PARTITION BY track ORDER BY l_orderkey) AS BIGINT) AS chunk, size, delta, sync
FROM (SELECT l_orderkey % 4 AS track, l_orderkey, l_linenumber, l_partkey, l_suppkey,
             CAST(floor(l_extendedprice) AS BIGINT) AS size, CAST(floor(l_quantity / 25) AS BIGINT) + 1 AS delta,
             l_returnflag = 'R' AS sync FROM lineitem) t
""",
    "f_mv": """
SELECT frame, algorithm, 16 AS size, x, y, native_cost, common_sad,
       CAST(floor(8 * (3 + 0.01 * x - 0.02 * y) + 0.5) AS BIGINT) + CASE WHEN l_linenumber >= 6 THEN 80 ELSE 0 END AS mv_x_q8,
       CAST(floor(8 * (-2 + 0.02 * x + 0.01 * y) + 0.5) AS BIGINT) AS mv_y_q8
FROM (SELECT l_orderkey % 50 AS frame, l_returnflag AS algorithm, (l_partkey % 8) * 16 AS x,
             CAST(floor((l_partkey % 64) / 8) AS BIGINT) * 16 AS y, l_linenumber,
             CAST(floor(l_extendedprice) AS BIGINT) AS native_cost,
             CAST(floor(l_extendedprice * (1 - l_discount)) AS BIGINT) AS common_sad,
             row_number() OVER (PARTITION BY l_orderkey % 50, l_returnflag, l_partkey % 64
                                ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS rn
      FROM lineitem) t
WHERE rn = 1
""",
    "f_gm": """
SELECT poc, poc - 1 AS ref_poc, win_i, win_j, 2 AS n, dx * 4 AS dx_qpel, dy * 4 AS dy_qpel,
       cost_zero AS cost_zero_x, CAST(floor(cost_zero * (1 - disc * 2)) AS BIGINT) AS cost_best_x,
       cost_zero - 7 AS cost_zero_y, CAST(floor(cost_zero * (1 - tax * 3)) AS BIGINT) AS cost_best_y,
       4096 + dx * 8 AS a_q_x, 4096 - dy * 8 AS a_q_y, sad_zero AS sad2d_zero,
       CAST(floor(sad_zero * qty / 50) AS BIGINT) AS sad2d_best, CAST(floor(sad_zero * (qty + 9) / 50) AS BIGINT) * line AS sad2d_no_x,
       CAST(floor(sad_zero * (qty + 3) / 50) AS BIGINT) * (line + 1) AS sad2d_no_y, dx - line % 3 AS dx_coarse, dy + line % 5 AS dy_coarse
FROM (SELECT l_orderkey % 200 + 1 AS poc, l_partkey % 4 AS win_i, CAST(floor((l_partkey % 16) / 4) AS BIGINT) AS win_j,
             CAST(floor(l_quantity) AS BIGINT) - 25 AS dx, CAST(l_linenumber * 4 - 16 AS BIGINT) AS dy, CAST(l_linenumber AS BIGINT) AS line,
             CAST(floor(l_extendedprice) AS BIGINT) AS cost_zero, l_discount AS disc, l_tax AS tax,
             CAST(floor(l_extendedprice * 3) AS BIGINT) AS sad_zero, l_quantity AS qty,
             row_number() OVER (PARTITION BY l_orderkey % 200, l_partkey % 16
                                ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS rn
      FROM lineitem) t
WHERE rn = 1
""",
    "f_ts": """
SELECT event_type AS series, CAST((day(ts) - 1) * 24 + hour(ts) AS BIGINT) AS frame, round(sum(value), 2) AS v,
       count(*) AS n
FROM events GROUP BY event_type, CAST((day(ts) - 1) * 24 + hour(ts) AS BIGINT)
""",
    "f_gr": """
SELECT label AS frame, y, CAST(pos AS BIGINT) AS x,
       CAST(least(255, greatest(0, floor(128 + 200 * CAST(e AS DOUBLE)))) AS BIGINT) AS v
FROM (SELECT label, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS BIGINT) AS y, embedding FROM embeddings) t
LATERAL VIEW posexplode(embedding) p AS pos, e
""",
    "f_lk": """
SELECT page_id AS line_no,
       CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN concat('"', url, '",') WHEN 2 THEN concat(url, '   # note')
            WHEN 3 THEN '# comment only' WHEN 4 THEN '' ELSE concat(substr(md5(url), 1, 11), ',') END AS line
FROM pages
""",
    "f_md": """
SELECT doc_id AS frame, md5(text) AS expected,
       CASE WHEN doc_id % 17 = 0 THEN md5(concat(text, 'x')) WHEN doc_id % 23 = 0 THEN NULL ELSE md5(text) END AS actual
FROM documents
""",
    "f_tr": """
SELECT CAST(r_regionkey AS BIGINT) AS id, CAST(NULL AS BIGINT) AS parent, r_name AS type FROM region
UNION ALL SELECT CAST(n_nationkey AS BIGINT) + 100, CAST(n_regionkey AS BIGINT), n_name FROM nation
UNION ALL SELECT c_custkey + 1000, CAST(c_nationkey AS BIGINT) + 100, c_mktsegment FROM customer
""",
}

#: Where DuckDB spells a view otherwise.
DUCKDB_SQL = {
    "f_gr": """
SELECT label AS frame, y, CAST(pos - 1 AS BIGINT) AS x,
       CAST(least(255, greatest(0, floor(128 + 200 * CAST(embedding[pos] AS DOUBLE)))) AS BIGINT) AS v
FROM (SELECT label, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS BIGINT) AS y, embedding FROM embeddings) t,
     LATERAL (SELECT unnest(range(1, 65)) AS pos) p
""",
}


def sample_table(lineitem: DataFrame, size: int = SPAN) -> DataFrame:
    """The view f_st without a window over a track: samples and chunks are numbered in blocks of about `size` rows of all tracks by order key, and
    a row a block tells how many came before. The rows are written, for queries look at them several times."""
    rows = lineitem.selectExpr("l_orderkey % 4 AS track", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "CAST(floor(l_extendedprice) AS BIGINT) AS size", "CAST(floor(l_quantity / 25) AS BIGINT) + 1 AS delta", "l_returnflag = 'R' AS sync")
    s = lineitem.agg(F.min("l_orderkey").alias("low"), F.max("l_orderkey").alias("high"), F.count("l_orderkey").alias("n")).first()
    width = max(1, (s.high - s.low + 1) * size // s.n) if s.n else 1
    # Rows without an order key are a track and a block of their own, by numbers that no key has.
    keys = {"_track": F.coalesce("track", F.lit(4)), "_block": F.coalesce(span(F.col("l_orderkey") - (s.low or 0), width), F.lit(-1))}
    rows = rows.withColumns(keys)
    orders = rows.groupBy(*keys, "l_orderkey").agg(F.count("*").alias("n"))
    blocks = orders.groupBy(*keys).agg(F.sum("n").alias("samples"), F.count("*").alias("chunks"))
    before = Window.partitionBy("_track").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*keys, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}") for c in ("samples", "chunks")])
    inside = Window.partitionBy(*keys)
    at = {"sample": F.row_number().over(inside.orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "size")), "chunk": F.dense_rank().over(inside.orderBy("l_orderkey"))}
    out = rows.withColumns(at).join(blocks, [*keys])
    return written(out.select("track", *[(F.col(f"_{c}s") + F.col(c)).alias(c) for c in at], "size", "delta", "sync"), "samples")


#: Where Spark builds a view otherwise than by its SQL, which would put a track in one task. Rows are the same.
SPARK = {"f_st": (sample_table, "lineitem")}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view by name, or a table of the folder."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name in SPARK:
        build, *tables = SPARK[name]
        return build(*[fixture(spark, sf_dir, t) for t in tables])
    sql = SQL[name]
    for t in TABLES:
        if t in sql:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(sql)


def duckdb_with(names: tuple[str, ...], sql: str) -> str:
    """`sql` with the views it uses as common table expressions."""
    views = [f"{n} AS ({DUCKDB_SQL.get(n, SQL.get(n)).strip()})" for n in names if n in SQL]
    if not views:
        return sql
    head, recursive = sql.lstrip(), ""
    if head[:15].upper().startswith("WITH RECURSIVE "):
        recursive, head = "RECURSIVE ", head[15:]
        return f"WITH {recursive}{', '.join(views)}, {head}"
    if head[:5].upper() == "WITH ":
        return f"WITH {', '.join(views)}, {head[5:]}"
    return f"WITH {', '.join(views)} {head}"
