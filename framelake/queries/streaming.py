"""Queries of the streaming jobs (SS): the events table replayed as a file stream of several micro-batches, in order of time or of event_id."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import registry
from ..fixtures import duckdb_with
from ..sources.store import scratch
from ..streaming import jobs


BATCHES = 4  # micro-batches that the table is replayed in


def _table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def _events(spark: SparkSession, sf_dir: str, order: str = "ts", end: str | None = None) -> DataFrame:
    return jobs.replayed(_table(spark, sf_dir), order, BATCHES, end)


def _add(name: str, oracle: str | None = None):  # noqa: ANN202
    def add(build):  # noqa: ANN001, ANN202
        registry.QUERIES[name] = build
        if oracle:
            registry.ORACLES[name] = oracle
        return build

    return add


@_add("ss1_incremental_frame_index", "SELECT user_id AS stream, event_id AS pos, CASE WHEN event_type <> 'view' THEN CAST(sum(CASE WHEN event_type <> 'view' THEN 1 ELSE 0 END) OVER w - 1 AS BIGINT) END AS coding_order, CASE WHEN event_type IN ('view', 'click', 'purchase') THEN CAST(sum(CASE WHEN event_type IN ('view', 'click', 'purchase') THEN 1 ELSE 0 END) OVER w - 1 AS BIGINT) END AS display_index FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def ss1(spark, sf_dir):  # noqa: ANN001, ANN201
    e = _events(spark, sf_dir, "event_id").select(F.col("user_id").cast("long").alias("stream"), F.col("event_id").cast("long").alias("pos"), F.col("event_id").cast("long").alias("coded_id"), (F.col("event_type") == "view").cast("int").alias("show_existing"), (F.col("event_id") % 8).alias("map_idx"), F.col("event_type").isin("click", "purchase").cast("int").alias("show_frame"), ((F.col("event_id") * 37) % 256).alias("refresh_flags"))
    return jobs.run_available(jobs.incremental_frame_index(e), "append").select("stream", "pos", "coding_order", "display_index")


@_add("ss2_late_sse_join", "SELECT event_id AS key, value AS bits, CASE WHEN event_id % 5 <> 0 THEN value * 2 END AS sse, CASE WHEN event_id % 5 <> 0 THEN 'ok' ELSE 'skipped' END AS state FROM events")
def ss2(spark, sf_dir):  # noqa: ANN001, ANN201
    table = _table(spark, sf_dir)
    path, files = jobs.replay(table, "ts", BATCHES, "1 DAY")
    e = [jobs.read_stream(spark, path, table.schema, files) for _ in "ab"]
    bits = e[0].select(F.col("event_id").alias("key"), "ts", F.col("value").alias("bits"))
    sse = e[1].where("event_id IS NULL OR event_id % 5 <> 0").select(F.col("event_id").alias("key"), (F.col("ts") + F.expr("INTERVAL 5 MINUTES")).alias("ts"), (F.col("value") * 2).alias("sse"))
    return jobs.run_available(jobs.late_sse_join(bits, sse, "10 MINUTES"), "append").where("key IS NOT NULL").select("key", "bits", "sse", "state")


@_add("ss3_running_totals", "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type")
def ss3(spark, sf_dir):  # noqa: ANN001, ANN201
    out = jobs.run_available(jobs.running_totals(_events(spark, sf_dir), ["event_type"]), "complete")
    return out.withColumn("total", F.round("total", 2))


_CAUSAL = """WITH RECURSIVE r AS (SELECT event_type AS series, event_id AS frame, CAST(value AS DOUBLE) AS v, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events),
s AS (SELECT series, frame, v, k, v AS x0, 0.0::DOUBLE AS x1, 4e6::DOUBLE * 4 / (4e6::DOUBLE + 4) AS p00, 0.0::DOUBLE AS p01, 4e6::DOUBLE AS p11 FROM r WHERE k = 1
UNION ALL SELECT n.series, n.frame, n.v, n.k, x + a / (a + 4) * (n.v - x), y + b / (a + 4) * (n.v - x), (1 - a / (a + 4)) * a, (1 - a / (a + 4)) * b, c - b / (a + 4) * b
FROM (SELECT series, k, x0 + x1 AS x, x1 AS y, p00 + 2 * p01 + p11 + 0.0005::DOUBLE AS a, p01 + p11 + 0.001::DOUBLE AS b, p11 + 0.002::DOUBLE AS c FROM s) q JOIN r n ON n.series = q.series AND n.k = q.k + 1)
SELECT series, frame, round(v, 6) AS v, round(x0, 4) AS smooth FROM s"""


@_add("ss4_causal_smooth", _CAUSAL)
def ss4(spark, sf_dir):  # noqa: ANN001, ANN201
    s = _events(spark, sf_dir, "event_id").select(F.col("event_type").alias("series"), F.col("event_id").cast("long").alias("frame"), F.col("value").cast("double").alias("v"))
    return jobs.run_available(jobs.causal_smooth(s, 0.002, 4.0), "append").withColumns({"v": F.round("v", 6), "smooth": F.round("smooth", 4)})


_KBPS = "SELECT event_type AS stream, strftime({s}, '%Y-%m-%d %H:%M') AS start, count(*) AS frames, CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) AS bytes, round(sum(CAST(floor(value * 100) AS BIGINT)) * 8 / {w} / 1000, 6) AS kbps FROM {f} GROUP BY 1, 2"


def _frames(spark, sf_dir):  # noqa: ANN001, ANN202
    return _events(spark, sf_dir).select(F.col("event_type").alias("stream"), "ts", F.floor(F.col("value") * 100).alias("bytes"))


@_add("ss5_bitrate_window", _KBPS.format(s="time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '2024-01-01')", w="3600.0::DOUBLE", f="events"))
def ss5(spark, sf_dir):  # noqa: ANN001, ANN201
    return jobs.run_available(jobs.bitrate_window(_frames(spark, sf_dir), "1 hour"), "complete").withColumn("kbps", F.round("kbps", 6))


@_add("ss5_bitrate_sliding", _KBPS.format(s="s", w="7200.0::DOUBLE", f="(SELECT *, time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '2024-01-01') - INTERVAL '1 hour' * k AS s FROM events, range(0, 2) r(k))"))
def ss5_sliding(spark, sf_dir):  # noqa: ANN001, ANN201
    return jobs.run_available(jobs.bitrate_window(_frames(spark, sf_dir), "2 hours", "1 hour"), "complete").withColumn("kbps", F.round("kbps", 6))


@_add("ss6_picture_session", "WITH m AS (SELECT event_type AS stream, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL '30 minutes' THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)), g AS (SELECT *, sum(new) OVER (PARTITION BY stream ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM m) SELECT stream, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS slices FROM g GROUP BY stream, k")
def ss6(spark, sf_dir):  # noqa: ANN001, ANN201
    s = _events(spark, sf_dir).select(F.col("event_type").alias("stream"), "ts")
    return jobs.run_available(jobs.picture_session(s, "30 minutes"), "complete")


_SLICES = duckdb_with(("f_sl",), "WITH n AS (SELECT *, CASE WHEN first_mb = 0 OR lag(poc) OVER w IS NULL OR lag(poc) OVER w <> poc THEN 1 ELSE 0 END AS new FROM f_sl WINDOW w AS (PARTITION BY stream ORDER BY pos)), p AS (SELECT *, CAST(sum(new) OVER (PARTITION BY stream ORDER BY pos ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS coding_order FROM n) SELECT stream, coding_order, arg_min(poc, pos) AS poc, bool_or(nal_type = 5) AS idr, count(*) AS slices, string_agg(CAST(slice_type_id AS VARCHAR), ',' ORDER BY pos) AS types FROM p GROUP BY stream, coding_order")


@_add("ss6_marked_pictures", _SLICES)
def ss6_marked(spark, sf_dir):  # noqa: ANN001, ANN201
    e, n = _events(spark, sf_dir, end="400 DAYS"), F.col("event_id")
    s = e.select(F.col("user_id").alias("stream"), "ts", n.alias("pos"), (n % 3).alias("first_mb"), F.floor("value").alias("poc"), F.when(F.col("event_type") == "signup", 5).otherwise(1).alias("nal_type"), (n % 7 - 1).alias("slice_type_id"))
    out = jobs.run_available(jobs.marked_pictures(s, 300 * 86_400_000), "append")
    return out.withColumn("types", F.array_join("slice_type_ids", ",")).drop("slice_type_ids")


_CHANGES = "WITH t AS (SELECT user_id AS item, ts, CASE WHEN event_type = 'view' THEN '' ELSE event_type END AS text FROM events), c AS (SELECT *, text <> coalesce(lag(text) OVER (PARTITION BY item ORDER BY ts, text), '') AS changed FROM t)"


@_add("ss7_dedupe_latest", f"{_CHANGES} SELECT item, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, text FROM c WHERE changed")
def ss7(spark, sf_dir):  # noqa: ANN001, ANN201
    e = _events(spark, sf_dir).select(F.col("user_id").alias("item"), "ts", F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type")).alias("text"))
    return jobs.run_available(jobs.dedupe_latest(e), "append").withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


@_add("ss7_live_errors", f"{_CHANGES} SELECT item, text FROM (SELECT item, arg_max(text, {{'t': ts, 'x': text}}) AS text FROM t GROUP BY item) WHERE text <> ''")
def ss7_live(spark, sf_dir):  # noqa: ANN001, ANN201
    e = _events(spark, sf_dir).select(F.col("user_id").alias("item"), "ts", F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type")).alias("text"))
    changes, base = jobs.dedupe_latest(e), scratch(spark, "live")
    table = jobs.LiveTable(spark, f"{base}/table", changes.schema, ["item"], ["ts"], "text = ''")
    return jobs.run_merged(changes, table, f"{base}/checkpoint").select("item", "text")
