"""The op queries: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, html_text, importance, language, lexical, ngram_join, packing, quality, secret_scan, substring_dedup, token_counts, token_files


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).withColumn("fold", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3)
    model = language.train(docs.where("fold != 1"))
    ids = language.predict(docs, model)
    return ids.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False)))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked_classes(_documents(spark, sf_dir))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read(spark, manifest)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_documents(spark, sf_dir))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(_documents(spark, sf_dir))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return secret_scan.scan(docs, secret_scan.calibrate(docs))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, fields=("source", "text"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return html_text.extract(pages, html_text.train(pages))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(_documents(spark, sf_dir), _benchmark(spark, sf_dir))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(_documents(spark, sf_dir), _benchmark(spark, sf_dir))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(_documents(spark, sf_dir), _benchmark(spark, sf_dir))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_language_id": op2_language_id,
    "op3_ngram_join": op3_ngram_join,
    "op4_token_files": op4_token_files,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_quality": op6_quality,
    "op7_secret_scan": op7_secret_scan,
    "op8_token_counts": op8_token_counts,
    "op9_html_text": op9_html_text,
    "op10_decontaminate": op10_decontaminate,
    "op11_packing": op11_packing,
    "op12_lexical_search": op12_lexical_search,
    "op13_importance_resampling": op13_importance_resampling,
}

def _words(text: str) -> str:
    """DuckDB: the words of a text."""
    return rf"list_filter(regexp_split_to_array(coalesce({text}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


#: DuckDB SQL by the plain definitions: all pairs that share a shingle and their closure; every window numbered among its equals.
ORACLES: dict[str, str] = {
    "op3_ngram_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_words(_LOWER)} AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' '))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS sh FROM w),
u AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS t FROM s),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k, any_value(a.n) AS n, any_value(b.n) AS m FROM u a JOIN u b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM c WHERE 100 * k >= 75 * (n + m - k)), e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM s UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc_id)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, m.component_id FROM s JOIN (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id) m USING (doc_id)""",
    "op5_substring_dedup": f"""
WITH w AS (SELECT doc_id, {_words('text')} AS ws FROM documents), p AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (SELECT doc_id, i, ws[i] AS word, CASE WHEN i + 19 <= len(ws) THEN array_to_string(ws[i : i + 19], ' ') END AS run FROM p),
f AS (SELECT doc_id, i, word, CASE WHEN run IS NOT NULL AND row_number() OVER (PARTITION BY run ORDER BY doc_id, i) > 1 THEN 1 ELSE 0 END AS again FROM g),
k AS (SELECT doc_id, i, word, max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS cut FROM f),
t AS (SELECT doc_id, CAST(sum(cut) AS BIGINT) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (cut = 0) AS kept FROM k GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, coalesce(t.n_removed, 0) AS n_removed, sha256(coalesce(t.kept, '')) AS kept_sha256 FROM w LEFT JOIN t USING (doc_id)""",
    "op12_lexical_search": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ws FROM documents), i AS (SELECT row_number() OVER () AS q, item_id, unnest({_TERMS}) AS w FROM benchmark),
c AS (SELECT count(*) FILTER (len(ws) > 0) AS n, CAST(sum(len(ws)) AS BIGINT) AS l FROM d), u AS (SELECT r, unnest(ws) AS w FROM d),
t AS (SELECT r, w, count(*) AS tf FROM u SEMI JOIN i USING (w) GROUP BY r, w), df AS (SELECT w, CAST(floor(1000 * ln((2 * c.n + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM t, c GROUP BY w, c.n),
m AS (SELECT r, doc_id, 75 + ((25 * len(ws) * c.n) // c.l) AS m FROM d, c),
s AS (SELECT q, item_id, r, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM i JOIN df USING (w) JOIN t USING (w) JOIN m USING (r) GROUP BY q, item_id, r, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 20""",
    "op13_importance_resampling": f"""
WITH RECURSIVE bits(i, k, c) AS (SELECT range, 0, range FROM range(256) UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
x AS (SELECT 's' AS side, row_number() OVER () AS r, doc_id, text FROM documents UNION ALL SELECT 't', row_number() OVER (), item_id, text FROM benchmark),
w AS (SELECT side, r, doc_id, {_TERMS} AS ws FROM x),
f AS (SELECT side, r, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS g FROM w),
g AS (SELECT g, hex(g) AS hx FROM (SELECT DISTINCT g FROM f)),
v AS (SELECT g, list_transform(range(len(hx) // 2), lambda i: 16 * instr('123456789ABCDEF', hx[2 * i + 1]) + instr('123456789ABCDEF', hx[2 * i + 2])) AS bs FROM g),
b AS (SELECT g, xor(list_reduce(bs, lambda a, y: xor(a // 256, t[xor(a, y) % 256 + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM v, crc),
n AS (SELECT bucket, count(*) FILTER (side = 's') AS s, count(*) FILTER (side = 't') AS t FROM f JOIN b USING (g) GROUP BY bucket), z AS (SELECT sum(s) AS s, sum(t) AS t FROM n),
e AS (SELECT bucket, CAST(floor(1000 * ln((CAST(n.t AS DOUBLE) + 1) * (CAST(z.s AS DOUBLE) + 10000) / ((CAST(n.s AS DOUBLE) + 1) * (CAST(z.t AS DOUBLE) + 10000)))) AS BIGINT) AS gain FROM n, z),
a AS (SELECT r, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS total FROM f JOIN b USING (g) JOIN e USING (bucket) WHERE side = 's' GROUP BY r),
p AS (SELECT r, doc_id, len(ws) AS n_words, coalesce(n_features, 0) AS n_features, CAST(coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0) AS BIGINT) AS weight,
  CAST('0x' || sha256('7:' || doc_id)[1:8] AS BIGINT) AS h FROM w LEFT JOIN a USING (r) WHERE side = 's'),
o AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score, n_words >= 20 AS able FROM p),
y AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS place, 25 * count(*) OVER (PARTITION BY able) // 100 AS most FROM o)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= most THEN place END AS rank FROM y""",
}
