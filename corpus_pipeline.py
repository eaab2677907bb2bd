"""A training-data pipeline over `documents`: reject poor text, keep one of each near-duplicate group, drop benchmark leaks, put out secrets, encode."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from framelake.llm import bpe, decontaminate, ngram_join, quality, secret_scan


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule or lie outside their group's robust estimate go.

    Null and empty texts fail; null lang and source are groups of their own; repeated rows go or stay together; an empty table gives no row;
    very long texts are measured whole; any other columns stay as they are.
    """
    return quality.filtered(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of linked documents stays: the one with the smallest doc_id; rows that repeat a doc_id become one.

    Of these the row whose text, then whose other columns sort first stays. Rows without a doc_id or without words are all kept; an empty table
    gives no row; texts are taken whole; any other columns stay as they are.
    """
    return ngram_join.representatives(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts, null items and an empty table on either side take nothing away; repeated rows go or stay together; texts are
    searched whole; any other columns stay as they are.
    """
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret found is put out in the text; no row goes.

    Null texts stay null; repeated rows are treated alike; an empty table gives no row; texts are read whole; any other columns stay as they are.
    """
    return secret_scan.redact(docs, secret_scan.calibrate(docs))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the texts that are left, with their ids: one row for each row that comes in, null texts as empty ones, texts encoded whole."""
    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_leaks),
    ("secret scans", secrets),
    ("byte-level BPE", encoded),
]

#: Robust estimates, min-hashes and merges have no SQL form; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
