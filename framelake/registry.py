"""Every registered query of the telemetry library and its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixtures import duckdb_with, fixture
from .operators.scan import steady

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, *views: str, oracle: str | None = None) -> Callable:
    """Register a function of the named views (or tables) as a query; `oracle` is DuckDB SQL over the same names."""

    def add(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            steady(spark)
            return build(*[fixture(spark, sf_dir, v) for v in views])

        QUERIES[name] = run
        if oracle:
            ORACLES[name] = duckdb_with(views, oracle)
        return build

    return add


from . import queries  # noqa: E402, F401  registers them
