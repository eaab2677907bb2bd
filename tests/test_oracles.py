"""Every registered telemetry query against its DuckDB twin on the smallest tables."""

import decimal
import math

import duckdb
import pytest

from framelake import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return v


def key(row):
    return tuple((v is None, str(v)) for v in row)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, small, duck, name):
    df = registry.QUERIES[name](spark, small)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=key)
    if name not in registry.ORACLES:
        assert got
        return
    q = duck.execute(registry.ORACLES[name])
    at = {d[0]: i for i, d in enumerate(q.description)}
    assert sorted(at) == names
    assert got == sorted((tuple(plain(r[at[c]]) for c in names) for r in q.fetchall()), key=key)
