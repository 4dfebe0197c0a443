"""Every query with SQL gives DuckDB's rows on the smallest tables."""

from __future__ import annotations

import decimal
import os

import duckdb
import pytest

import quirework.queries  # noqa: F401
from quirework.registry import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck() -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v: object) -> object:
    if isinstance(v, decimal.Decimal):
        v = float(v)
    return round(v, 6) if isinstance(v, float) else v


def ordered(rows: list[tuple]) -> list[tuple]:
    return sorted(rows, key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):  # noqa: ANN001, ANN201
    df = QUERIES[name](spark, SF)
    rel = duck.sql(ORACLES[name])
    names = sorted(rel.columns)
    assert sorted(df.columns) == names
    ours = ordered([tuple(plain(r[n]) for n in names) for r in df.collect()])
    theirs = ordered([tuple(plain(r[rel.columns.index(n)]) for n in names) for r in rel.fetchall()])
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):  # noqa: ANN001, ANN201
    QUERIES[name](spark, SF).limit(5).collect()
