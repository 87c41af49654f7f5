"""Every registered query of the engine against DuckDB on the same tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from pagelake.plans import queries as core

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def values(frame, columns):
    return sorted(str([None if x != x or x is None else x for x in row]) for row in frame[columns].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_query(spark, sf, duck, name):
    got, want = core.QUERIES[name](spark, sf).toPandas(), duck.execute(core.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert values(got, columns) == values(want, columns)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["source", "pages", "cost_usd", "errors"] and df.count() == 20


def test_registry():
    assert set(core.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert set(core.QUERIES) == set(core.ORACLES)
