from __future__ import annotations

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from shardlake.queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def test_flagship(spark):
    assert [r.n for r in entry.entry(spark).collect()] == [500, 500, 500]


def test_all_queries_are_registered():
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_agrees_with_sql(spark, con, sf, name):
    frame = QUERIES[name](spark, sf)
    columns = sorted(frame.columns)
    found = sorted(str(tuple(r)) for r in frame.select(columns).collect())
    if name not in ORACLE:
        assert found
        return
    rows = con.sql(ORACLE[name])
    assert sorted(rows.columns) == columns
    assert found == sorted(map(str, con.sql(f"SELECT {', '.join(columns)} FROM ({ORACLE[name]})").fetchall()))
