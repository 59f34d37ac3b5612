"""Queries of the registry against their SQL, over the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from captrix import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    return con


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["file_id", "n_cues", "first_ms", "last_ms"] and df.count() > 0


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, tables, name):
    got = registry.QUERIES[name](spark, SF)
    want = tables.execute(registry.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(repr, (tuple(r) for r in got.select(*names).collect()))) == sorted(map(repr, want.fetchall()))
