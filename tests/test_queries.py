"""Every query against its SQL in DuckDB; those without SQL run and have rows."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__
from tracelane.plans import registry


def same(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{data}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, data, name):
    df = registry.QUERIES[name](spark, data)
    rows = df.collect()
    if name not in registry.ORACLE_SQL:
        assert rows
        return
    found = duck.sql(registry.ORACLE_SQL[name])
    at = [found.columns.index(c) for c in df.columns]
    assert sorted(df.columns) == sorted(found.columns)
    got = sorted(tuple(map(same, r)) for r in rows)
    want = sorted(tuple(same(r[i]) for i in at) for r in found.fetchall())
    assert got == want


def test_entry(spark):
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test data")
    assert __spark_entry__.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
