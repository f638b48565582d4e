"""Each named query that SQL can express, against DuckDB on the smallest tables."""

import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry_point
from crawlsift.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float)):
        return None if math.isnan(v) else round(float(v), 6)
    return str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are absent")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, db, name):
    got = QUERIES[name](spark, SF)
    rows = got.collect()
    assert len(set(got.columns)) == len(got.columns)
    if name in ORACLES:
        found = db.execute(ORACLES[name])
        columns = [c[0] for c in found.description]
        want = [dict(zip(columns, r)) for r in found.fetchall()]
        order = sorted(columns)
        assert sorted(got.columns) == order
        assert Counter(tuple(plain(r[c]) for c in order) for r in rows) == Counter(tuple(plain(r[c]) for c in order) for r in want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are absent")
def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry_point.queries()) and set(entry_point.oracle_sql()) <= set(entry_point.queries())
