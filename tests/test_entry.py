"""Every registered query runs, and equals its SQL where it has one."""

from __future__ import annotations

import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__
from strophe.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name in registry.ORACLES:
        rel = duck.execute(registry.ORACLES[name])
        there = [d[0] for d in rel.description]
        assert sorted(there) == columns
        want = Counter(tuple(plain(r[there.index(c)]) for c in columns) for r in rel.fetchall())
        assert got == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 20
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
