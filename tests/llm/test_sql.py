"""Every query of this folder that SQL can express against its SQL, on whole tables."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest

from strophe.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    rel = con.execute(queries.ORACLES[name])
    there = [d[0] for d in rel.description]
    assert sorted(there) == sorted(df.columns)
    want = Counter(tuple(r[there.index(c)] for c in df.columns) for r in rel.fetchall())
    assert Counter(map(tuple, df.collect())) == want
