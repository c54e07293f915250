"""Queries that SQL can express, on the smallest tables."""

import duckdb
import pytest

from inkfall.llm.queries import oracle_sql, queries

from .conftest import SMALL


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    want = con.sql(oracle_sql()[name])
    df = queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, df.select(*columns).collect())) == sorted(map(key, want.select(*columns).fetchall()))
