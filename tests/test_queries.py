"""Every query that has SQL gives the SQL's rows."""

import duckdb
import pytest

from inkfall import queries as Q

from .conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, con, name):
    df = Q.queries()[name](spark, DATA)
    want = con.sql(Q.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, df.select(*columns).collect())) == sorted(map(key, want.select(*columns).fetchall()))


def test_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert rows and rows[0]["out"].startswith("# ")
    assert set(entry.oracle_sql()) <= set(entry.queries())
