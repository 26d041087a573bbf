"""Every query with SQL against DuckDB on the smallest tables; every other gives rows."""

import math

import duckdb
import pytest

import cadenza.queries as Q

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    return con


def norm(x):
    if isinstance(x, (list, tuple)):
        return str([norm(y) for y in x])
    if x is None or isinstance(x, (bool, str)):
        return str(x)
    return "nan" if math.isnan(x) else repr(float(x))


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, duck, name):
    df = Q.QUERIES[name](spark, D)
    cols = sorted(df.columns)
    rows = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    if name not in Q.ORACLE_SQL:
        assert rows
        return
    cur = duck.execute(Q.ORACLE_SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert rows == sorted(tuple(norm(r[i]) for i in at) for r in cur.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(Q.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
