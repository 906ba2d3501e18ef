"""Every query of the engine with SQL gives the SQL's rows on the smallest tables."""

import glob
import os

import duckdb
import pytest

from gridloom import queries as Q

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(round(v, 6) + 0.0 if isinstance(v, float) else v for v in (r[i] for i in order))) for r in values)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_same_as_sql(spark, duck, name):
    df = Q.QUERIES[name](spark, DATA)
    want = duck.sql(Q.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, map(tuple, df.collect())) == rows(want.columns, want.fetchall())
