import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from latticework import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def cells(df):
    def one(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return None
        return round(float(x), 4) if isinstance(x, (int, float)) else x

    return sorted(map(repr, (tuple(one(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, DATA).toPandas()
    sql = entry.oracle_sql().get(name)
    assert len(df)
    if sql:
        assert cells(df) == cells(con.execute(sql).df())


def test_entry(spark):
    assert entry.entry(spark).count() == 5


def test_components_of_all_lineitems(spark, con):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for i, j in con.execute("select distinct l_orderkey, -1 - l_partkey from lineitem").fetchall():
        x, y = root(i), root(j)
        up[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in entry.queries()["connected_components_all"](spark, DATA).collect()}
    assert got == {x: root(x) for x in list(up)}
