"""Every query with SQL against DuckDB, every other one for running, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = os.environ.get("TESSELLA_TEST_DATA", "/root/testdata/sf0.001")
TABLES = sorted(f[:-8] for f in os.listdir(DATA) if f.endswith(".parquet")) if os.path.isdir(DATA) else []
pytestmark = pytest.mark.skipif(not TABLES, reason="no test data here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 4)
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return float(x) if type(x).__name__ == "Decimal" else x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=lambda r: tuple((x is not None, str(x)) for x in r))


CORE = {k: v for k, v in entry.queries().items() if k in __import__("tessella.catalogue", fromlist=["QUERIES"]).QUERIES}
SQL = entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(set(CORE) & set(SQL)))
def test_equals_sql(spark, duck, name):
    df = CORE[name](spark, DATA)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(SQL[name])
    want = rows([c[0] for c in cur.description], cur.fetchall())
    assert sorted(df.columns) == sorted(c[0] for c in cur.description)
    assert len(got) == len(want)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(CORE) - set(SQL)))
def test_runs(spark, name):
    df = CORE[name](spark, DATA)
    assert len(df.columns) == len(set(df.columns))
    df.collect()
