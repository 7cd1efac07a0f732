import os

import pytest

import __spark_entry__ as entry
from tessella.catalogue import COVERS, QUERIES, SQL


def test_registry():
    assert set(SQL) <= set(QUERIES) == set(COVERS)
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(entry.SMALL), reason="no test data here")
def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["o_orderkey", "o_custkey", "o_totalprice", "o_day"]
    rows = df.collect()
    assert len(rows) <= 20 and [r.o_totalprice for r in rows] == sorted((r.o_totalprice for r in rows), reverse=True)
