import os

import duckdb
import pytest

from tessella.llm.queries import QUERIES, SQL

DATA = os.environ.get("TESSELLA_TEST_DATA", "/root/testdata/sf0.001")
COLUMNS = {
    "p1_found": "page_id bigint, block_n int", "p2_found": "code_a string, code_b string", "p4_found": "field string, page_id bigint, line_no int, kind string, word string", "p5_found": "rec_id bigint, para_no int, lang string",
    "p7_found": "name_a string, name_b string", "p8_ids": "doc_id bigint, ids array<int>", "p9_found": "doc_id bigint, item_id bigint", "p10_found": "doc_a bigint, doc_b bigint",
}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_runs(spark, name):
    df = QUERIES[name](spark, DATA)
    rows = [tuple(map(str, r)) for r in df.collect()]
    assert len(rows) == len(set(rows))
    if name in COLUMNS:
        assert ", ".join(f"{a} {b}" for a, b in df.dtypes) == COLUMNS[name]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f[:-8]} as select * from read_parquet('{DATA}/{f}')")
    df = QUERIES[name](spark, DATA)
    cur = con.execute(SQL[name])
    columns = [c[0] for c in cur.description]
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(cur.fetchall())
