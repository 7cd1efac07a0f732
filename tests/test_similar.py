import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import similar as V

DATA = os.environ.get("TESSELLA_TEST_DATA", "/root/testdata/sf0.001")


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8))
    x[10] = x[11]  # a tie
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "id int, embedding array<double>")
    q = df.where("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")
    got = V.nearest(q, df.select(F.col("id").alias("item_id"), "embedding"), 5).collect()
    for i in range(0, 300, 20):
        s = np.round(x @ x[i], 9)
        want = sorted(range(300), key=lambda j: (-s[j], j))[:5]
        assert [r.item_id for r in sorted((r for r in got if r.query_id == i), key=lambda r: r.rank)] == want
    assert V.nearest(q.limit(0), df.select(F.col("id").alias("item_id"), "embedding"), 5).count() == 0
    assert V.nearest(q, df.limit(0).select(F.col("id").alias("item_id"), "embedding"), 5).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
def test_index_recall(spark):
    from tessella.catalogue import QUERIES

    exact = V.nearest(spark.read.parquet(f"{DATA}/embeddings.parquet").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), spark.read.parquet(f"{DATA}/embeddings.parquet").select(F.col("vec_id").alias("item_id"), "embedding"), 10)
    want = {(r.query_id, r.item_id) for r in exact.collect()}
    got = {(r.query_id, r.item_id) for r in QUERIES["q_ivf_topk"](spark, DATA).collect()}
    assert len(want & got) / len(want) >= 0.9


def test_near_duplicates(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, base), (2, base), (3, base + " x"), (4, "other " * 3), (5, None), (6, ""), (7, "w1 w2"), (8, " ".join(f"w{i}" for i in range(30)) + " " + " ".join(f"z{i}" for i in range(30)))]
    got = {r.doc_id: (r.class_id, r.links) for r in V.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text").collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 1), 4: (4, 0), 5: (5, 0), 6: (6, 0), 7: (7, 0), 8: (8, 0)}


def test_contained(spark):
    rows = [(1, "A new plant"), (2, "a new  plant!"), (3, "A new plants"), (4, "A new plant in town"), (5, None), (6, "xA new plants")]
    got = {r.k: r.class_id for r in V.contained_titles(spark.createDataFrame(rows, "k bigint, t string"), "k", "t").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 1}
