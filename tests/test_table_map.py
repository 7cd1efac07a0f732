import time

from pyspark.sql import functions as F

from tessella.catalogue import QUERIES
from tessella.functions import extract as X


def test_later_rows_win(spark):
    rows = [["A b", "1"], ["c", "2", "3"], [None, "4"], ["aB", "5"], ["d"], [None, "6"]]
    got = spark.createDataFrame([(rows,), ([],), (None,)], "r array<array<string>>").select(X.rows_to_map(F.col("r")).alias("m")).select("m", F.map_keys("m").alias("k")).collect()
    assert [r.m for r in got] == [{"ab": ["5"], "c": ["2", "3"], "d": []}, {}, None]
    assert got[0].k == ["c", "ab", "d"]


def test_long_table(spark, tmp_path):
    began = time.time()
    long = spark.range(20_000).select(F.transform(F.sequence(F.lit(1), F.lit(20_000)), lambda i: F.array(F.concat(F.lit("k"), (i % 7).cast("string")), i.cast("string"))).alias("r"), "id").where("id = 3")
    assert long.select(X.rows_to_map(F.col("r")).alias("m")).first().m == {f"k{i % 7}": [str(i)] for i in range(19_994, 20_001)}
    spark.range(40_000).selectExpr("id as c_custkey", "int(id % 2) as c_nationkey", "case when id % 4 = 1 then 'AUTOMOBILE' when id % 5 > 0 then concat('S', id % 3) end as c_mktsegment").write.parquet(f"{tmp_path}/customer.parquet")
    assert [tuple(r) for r in QUERIES["q_table_map"](spark, str(tmp_path)).collect()] == [(1, "AUTOMOBILE")]
    assert time.time() - began < 60
