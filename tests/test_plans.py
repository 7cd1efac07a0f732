"""Plans that must stay as they are meant."""

import pytest
from pyspark.sql import functions as F

from tessella.plans import aggregates as A
from tessella.plans.pairs import split_join
from tessella.plans.query import Op, Page, Query, get_page, inner_hits, order_columns, page_after, where
from tessella.plans.runtime import broadcast_if_small, cut, let, release, spread


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).selectExpr("id", "id % 7 as a", "cast(id as string) as b").write.parquet(path)
    df = get_page(spark.read.parquet(path), Page(where(Op.GT, "a", 3) & where(Op.EQ, "b", "17"), fields=["a"]))
    text = plan(df)
    assert "PushedFilters: [IsNotNull(a), IsNotNull(b), GreaterThan(a,3), EqualTo(b,17)]" in text
    assert "ReadSchema: struct<a:bigint,b:string>" in text
    assert "TakeOrderedAndProject" in plan(get_page(spark.read.parquet(path), Page(Query(), ("a", "id"), 1, 5)))


def test_missing_values(spark):
    df = spark.createDataFrame([(1, "a"), (2, ""), (3, None), (4, "b")], "k int, v string")
    pick = lambda q: [r.k for r in df.where(q.column()).orderBy("k").collect()]
    assert pick(where(Op.EQ, "v")) == [3] and pick(where(Op.EQ, "v", "None")) == [2, 3] and pick(where(Op.EQ, "v", "a")) == [1]
    assert pick(where(Op.NE, "v")) == [1, 2, 4] and pick(where(Op.NE, "v", "None")) == [1, 4] and pick(where(Op.NE, "v", "a")) == [2, 3, 4]
    assert pick(where(Op.IN, "v")) == [3] and pick(where(Op.IN, "v", None, "a")) == [1, 3] and pick(where(Op.NOT_IN, "v", "a")) == [2, 3, 4]
    assert pick(where(Op.NOT_IN, "v", None, "a")) == [2, 4] and pick(where(Op.NOT_IN, "v")) == [1, 2, 4] and pick(~where(Op.EQ, "v", "a")) == [2, 3, 4]
    assert [r.k for r in df.orderBy(*order_columns(["v", "k"])).collect()] == [2, 1, 4, 3] and [r.k for r in df.orderBy(*order_columns([("v", "desc")])).collect()][-1] == 3
    with pytest.raises(ValueError):
        where(Op.IDS, "k", None, "")
    with pytest.raises(ValueError):
        where(Op.BETWEEN, "k", 1, None).column()
    with pytest.raises(ValueError):
        where(Op.IN, "k", *range(1001))


def test_pages_cover(spark):
    df = spark.range(23).withColumn("g", F.col("id") % 3)
    seen, last = [], None
    while True:
        rows = page_after(df, ["g", "id"], last, 5).collect()
        if not rows:
            break
        seen += [r.id for r in rows]
        last = [rows[-1].g, rows[-1].id]
    assert seen == [r.id for r in df.orderBy("g", "id").collect()]


def test_inner_hits_limit(spark):
    df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(300)), lambda x: F.struct(x.alias("n"))).alias("a"))
    assert len(df.select(inner_hits("a", where(Op.GT, "n", 50)).alias("h")).first().h) == 100


def test_extremes(spark):
    df = spark.createDataFrame([(1, 5, None), (1, 5, 7), (1, 5, 6), (1, 9, None), (1, 1, 2)], "g int, a int, b int")
    r = df.groupBy("g").agg(A.metric("max_other", "a", "b").alias("hi"), A.metric("min_other", "a", "b").alias("lo")).first()
    assert (r.hi, r.lo) == (6, 2)


def test_runtime(spark):
    df = spark.range(10)
    kept = cut(df)
    assert kept.count() == 10 and "Range" not in plan(kept)
    release()
    assert "BroadcastHint" not in df._jdf.queryExecution().analyzed().toString()
    assert broadcast_if_small(df, 1)._jdf.queryExecution().analyzed().toString().find("broadcast") == -1
    assert df.select(let(F.col("id") + 1, lambda x: x * x).alias("y")).agg(F.sum("y")).first()[0] == sum((i + 1) ** 2 for i in range(10))


def test_spread_runs_nothing_ahead(spark):
    """What stands before ``spread`` is computed once, in the action."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    df = spark.range(1000).mapInPandas(count, "id bigint").groupBy((F.col("id") % 7).alias("g")).count()
    dealt = spread(df)
    assert seen.value == 0
    assert dealt.count() == 7 and seen.value == 1000


@pytest.mark.parametrize("block", [1, 3, 20_000])
def test_split_join(spark, block, monkeypatch):
    """The same rows as a plain join, whatever the split; null keys meet nothing and stay in a left join."""
    monkeypatch.setattr("tessella.plans.pairs.SMALL", 0 if block < 20_000 else 8 << 20)
    left = spark.createDataFrame([(k, i, ["x"]) for i, k in enumerate(["hot"] * 50 + ["a", "b", None, None, "", "a"])], "k string, i int, v array<string>")
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("a", 3), (None, 4), ("", 5), ("c", 6)], "k string, r int")
    for how in ("inner", "left"):
        got = sorted(map(str, split_join(left, right, "k", how, block).select("k", "i", "v", "r").collect()))
        assert got == sorted(map(str, left.join(right, "k", how).select("k", "i", "v", "r").collect()))
    assert split_join(left.limit(0), right, "k", "left", block).count() == 0 == split_join(left, right.limit(0), "k", "inner", block).count()
    with pytest.raises(ValueError):
        split_join(left, right, "k", "outer")
