from tessella.operators import terms as G


def test_aunts_pair_no_leaves(spark):
    leaves = [(f"c{i}", f"n{i % 2}") for i in range(600)]
    edges = spark.createDataFrame([("n0", "r"), ("n1", "r"), ("n1", "x"), ("n2", "x"), *leaves, (None, "r"), ("n0", None)], "child string, parent string")
    got = {tuple(r) for r in G.aunts(edges, G.closure(edges)).collect()}
    assert got == {(c, a) for c, n in leaves for a in (["n1"] if n == "n0" else ["n0", "n2"])}
    parents = G.siblings(edges, of=spark.createDataFrame([("n0",), ("n1",)], "node string"))
    assert {tuple(r) for r in parents.collect()} == {("n0", "n1"), ("n1", "n0"), ("n1", "n2")}


def test_aunts_of_one_wide_parent(spark):
    wide = spark.range(60_000).selectExpr("concat('c', id) as child", "'n' as parent")
    edges = wide.unionByName(spark.createDataFrame([("n", "r"), ("m", "r")], "child string, parent string"))
    assert G.aunts(edges, G.closure(edges)).count() == 60_000
