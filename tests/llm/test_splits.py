from collections import Counter

from tessella.llm.splits import assign_splits, tied_codes, tied_groups


def test_tied(spark):
    rows = [(1, "CN 1-A", "x-1"), (2, "cn1a", "y"), (3, "B2", "X1"), (4, "C3", "y"), (5, None, "y"), (6, "D4", None), (7, "", "q"), (8, "E5", "q"), (9, "F6", "z")]
    df = spark.createDataFrame(rows, "claim_id bigint, patent_code string, esid string").withColumnRenamed("x", "y")
    assert sorted(map(tuple, tied_codes(df).collect())) == [("B2", "C3"), ("B2", "CN1A"), ("C3", "CN1A")]
    assert tied_codes(df.limit(0)).count() == 0
    groups = tied_groups(df).collect()
    assert {(r.code, r.links) for r in groups} == {("B2", 2), ("C3", 2), ("CN1A", 2)} and len({r.class_id for r in groups}) == 1


def test_splits_hold_together(spark):
    rows = [(i, "HOT" if i % 3 == 0 else f"c{i % 400}", None if i % 7 == 0 else f"e{i % 350}", "x") for i in range(3000)] + [(9000 + i, None, None, "x") for i in range(500)]
    df = spark.createDataFrame(rows, "claim_id bigint, patent_code string, esid string, split string")
    got = dict(map(tuple, assign_splits(df.drop("split")).collect()))
    assert len(got) == len(rows)
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for _, c, e, _ in rows:
        if c and e:
            parent[find("c" + c)] = find("e" + e)
    seen = {}
    for i, c, e, _ in rows:
        if c or e:
            assert seen.setdefault(find("c" + c if c else "e" + e), got[i]) == got[i]


def test_shares(spark):
    df = spark.createDataFrame([(i, f"c{i % 4000}", None) for i in range(20000)], "claim_id bigint, patent_code string, esid string")
    n = Counter(r.split for r in assign_splits(df).collect())
    assert abs(n["train"] - 16000) <= 10 and abs(n["validation"] - 2000) <= 10 and abs(n["test"] - 2000) <= 10
    assert assign_splits(df.limit(0)).count() == 0
