import random

from tessella.operators.components import components
from tessella.operators.hierarchy import claim_trees, hierarchy
from tessella.plans.pairs import pairs_within
from tessella.operators import terms as G


def brute(nodes):
    out = {}
    for s, n in nodes:
        path, seen, x = [n], {n}, n
        while True:
            p = nodes[s, x]
            if p is None or (s, p) not in nodes:
                out[s, n] = (path[-1], len(path) - 1, "/".join(map(str, reversed(path))))
                break
            if p in seen:
                out[s, n] = (None, -1, "")
                break
            seen.add(p)
            path.append(p)
            x = p
    return out


def test_random_forests(spark):
    rng = random.Random(1)
    nodes = {(f"s{rng.randrange(4)}", i): rng.choice([None, *range(max(0, i - 30), i + 2)]) for i in range(300)}
    df = spark.createDataFrame([(s, n, p) for (s, n), p in nodes.items()], "scope string, node int, parent int")
    got = {(r.scope, r.node): (r.root, r.depth, r.path) for r in hierarchy(df).collect()}
    want = brute(nodes)
    assert got == want
    desc = {k: 0 for k in nodes}
    for (s, n), (_, depth, path) in want.items():
        for a in path.split("/")[:-1] if depth > 0 else []:
            desc[s, int(a)] += 1
    for r in hierarchy(df).collect():
        assert r.n_desc == (-1 if r.depth < 0 else desc[r.scope, r.node])


def test_claims(spark):
    rows = [(1, "cn 1-A", 1, None), (2, "CN1A", 2, "1"), (3, "CN1A", 3, "2/1"), (4, "CN1A", 3, "1"), (5, "CN1A", 4, "9"), (6, "X", 1, "2"), (7, "X", 2, "1"), (8, "X", 3, "2"), (9, None, 1, "1"), (10, "Y", None, "1"), (11, "Z", 5, "5"), (12, "CN1A", 2, "1")]
    df = spark.createDataFrame(rows, "claim_id bigint, patent_code string, claim_num int, claim_ref_pre string")
    got = {(r.code, r.claim_num): tuple(r)[2:] for r in claim_trees(df).collect()}
    assert got == {("CN1A", 1): (1, 0, "1", 2), ("CN1A", 2): (1, 1, "1/2", 1), ("CN1A", 3): (1, 2, "1/2/3", 0), ("CN1A", 4): (4, 0, "4", 0), ("X", 1): (-1, -1, "", -1), ("X", 2): (-1, -1, "", -1), ("X", 3): (-1, -1, "", -1), ("Z", 5): (-1, -1, "", -1)}
    assert claim_trees(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000, x) for x in range(1001, 1400)] + [(x, x + 1) for x in range(2000, 2060)] + [(5000, 5000), (None, 1), (1, None)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            parent[find(a)] = find(b)
    got = {r.vertex: r.component for r in components(df).collect()}
    assert set(got) == set(parent)
    groups = {}
    for v in parent:
        groups.setdefault(find(v), set()).add(got[v])
    assert all(len(c) == 1 for c in groups.values()) and len({next(iter(c)) for c in groups.values()}) == len(groups)
    assert components(df.limit(0)).count() == 0


def test_pairs(spark):
    df = spark.createDataFrame([("g", i) for i in range(2100)] + [("h", 1), (None, 2), (None, 3), ("g", 5)], "g string, k int")
    assert pairs_within(df, "g", "k", "a", "b").count() == 2100 * 2099 // 2


def test_terms(spark):
    e = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "c"), ("d", "x"), ("y", "z"), ("z", "y"), (None, "a"), ("a", None), ("q", "q")], "child string, parent string")
    closed = {(r.descendant, r.ancestor): r.depth for r in G.closure(e).collect()}
    assert closed[("d", "a")] == 3 and closed[("d", "x")] == 1 and ("y", "y") not in closed and closed[("y", "z")] == 1 and ("q", "q") not in closed
    tags = spark.createDataFrame([(1, "a"), (1, "d"), (2, "a"), (3, "y"), (3, "z")], "k int, term string")
    assert sorted(map(tuple, G.drop_ancestors(tags, G.closure(e), "k", "term").collect())) == [(1, "d"), (2, "a"), (3, "y"), (3, "z")]
    assert G.closure(e.limit(0)).count() == 0
