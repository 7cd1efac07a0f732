import unicodedata

from tessella.llm.skeleton import canonical_text, look_alike_classes, look_alike_pairs, prototypes, skeleton


def test_same_look():
    same = [("Phase II trial", "Ｐhase II trial"), ("café", "café"), ("a b", "a b"), ("a b", "a b"), ("ab", "a​b"), ("find", "ﬁnd"), ("paper", "рареr"), ("Νew", "New"), ("⽤药", "用药"), ("Å", "Å"), ("a\nb", "a\r\nb"), ("ﾄ", "ト"), ("well-known", "well‑known"), ("нет", "нет")]
    for a, b in same:
        assert skeleton(a) == skeleton(b), (a, b)


def test_other_look():
    other = [("a1", "a2"), ("Alpha", "alpha"), ("resume", "résumé"), ("α", "a"), ("10⁵", "105"), ("a b", "a  b"), ("κ", "k"), ("γ", "y"), ("a b", "ab"), ("l", "1"), ("O", "0")]
    for a, b in other:
        assert skeleton(a) != skeleton(b), (a, b)


def test_stable():
    for text in ("", "abc", "Ｐhаѕе​ ⅠⅡ é ﬁ", "한국어", "🙂", "x" * 100_000):
        assert skeleton(skeleton(text)) == skeleton(text)
    assert skeleton(None) is None
    table = prototypes()
    assert all(table.get(ord(c), c) == c for form in table.values() for c in unicodedata.normalize("NFD", form))


def test_pairs(spark):
    rows = [(1, "a b", 0), (2, "a b", 1), (3, "a b", 2), (4, None, 3), (5, "", 4), (6, "​", 5), (7, "A b", 6), (2, "a b", 7), (None, "a b", 8)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n int")
    assert sorted(map(tuple, look_alike_pairs(df).collect())) == [(1, 2), (2, 3), (5, 6)]
    assert look_alike_pairs(df.limit(0)).count() == 0
    assert sorted(map(tuple, look_alike_classes(df).collect())) == [(1, 1, 2, 3), (2, 1, 2, 3), (3, 1, 2, 3), (5, 5, 2, 2), (6, 5, 2, 2)]
    assert look_alike_classes(df.limit(0)).count() == 0
    clash = df.selectExpr("doc_id", "text", "n as k", "n as s", "n as t", "n as a", "n as blocks")
    assert look_alike_pairs(clash).count() == 3


def test_hot_group(spark):
    n = 3000
    df = spark.createDataFrame([(i, "hot text" if i else "hot text") for i in range(n)], "doc_id bigint, text string")
    assert look_alike_pairs(df).count() == n - 1


def test_canonical(spark):
    df = spark.createDataFrame([("Ｒésumé х",), (None,)], "text string")
    assert [r.canonical for r in canonical_text(df).collect()] == ["Résumé x", None]
