from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.operators import packed as P
from tessella.operators.packed import _automaton, segment, whole_values

CELLS = {
    "1/2/3": [1, 2, 3], "1.2.3": [1, 2, 3], "3.0": [3], "1至4": [1, 2, 3, 4], "1; 2-4": [1, 2, 3, 4], "[3, 7]": [3, 7], '"1","2"': [1, 2], "1 to 3": [1, 2, 3], "11, 12 and 15": [11, 12, 15], "５／８／９": [5, 8, 9], "8/": [8], "10 – 12": [10, 11, 12], "1~3": [1, 2, 3],
    "#": [], "-": [], "*": [], "0": [], "": [], " 1": [1], "10.27": [10, 27], "1/3;7、9": [1, 3, 7, 9], "4|2|1": [4, 2, 1], "3-1": [3, 2, 1], "99999999999999999999999": [], "2 or 4": [2, 4], "2,2": [2, 2],
}


def test_numbers(spark):
    df = spark.createDataFrame([*CELLS.items(), (None, None)], "c string, want array<bigint>")
    for r in df.select("c", "want", P.number_values(F.col("c")).alias("got")).collect():
        assert r.got == r.want, r.c


def test_names():
    cases = {
        "A B Inc.; C D LLC": ["A B Inc.", "C D LLC"], "A B, Inc.": ["A B, Inc."], "A B, Inc.; C": ["A B, Inc.", "C"], "A B A/S/C D LP": ["A B A/S", "C D LP"], '"B, A" | C': ["B, A", "C"], "'X, Y'、Z": ["X, Y", "Z"], "A, B and C": ["A", "B", "C"], "||A||B|": ["A", "B"], '"A ""x"" B";C': ['A "x" B', "C"],
        "H'care One; Two": ["H'care One", "Two"], "A Co., Ltd.,B": ["A Co., Ltd.", "B"], "甲公司、乙公司；丙公司": ["甲公司", "乙公司", "丙公司"], "A\nB\r\nC": ["A", "B", "C"], "未披露": [], "-": [], "": [], None: [], " A  ": ["A"], '"A': ['"A'], "Rand and Sons": ["Rand", "Sons"], "A;;B; ; C": ["A", "B", "C"], "x" * 5000: ["x" * 5000],
    }
    for cell, want in cases.items():
        assert segment(cell) == want, cell


def test_dictionary_protects():
    cells = ['"Research and Development, North";B', "B;C"]
    known = _automaton(sorted({w for c in cells for w in whole_values(c)}))
    assert segment("Research and Development, North, B", known) == ["Research and Development, North", "B"]
    assert segment("My Research and Development, North, B", known) == ["My Research", "Development", "North", "B"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.from_regex(r"[A-Z][a-z]{1,8}( [A-Z][a-z]{1,8}){0,2}", fullmatch=True), min_size=1, max_size=6), st.sampled_from([";", "; ", "|", "、", "，", ";;", "\n"]))
def test_round_trip(names, delimiter):
    names = [n for n in names if not P._legal(n.split()[-1])] or ["One"]
    assert segment(delimiter.join(names)) == names
    quoted = delimiter.join('"' + n.replace(" ", ", ", 1) + '"' for n in names)
    assert segment(quoted) == [n.replace(" ", ", ", 1) for n in names]


def test_rows(spark):
    df = spark.createDataFrame([(1, "A;B", "x"), (1, "A;B", "x"), (2, None, "y"), (None, "C;D", "z"), (3, "E", "w")], "news_id bigint, invester string, val string").withColumnRenamed("val", "cell")
    got = sorted(map(tuple, P.split_names(df.drop("cell"), "news_id", "invester").collect()))
    assert got == [(1, 1, "A", 2), (1, 1, "A", 2), (1, 2, "B", 2), (1, 2, "B", 2), (3, 1, "E", 1)]
    assert P.split_names(df.limit(0), "news_id", "invester").count() == 0
    blocks = sorted(map(tuple, P.split_names(df.drop("cell"), "news_id", "invester", block_chars=1).collect()))
    assert blocks == got
    assert P.split_numbers(df.limit(0), "news_id", "invester").count() == 0


def test_blocks_of_the_dictionary(spark):
    cells = ['"Smith, Jones";X', '"Foo, Bar";X', "Smith, Jones; Foo, Bar", "Foo, Bar, Smith, Jones", "Smith, Jones, Foo"]
    df = spark.createDataFrame(list(enumerate(cells)), "news_id bigint, invester string")
    small, large = (sorted(map(tuple, P.split_names(df, "news_id", "invester", block_chars=n).collect())) for n in (1, 32_000_000))
    assert small == large
    assert [r[2] for r in small if r[0] == 2] == ["Smith, Jones", "Foo, Bar"] and [r[2] for r in small if r[0] == 4] == ["Smith, Jones", "Foo"]


def test_long_ranges(spark):
    cells = ["1-999999999999", "7; 1-999999999999; 9", "2-25003, 5", "25002-1", "0-3", "0-0", "3-0"]
    df = spark.createDataFrame(list(enumerate(cells)), "k bigint, c string")
    got = P.split_numbers(df, "k", "c").collect()
    by = {k: [r.val for r in sorted((r for r in got if r.row_id == k), key=lambda r: r.pos)] for k in range(len(cells))}
    assert by == {0: [], 1: ["7", "9"], 2: [*map(str, range(2, 25004)), "5"], 3: [str(x) for x in range(25002, 0, -1)], 4: ["1", "2", "3"], 5: [], 6: ["3", "2", "1"]}
    assert all(sorted(r.pos for r in got if r.row_id == k) == list(range(1, len(v) + 1)) for k, v in by.items())
    assert [r.v for r in df.orderBy("k").select(P.first_number(F.col("c")).alias("v")).collect()] == [None, 7, 2, 25002, 1, None, 3]
