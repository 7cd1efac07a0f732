from pyspark.sql import functions as F

from tessella.llm.scans import _skeleton_column, glyph_skeleton, next_pages, paragraphs, reflow, repairs


def test_skeleton(spark):
    words = ["event", "everit", "treatment", "treatrnent", "during", "durmg", "clear", "dear", "Übelkeit", "between", "betvveen", "6aseline", "baseline", "diﬁcult", None, ""]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for w, s in df.select("w", _skeleton_column(F.col("w"))).collect():
        assert s == (None if w is None else glyph_skeleton(w))
    assert glyph_skeleton("everit") == glyph_skeleton("event") and glyph_skeleton("clear") == glyph_skeleton("dear") and glyph_skeleton("durmg") == glyph_skeleton("during")


def test_repairs(spark):
    body = "The treatment was given to patients during the trial and the long-term effects were observed in all patients.\nThe treatment during the long-term trial was observed.\n"
    pages = [(100 + i, "known", i, "Text", f"Header Line\n{body * 3}\n{i}", None) for i in range(1, 9)]
    pages += [
        (1, "f", 1, "Text", "Running Title\nThe treat-\nment of pafients durirg\nthe long-\nterm trial was ob-\n1", "Figure 1. The treat-\r\nment"),
        (2, "f", 2, None, None, None), (3, "f", 3, "Text", "Running Title\nserved in all patients.\n73\n2", None), (4, "f", 4, "Text", "Runnlng Title\nThe trial was observed.\n3", ""),
        (5, None, None, None, "", None),
    ]
    df = spark.createDataFrame(pages, "page_id bigint, pdf_name string, page_number int, block_type string, text string, data string")
    got = {tuple(r) for r in repairs(df).where("page_id < 100").collect()}
    for row in [("text", 1, 2, "join", "treatment"), ("text", 1, 3, "char", "patients"), ("text", 1, 4, "join", "long-term"), ("text", 1, 5, "join", "observed"), ("data", 1, 1, "join", "treatment"), ("text", 1, 1, "drop", ""), ("text", 3, 1, "drop", ""), ("text", 4, 1, "drop", ""), ("text", 1, 6, "drop", ""), ("text", 3, 4, "drop", "")]:
        assert row in got, row
    assert ("text", 3, 3, "drop", "") not in got
    assert repairs(df.limit(0)).count() == 0


def test_first_words_are_words(spark):
    body = "The treatment was given during the trial.\n"
    pages = [(100 + i, f"k{i}", 1, "Text", body * 3, None) for i in range(9)] + [(1, "f", 1, "Text", "The trial was given.", "treatrnent was given during the trial"), (2, "g", 1, "Text", "treatrnent was given.", None)]
    pages += [(200 + i, f"b{i}", 1, "Text", "Baseline was given.", None) for i in range(9)] + [(300, "c", 1, "Text", "The 6aseline was given.", None)]
    got = {tuple(r) for r in repairs(spark.createDataFrame(pages, "page_id bigint, pdf_name string, page_number int, block_type string, text string, data string")).collect()}
    assert {("data", 1, 1, "char", "treatment"), ("text", 2, 1, "char", "treatment"), ("text", 300, 1, "char", "baseline")} <= got


PAGES = "page_id bigint, pdf_name string, page_number int, block_type string, text string, data string"


def test_next_pages(spark):
    rows = [("a", 1), ("a", 1), ("a", 5), ("a", 1_000_000), ("a", 20241231), ("b", 7), ("a", -3)]
    got = {(r.pdf, r.number): r.next for r in next_pages(spark.createDataFrame(rows, "pdf string, number int")).collect()}
    assert got == {("a", -3): 1, ("a", 1): 5, ("a", 5): 1_000_000, ("a", 1_000_000): 20241231, ("a", 20241231): None, ("b", 7): None}


def test_reflow():
    text = "Running\nThe treat-\nment of pafients, as\nit was.\nBackground\nThe next para-\n"
    got = reflow(text, {1}, {(3, "pafients"): "patients"}, {2: "treatment"}, hands_on=True)
    assert got == (["The treatment of patients, as it was.", "Background", "The next"], True)
    assert reflow("graph ends.\n\nA NEW ONE.\n", set(), {}, {}, handed="paragraph") == (["paragraph ends.", "A NEW ONE."], False)
    assert reflow(None, set(), {}, {}) == reflow(" \r\n", set(), {}, {}) == ([], False)
    assert reflow("中文一行到此\n为止。", set(), {}, {})[0] == ["中文一行到此为止。"]


def test_paragraphs(spark):
    body = "The treatment was given to patients during the trial and the long-term effects were observed in all patients.\nThe treatment during the long-term trial was observed.\n"
    pages = [(100 + i, "known", i, "Text", body * 3, None) for i in range(1, 9)]
    pages += [
        (1, "f", 1, "Text", "Running Title\nThe treat-\nment of pafients durmg\nthe trial was ob-\n1", "Figure 1. The treat-\r\nment"), (2, "f", 1_000_000, "Text", "Running Title\nserved in all patients\n1000000", None), (3, "f", 2, None, "  \n ", ""),
        (4, "f", 1_000_001, "Text", "Runnlng Title\nwere observed.\n\nThe trial.\n1000001", None), (5, "f", 1_000_001, "Text", "Runnlng Title\nwere observed.\n\nThe trial.\n1000001", None), (6, None, None, None, "The trial.", None), (None, "f", 1, None, "x", "y"),
    ]
    df = spark.createDataFrame(pages, PAGES)
    got = sorted((tuple(r) for r in paragraphs(df).where("page_id < 100").collect()), key=lambda r: (r[0], r[2], r[3]))
    assert got == [("data", "f", 1, 1, "Figure 1. The treatment"), ("text", "f", 1, 1, "The treatment of patients during the trial was observed in all patients were observed."), ("text", "f", 4, 2, "The trial."), ("text", None, 6, 1, "The trial.")], got
    assert paragraphs(df.limit(0)).count() == 0
