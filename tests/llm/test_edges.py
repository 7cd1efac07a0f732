"""Extra columns with clashing names, repeated rows, nulls throughout."""

from pyspark.sql import functions as F

from tessella.llm import boilerplate, languages, leaks, names, scans, splits, tokens


def clashing(df, *more):
    """``df`` with columns of the names that operators use inside."""
    for c in ("k", "n", "s", "t", "a", "b", "c", "g", "key", "cell", "vals", "form", "vertex", "component", "parts", "__text", "dropped", "block_n", "ids", "item", "split", *more):
        if c not in df.columns:
            df = df.withColumn(c, F.lit("x"))
    return df


def test_clashes(spark):
    pages = spark.createDataFrame([(1, "<p data-n='1'>x</p>")], "page_id bigint, html string")
    assert boilerplate.pages_to_blocks(clashing(pages)).count() == 0
    scan = spark.createDataFrame([(1, "f", 1, "A word. \nAn-\nother word\n", None)], "page_id bigint, pdf_name string, page_number int, text string, data string")
    assert ("text", 1, 2, "join", "another") in {tuple(r) for r in scans.repairs(clashing(scan)).collect()}
    claims = spark.createDataFrame([(1, "A", "e"), (2, "B", "e"), (2, "B", "e")], "claim_id bigint, patent_code string, esid string")
    assert [tuple(r) for r in splits.tied_codes(clashing(claims)).collect()] == [("A", "B")]
    assert splits.assign_splits(clashing(claims).drop("split")).count() == 3
    docs = spark.createDataFrame([(1, "one two three four five six seven."), (1, "one two three four five six seven.")], "doc_id bigint, text string")
    items = docs.selectExpr("doc_id as item_id", "text")
    assert [tuple(r) for r in leaks.leaks(clashing(docs, "item_id"), clashing(items, "doc_id")).collect()] == [(1, 1)]
    assert tokens.encode_documents(clashing(docs)).columns == ["doc_id", "ids"]
    news = spark.createDataFrame([(1, "A B Ventures; A B Ventures Ltd.")], "news_id bigint, invester string")
    asked = spark.createDataFrame([(1, ["A B Ventures"])], "request_id bigint, classification_input array<string>")
    assert names.linked_names(clashing(news), clashing(asked)).count() == 1


def test_all_null(spark):
    scan = spark.createDataFrame([(1, None, None, None, None)], "page_id bigint, pdf_name string, page_number int, text string, data string")
    assert scans.repairs(scan).count() == 0
    body = spark.createDataFrame([(1, None, None, None), (2, "en", "", []), (3, "", None, [None, ""])], "rec_id bigint, lang string, title string, paragraphs array<string>")
    assert languages.unnamed_languages(body).count() == 0 and languages.record_languages(body).count() == 3
    claims = spark.createDataFrame([(1, None, None), (None, None, None)], "claim_id bigint, patent_code string, esid string")
    assert splits.tied_codes(claims).count() == 0 and splits.assign_splits(claims).count() == 2
