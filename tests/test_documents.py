from tessella.catalogue import QUERIES


def test_long_elements_stay(spark, tmp_path):
    long = "word " * 200
    pages = [(1, f"<html><head><title>{long}</title></head><body><p>x</p></body></html>"), (2, f"<html><body><div><p>{long}</p><p>b</p></div></body></html>"), (3, f"<html><body><div><p>a</p><b>b</b></div><p>{long}</p></body></html>"), (4, None)]
    spark.createDataFrame(pages, "page_id bigint, html string").write.parquet(f"{tmp_path}/news_page.parquet")
    assert {tuple(r) for r in QUERIES["q_dom_path"](spark, str(tmp_path)).collect()} == {(1, long.strip())}
    got = dict(tuple(r) for r in QUERIES["q_common_ancestor"](spark, str(tmp_path)).collect())
    assert got == {1: "/html[1]", 2: "/html[1]/body[1]/div[1]", 3: "/html[1]/body[1]"}
