from tessella.catalogue import QUERIES

DAY = 86_400_000


def test_chains_and_rows_without_time(spark, tmp_path):
    rows = [(1, "A new plant", 0), (2, "A new plant", 20 * DAY), (3, "a new plant", 22 * DAY), (4, "A new plant!", 28 * DAY), (5, "A new plant", 35 * DAY)]
    rows += [(11, "Other", 0), (12, "Other", 30 * DAY), (13, "Other", None), (20, None, 0), (21, None, DAY)]
    spark.createDataFrame(rows, "news_id bigint, title string, publish_date bigint").write.parquet(f"{tmp_path}/finance_news.parquet")
    got = dict(tuple(r) for r in QUERIES["q_week_clusters"](spark, str(tmp_path)).select("news_id", "cluster").collect())
    assert got == {1: 1, 2: 2, 3: 2, 4: 2, 5: 5, 11: 11, 12: 11, 13: 11, 20: 20, 21: 21}
