import datetime as dt

from pyspark.sql import functions as F

from tessella.operators.similar import elect_heads
from tessella.sources import tables as S
from tessella.streaming import streams as Z

NEWS = "esid string, publish_date bigint, resource string, company string, round string, amount string, is_publish string, is_new string"
DAY = 24 * 3600 * 1000


def news(n, day, company="c", resource="投资界", published="0"):
    return (n, 1_600_000_000_000 + day * DAY, resource, company, "A", "1", published, "1")


def run(stream, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None


def test_fold(spark, tmp_path):
    for i, rows in enumerate([[news("a", 0), news("b", 3, resource="医药魔方")], [news("c", 5), news("d", 20), news("x", 5, "other"), news("a", 0)]]):
        spark.createDataFrame(rows, NEWS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run(Z.fold_stream(Z.file_stream(spark, str(tmp_path / "in"), NEWS)), "folded")
    got = {r.esid: (r.cluster, r.is_head) for r in spark.table("folded").collect()}
    assert set(got) == {"a", "b", "c", "d", "x"}
    assert got["a"][0] == got["b"][0] == got["c"][0] == "a" and got["d"][0] == "d" and got["x"][0] == "x"
    assert got["b"][1] and not got["c"][1]


def test_fold_withdraws_heads(spark, tmp_path):
    """A better head that comes later leaves one head; news without all keys stay alone, as in the batch form."""
    rows = [[news("a", 0), news("n", 0, company=None), news("m", 1, company="")], [news("z", 2, resource="医药魔方"), news("o", 2, company=None)]]
    for batch in rows:
        spark.createDataFrame(batch, NEWS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = Z.fold_stream(Z.file_stream(spark, str(tmp_path / "in"), NEWS, per_trigger=1))
    seen = []
    q = stream.writeStream.foreachBatch(lambda df, i: seen.extend(map(tuple, df.collect()))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = {}
    for esid, _, cluster, head in seen:
        last[esid] = (cluster, head)
    assert last["a"][0] == last["z"][0] and [x for x in ("a", "z") if last[x][1]] == ["z"]
    assert all(last[x] == (x, True) for x in "nmo")
    batch = {r.esid: r.is_head for r in elect_heads(spark.createDataFrame(sum(rows, []), NEWS)).collect()}
    assert batch == {k: v[1] for k, v in last.items()}


def test_windows_stream_equals_batch(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(minutes=7 * i), f"u{i % 3}") for i in range(60)]
    df = spark.createDataFrame(rows, "id int, ts timestamp, u string").coalesce(1)
    df.write.parquet(str(tmp_path / "in"))
    flush = spark.createDataFrame([(999, start + dt.timedelta(days=9), "z")], "id int, ts timestamp, u string").coalesce(1)
    flush.write.mode("append").parquet(str(tmp_path / "in"))
    stream = Z.tumbling(Z.file_stream(spark, str(tmp_path / "in"), df.schema, per_trigger=1), "ts", "1 hour", ["u"], [F.count("*").alias("n")])
    run(stream, "windows")
    batch = sorted(map(tuple, Z.tumbling(df, "ts", "1 hour", ["u"], [F.count("*").alias("n")]).collect()))
    got = sorted(tuple(r) for r in spark.table("windows").collect() if r.u != "z")
    assert set(got) <= set(batch) and len(got) >= len(batch) - 3


def test_micro_batches(spark, tmp_path):
    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    q = Z.each_micro_batch(Z.file_stream(spark, str(tmp_path / "in"), "id bigint"), lambda df, n: seen.append(df.count()), str(tmp_path / "c"))
    q.awaitTermination(60)
    assert sum(seen) == 10


def test_slices_resume(spark, tmp_path):
    calls = []

    def job(df):
        calls.append(1)
        return df.withColumn("y", F.col("id") * 2)

    df = spark.range(100)
    assert Z.slices(df, "id", 4, job, str(tmp_path / "s")).count() == 100 and len(calls) == 4
    assert Z.slices(df, "id", 4, job, str(tmp_path / "s")).agg(F.sum("y")).first()[0] == 9900 and len(calls) == 4


def test_heads(spark):
    rows = [news("a", 2), news("b", 1, published="1"), news("c", 0), ("d", None, None, None, "A", "1", None, None)]
    got = {r.esid: r.head for r in elect_heads(spark.createDataFrame(rows, NEWS)).collect()}
    assert got == {"a": "b", "b": "b", "c": "b", "d": "d"}
    assert elect_heads(spark.createDataFrame([], NEWS)).count() == 0


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([("1", "x,\"y\"\n", 2.5), ("2", None, None)], "k string, t string, v double")
    S.write_delimited(df, str(tmp_path / "d"), "|")
    assert sorted(map(tuple, S.read_delimited(spark, str(tmp_path / "d"), df.schema, "|").collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    (tmp_path / "a.json").write_text('[{"k": 1}, {"k": 2}]')
    assert S.read_json_array(spark, str(tmp_path / "a.json")).count() == 2
    S.save_dataset(df, str(tmp_path / "h"), "v1", "train")
    assert S.load_dataset(spark, str(tmp_path / "h"), "v1", "train").count() == 2
    S.write_sheet(df, str(tmp_path / "s"), "one")
    assert S.read_sheets(spark, str(tmp_path / "s"), "one", ["k"]).columns == ["k"]
    (tmp_path / "e.xml").write_text("<r><entry dataset='x'><accession>P1</accession><accession>P2</accession></entry><entry><accession>P3</accession></entry></r>")
    assert S.xml_rows(spark, str(tmp_path / "e.xml"), "entry").count() == 2
    (tmp_path / "many").mkdir()
    for i in range(3):
        (tmp_path / "many" / f"{i}.xml").write_text(f"<entries><entry><n>{i}</n></entry><entry><n>{i}</n></entry></entries>")
    assert [r.n for r in S.xml_rows(spark, str(tmp_path / "many"), "entry", "n int", skip=1).orderBy("n").collect()] == [1, 1, 2, 2]
    from tessella.operators.documents import project_entries, read_entries

    got = project_entries(read_entries(spark, str(tmp_path / "e.xml"))).orderBy("accession").collect()
    assert [r.accession for r in got] == ["P1", "P3"] and got[0].accession_secondary == ["P2"]
    assert S.list_files(spark, str(tmp_path), ".xml").count() == 1
    rows = []
    assert S.each_batch(spark.range(25), [lambda b: rows.append(len(b))], 10) == 25 and rows == [10, 10, 5]
    assert S.each_batch(spark.range(25), [lambda b: True], 10) == 10
    table = spark.createDataFrame([("1", "a", 1), ("2", "b", 2)], "k string, t string, n int")
    new = spark.createDataFrame([("2", None, 9), ("3", "c", 3)], "k string, t string, n int")
    assert sorted(map(tuple, S.updated(table, new, "k").collect())) == [("1", "a", 1), ("2", "b", 9)]
    assert sorted(map(tuple, S.updated(table, new, "k", upsert=True).collect())) == [("1", "a", 1), ("2", "b", 9), ("3", "c", 3)]
    assert sorted(map(tuple, S.replaced(table, new, "k").collect()), key=str) == [("1", "a", 1), ("2", None, 9), ("3", "c", 3)]
    table.write.parquet(str(tmp_path / "t"))
    S.overwrite(S.without(spark.read.parquet(str(tmp_path / "t")), new, "k"), str(tmp_path / "t"))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "t")).collect()] == [("1", "a", 1)]
    ops = spark.createDataFrame([("9", None, None, "update", 1), ("1", "z", None, "update", 1)], "k string, t string, n int, op string, seq int")
    out, failed = S.bulk(table, ops, "k")
    assert [r.k for r in failed.collect()] == ["9"] and sorted(map(tuple, out.collect())) == [("1", "z", 1), ("2", "b", 2)]
    calls = []
    for _ in range(2):
        assert S.pulled(spark, str(tmp_path / "p"), lambda: calls.append(1) or spark.range(3)).count() == 3
    assert calls == [1]
