import pyarrow as pa

from tessella.llm import boilerplate as P


def test_pages_are_read_in_slices():
    batch = pa.RecordBatch.from_pydict({"key": list(range(2 * P.SLICE + 5))})
    got = list(P._slices([batch, batch.slice(0, 0), batch.slice(0, 3)]))
    assert [x.num_rows for x in got] == [P.SLICE, P.SLICE, 5, 3]
    assert [k for x in got[:3] for k in x.column("key").to_pylist()] == list(range(2 * P.SLICE + 5))


def test_long_keys_beside_a_null_one(spark):
    body = " ".join(f"<p data-n='{i}'>This is sentence number {i} of an article that goes on for a while.</p>" for i in range(5))
    pages = spark.createDataFrame([(2**60 + 1, f"<body><div>{body}</div></body>"), (None, "<p>x</p>"), (7, None)], "page_id bigint, html string").coalesce(1)
    texts = {r.page_id: r.text for r in P.pages_to_text(pages).collect()}
    assert set(texts) == {2**60 + 1, None, 7} and texts[7] is None
    assert {(r.page_id, r.block_n) for r in P.pages_to_blocks(pages).collect()} == {(2**60 + 1, i) for i in range(5)}
