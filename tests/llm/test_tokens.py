import base64

import pytest

from tessella.llm.tokens import VOCABULARIES, ByteBpe, encode_documents, load_ranks

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def pair():
    path = f"{VOCABULARIES}/byte_bpe_50k.tiktoken"
    ranks = load_ranks(path)
    from tessella.llm.tokens import PATTERN

    other = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return ByteBpe(ranks), other


TEXTS = ["Hello world", "it's  done\n\n", "x" * 3000, "ab" * 2500, "中文" * 700, "<|endoftext|> is text", "naïve café ​", "\x00\x07", "  ", "1234567 a1b2", "Привет, мир", "🙂🙂", "aaaaabaaaaab" * 100]


@pytest.mark.parametrize("text", TEXTS)
def test_equals_reference_encoder(pair, text):
    ours, theirs = pair
    assert ours.encode(text) == theirs.encode_ordinary(text)


def test_round_trip(pair):
    ours, _ = pair
    back = {v: k for k, v in ours.ranks.items()}
    for text in TEXTS:
        assert b"".join(back[i] for i in ours.encode(text)).decode() == text


def test_leftmost_of_equal_ranks():
    ranks = {bytes([i]): i for i in range(256)} | {b"aa": 256}
    assert ByteBpe(ranks).merge(b"aaaaa") == [256, 256, 97]


def test_documents(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, None, "y"), (3, "", "z")], "doc_id bigint, text string, ids string")
    out = {r.doc_id: r.ids for r in encode_documents(df).collect()}
    assert out == {1: [64], 2: [], 3: []}
    assert encode_documents(df.limit(0)).count() == 0
    assert base64.b64decode("YQ==") == b"a"
