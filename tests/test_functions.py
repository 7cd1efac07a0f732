import pytest
from pyspark.sql import functions as F

from tessella.functions import extract as X
from tessella.functions import sequences as B
from tessella.functions import text as T
from tessella.plans.query import quorum, token_list


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("clause, n, want", [("3", 5, 3), ("-2", 5, 3), ("75%", 4, 3), ("-25%", 4, 3), ("2<-25%", 2, 2), ("2<-25%", 4, 3), ("9", 4, 4), ("-9", 4, 0)])
def test_quorum(clause, n, want):
    assert quorum(clause, n) == want


def test_tokens():
    assert token_list("PD-1抑制剂, Phase Ⅱ") == ["pd", "1", "抑", "制", "剂", "phase"]


@pytest.mark.parametrize("value, want", [("1-2, 4, 6, 7-10", [1, 2, 4, 6, 7, 8, 9, 10]), ("5", [5]), ("x", []), ("1-999999999999,3", [3]), ("1-999999999", [])])
def test_ranges(spark, value, want):
    assert one(spark, X.ranges_to_values, value) == want


@pytest.mark.parametrize("value, want", [("1,2,4,6,7,8,9,10", "1-2,4,6-10"), ("3", "3"), ("a,b", "a,b"), ("2,1", "1-2")])
def test_ranges_back(spark, value, want):
    assert one(spark, X.text_ranges, value) == want


@pytest.mark.parametrize("value, want", [("ArgMetPhePro", "RMFP"), ("ArgaaMetPheddad", "RXMFXX"), ("", "")])
def test_amino(spark, value, want):
    assert one(spark, B.one_letter, value) == want


def test_amino_repair(spark):
    assert one(spark, B.repair_amino, "Sor Va a his") == "SerValHis"


@pytest.mark.parametrize("value, want", [("2020年1月2日", "2020-1-2"), ("2020.1.12", "2020-1-12"), ("98112", "1998-1-12"), ("151231", "2015-12-31"), ("", ""), (None, ""), ("1800.1.1", ""), ("xx", ""), ("2021.2.30", ""), ("2019.02.03", "2019-2-3"), ("2020112", "2020-1-12"), ("2020 年 3 月 4 号", "2020-3-4")])
def test_dates(spark, value, want):
    assert one(spark, X.repair_date_column, value) == want


def test_windows(spark):
    long = "abcdefghij" * 3
    got = one(spark, lambda c: T.windows(c, 10, 4), long)
    want = [long[i * 6 : i * 6 + 10] for i in range(len(long) // 6 + 1) if long[i * 6 : i * 6 + 10]]
    if len(want) > 1 and len(want[-1]) < 4:
        want = want[:-1]
    assert got == want
    assert one(spark, lambda c: T.windows(c, 10, 10), "x" * 25) == ["x" * 10, "x" * 10, "x" * 5][:2]


def test_cleaning(spark):
    assert one(spark, T.clean_text, " a​b\tc &amp; d\x01  e ") == "abc & d e"
    assert one(spark, T.collapse, "  a 　 b ") == "a b"
    assert one(spark, T.full_to_half, "ＡＢ１２！　x") == "AB12! x"
    assert one(spark, T.clean_spaces_cjk, "融资 完成 3 亿 元 New York") == "融资完成3亿元 New York"
    assert one(spark, T.strip_tags, "<p>a<script>x<b></script></p>\n<b>&lt;b</b>") == "a<b"
    for f in (T.clean_text, T.collapse, T.full_to_half, T.strip_tags, T.sentences_zh, T.windows, T.unescape):
        assert one(spark, f, None) is None


def test_sentences(spark):
    assert one(spark, T.sentences_zh, "他说：“好。”然后走了。真的？是的……对") == ["他说：“好。”", "然后走了。", "真的？", "是的……", "对"]
    assert one(spark, T.sentences_zh, "“走？”，他问。\n\n第二行\n“好！！”他说......完") == ["“走？”，他问。", "第二行", "“好！！”", "他说......", "完"]
    assert one(spark, T.sentences_naive, "一。二！三") == ["一。", "二！"]
    assert one(spark, T.sentences_en, 'He left. "Why?" 3 days. end') == ["He left.", '"Why?"', "3 days. end"]


def test_hybrid():
    assert T.hybrid_tokens("抗PD-1/b (PD-L1)") == ["抗", "PD-1", "/", "b", "(", "PD-L1", ")"]
    assert T.hybrid_tokens("anti-CD20 works.") == ["anti-", "CD20", "works", "."]
    assert T.hybrid_tokens("") == [] and T.hybrid_tokens(None) is None


def test_merge(spark):
    df = spark.createDataFrame([(["a|ab", "", "ab"],), ([],), (["nil"],)], "x array<string>")
    assert [r.y for r in df.select(T.merge_windows(F.col("x"), "|", "nil").alias("y")).collect()] == ["ab", "nil", "nil"]


def test_entities():
    assert X.repair_entity("the heart disease of", "heart diseese") == "heart disease"
    assert X.repair_entity("abc", "zzz") == "" and X.repair_entity("abc", "b") == "b" and X.repair_entity(None, "b") is None
    assert X.edit_ratio("kitten", "sitting") == pytest.approx(8 / 13) and X.edit_ratio("", "") == 1 and X.edit_ratio(None, "") is None


def test_motif():
    assert B.expand_motif("A[BC]X{1,2}") == ["ABX", "ABXX", "ACX", "ACXX"]
    assert B.expand_motif("AN", nucleotide=True) == ["AA", "AC", "AG", "AT"] and B.expand_motif("AN") == ["AN"]
    assert len(B.expand_motif("[ACDEFGHIKL][ACDEFGHIKL][ACDEFGHIKL]")) == 100 and B.expand_motif(None) == [] == B.expand_motif("")
    assert B.expand_motif("A{1,3}", most=2) == ["A", "AA"] and B.expand_motif("A{1,2}A{0,1}") == ["A", "AA", "AAA"]
    assert B.expand_motif("[AB]{30}")[:2] == ["A" * 30, "A" * 29 + "B"] and len(B.expand_motif("[AB]{1,40}")) == 100
    assert B.expand_motif("[AB") == ["A", "B"] and B.expand_motif("A-[B]{}C{2") == ["ABCC"] and B.expand_motif("-") == [] == B.expand_motif("A{3,2}")


def test_claim_parents(spark):
    cases = {"The method of claim 3, wherein": [3], "of any one of claims 2 to 5, wherein": [2, 3, 4, 5], "The kit of claims 4, 2 and 9": [2, 4, 9], "根据权利要求1-3所述": [1, 2, 3], "根据权利要求7所述": [7], "A compound": [], "权利要求1或2": [1, 2]}
    for text, want in cases.items():
        assert one(spark, X.claim_parents, text) == want, text
