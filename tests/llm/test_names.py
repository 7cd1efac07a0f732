import random

import pytest

from tessella.llm import names as N


@pytest.mark.parametrize(
    "a, b",
    [
        ("Roskarul Corlombri Medical Research Foundation Inc.", "Roskarul Corlombri Medical Research Fdn"), ("Lomzanfen Fenhuspel Life Sciences Fund GmbH", "Lomzanfen Fenhuspel Life Sci. Fund"), ("Karbaven Tavnovdel University Hospital Ltd.", "Karbaven Tavnovdel UH"), ("Venlomros Ulgrizan University Ltd.", "University of Venlomros Ulgrizan"),
        ("Venlomros Ulgrizan University Ltd.", "VENLOMROS ULGRIZAN UNIVERSITY LIMITED"), ("Venlomros Ulgrizan University Ltd.", "The Venlomros Ulgrizan Group"), ("Venlomros Ulgrizan University Ltd.", "VenlomrosUlgrizan"), ("Delbridro Novstelom Capital Partners", "Délbrídrö Novstelom Capital Ptnrs"), ("Galabmir Brihustha Healthcare LLC", "Galbamir-Brihustha H'care"),
        ("Charlotte Karulflewexfle", "C. G. Karulflewexfle"), ("Charlotte Karulflewexfle", "KARULFLEWEXFLE, Lottie"), ("Katherine Ulgalhusgrinov", "Ulgalhusgrinov K.G."), ("Alexander Pelpelsedkarven", 'Alexander "Sasha" Pelpelsedkarven'), ("东祺瑾玥棣生物医药有限公司", "瑾玥棣（东祺）生物医药有限公司"), ("东祺瑾玥棣生物医药有限公司", "瑾玥棣 生物医药"), ("江翎铭玥灏医疗科技有限公司", "江翎市铭玥灏医疗科技有限公司（有限合伙）"),
    ],
)
def test_variants(a, b):
    x, y = N.plain_form(a), N.plain_form(b)
    assert max(N.likelihood(x, y), N.likelihood(y, x)) >= N.LEAST
    assert x == y or N.block_keys(x) & N.block_keys(y)


@pytest.mark.parametrize("a, b", [("Thabrizan Sedgriqua Institute of Oncology S.A.", "Thabrizan Sedgriqua University S.A."), ("Andrew Rosbripelulcor", "Nicholas Rosbripelulcor"), ("A. Rosbripelulcor", "N. Rosbripelulcor"), ("Roswexdro Wexsedul Ventures", "Roswexdro Galpelros Ventures"), ("Mirgalkar Briquajin University Ltd.", "Mirgalkar Briquajin University Hospital Ltd."), ("东祺瑾玥棣生物医药有限公司", "东祺瑾玥棣制药有限公司")])
def test_different(a, b):
    x, y = N.plain_form(a), N.plain_form(b)
    assert max(N.likelihood(x, y), N.likelihood(y, x)) < N.LEAST


def test_linked(spark):
    news = [(i, "Galbamir Brihustha Healthcare LLC; Andrew Rosbripelulcor") for i in range(9)] + [(100, '"Brihustha, Galbamir"'), (101, "Galabmir Brihustha Healthcare"), (102, "未披露"), (103, None), (104, "Nicholas Rosbripelulcor"), (105, "Galbamir Brihustha University LLC")]
    asked = [(1, [" A. Rosbripelulcor ", None, "", "Andy Rosbripelulcor"]), (2, []), (3, None)]
    n = spark.createDataFrame(news, "news_id bigint, invester string")
    r = spark.createDataFrame(asked, "request_id bigint, classification_input array<string>")
    got = {tuple(x) for x in N.linked_names(n, r).collect()}
    assert ("Galabmir Brihustha Healthcare", "Galbamir Brihustha Healthcare LLC") in got
    assert ("A. Rosbripelulcor", "Andrew Rosbripelulcor") in got and ("Andrew Rosbripelulcor", "Andy Rosbripelulcor") in got
    assert not any("Nicholas" in a + b or "University" in a + b for a, b in got)
    assert all(a < b for a, b in got)
    assert N.linked_names(n.limit(0), r.limit(0)).count() == 0


NEAR = [
    ("Yamamoto Kenji", "Kenji Yamamoto"), ("John Weber", "John Wever"), ("John Abe", "John Ab3"), ("Anna Karulflewexfle", "Anna Karuflewexflo"), ("Anna Karulflewexfle", "Anna Kraulflewexlfe"), ("Anna Lindqvist", "Anna Lndqist"), ("Karulflewexfle Briquajinnovsted Mirgalkar", "Karulflewexlfe Briquajinovsted Mirgalkar"),
    ("Karulflewexfle Briquajinnovsted Mirgalkar", "Mirgalkar Karulflewexfle Briquajinnovsted"),
]


UNLISTED = [["O. Grundmann", "Oliver Grundmann", "Grundmann Oliver", "GRUNDMANN, O."], ["K. Weber", "Karl Weber", "Weber, Karl"], ["P. Rossi", "Paolo Rossi"], ["J. P. Verhoeven", "Joris Pieter Verhoeven", "Verhoeven, Joris Pieter"], ["M. Okonkwo", "Mirembe Okonkwo", "Mirembe Okonkwp"]]


def test_given_names_of_no_list(spark):
    """Initials and moved parts link whatever the given name; another initial, another given name or another surname doesn't."""
    for a, b in [(x, y) for group in UNLISTED for i, x in enumerate(group) for y in group[i + 1 :] if "Okonkwp" not in y or "M." not in x]:
        x, y = N.plain_form(a), N.plain_form(b)
        assert max(N.likelihood(x, y), N.likelihood(y, x)) >= N.LEAST, (a, b)
        assert x == y or N.block_keys(x) & N.block_keys(y), (a, b)
    other = ["T. Grundmann", "Tilo Grundmann", "Emil Weber", "O. Grundig", "Paolo Conti"]
    r = spark.createDataFrame([(i, group) for i, group in enumerate([*UNLISTED, other])], "request_id bigint, classification_input array<string>")
    n = spark.createDataFrame([(1, '"Oliver Grundmann"')], "news_id bigint, invester string")
    got = {tuple(x) for x in N.linked_names(n, r).collect()}
    want = {tuple(sorted((x, y))) for group in UNLISTED for i, x in enumerate(group) for y in group[i + 1 :]} | {("T. Grundmann", "Tilo Grundmann")}
    assert got == want


@pytest.mark.parametrize("a, b", NEAR)
def test_linked_forms_meet(a, b):
    x, y = N.plain_form(a), N.plain_form(b)
    assert max(N.likelihood(x, y), N.likelihood(y, x)) >= N.LEAST
    assert N.block_keys(x) & N.block_keys(y)


def test_stems_two_typos_apart_meet():
    draw = random.Random(7)
    for n in range(1, 60):
        for _ in range(20):
            a = b = "".join(draw.choice("abcd") for _ in range(n))
            for _ in range(2 if n >= 9 else 1):
                i = draw.randrange(len(b))
                b = draw.choice([b[:i] + b[i + 1 :], b[:i] + "x" + b[i:], b[:i] + "x" + b[i + 1 :], b[:i] + b[i : i + 2][::-1] + b[i + 2 :]])
            assert not b or N._edits(a, b, 2) > (2 if max(len(a), len(b)) >= 9 else 1) or N.stem_keys(a) & N.stem_keys(b), (a, b)


def test_linked_near(spark):
    n = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(NEAR) for _ in range(5)], "news_id bigint, invester string")
    r = spark.createDataFrame([(i, [b]) for i, (_, b) in enumerate(NEAR)], "request_id bigint, classification_input array<string>")
    got = {tuple(x) for x in N.linked_names(n, r).collect()}
    assert {tuple(sorted(x)) for x in NEAR} <= got
    assert all(N.likelihood("a b", x) == N.STRANGE for x in ("a c", "a b gmbh"))


def test_chinese_typo(spark):
    right, typo, own = "东祺瑾玥棣生物医药有限公司", "东祺瑾玥隶生物医药有限公司", "东祺瑾玥浚生物医药有限公司"
    x, y = N.plain_form(right), N.plain_form(typo)
    assert N.likelihood(y, x) >= N.LEAST and N.block_keys(x) & N.block_keys(y)
    assert N.likelihood(N.plain_form("东祺瑾玥棣生物医药一期"), N.plain_form("东祺瑾玥棣生物医药二期")) == N.STRANGE
    n = spark.createDataFrame([(i, right) for i in range(80)] + [(100 + i, own) for i in range(20)] + [(200, typo)], "news_id bigint, invester string")
    r = spark.createDataFrame([], "request_id bigint, classification_input array<string>")
    got = {tuple(x) for x in N.linked_names(n, r).collect()}
    assert got == {tuple(sorted((right, typo)))}
