import random

from tessella.llm import leaks as L

SENTENCE = "In cohort NK-4302 of the study 15 volunteers aged 16 to 45 took 105 mg of clatavzumab beside husgepant and 124 of them met complete remission by day 1910."
OTHER = "In cohort ZZ-9999 of the study 77 volunteers aged 20 to 60 took 333 mg of otherzumab beside novgepant and 555 of them met overall survival by day 1111."
ZH = "登记号甲下共有一千九百五十三家中心其中八十一家靠近松麓均以五百八十五毫克治疗溃疡性结肠炎。"


def found(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    i = spark.createDataFrame(items, "item_id bigint, text string")
    return sorted(map(tuple, L.leaks(d, i).collect()))


def test_found(spark):
    words = SENTENCE.split()
    changed = words.copy()
    changed[3], changed[12] = "zzz", "qqq"
    fourth = words.copy()
    for k in (1, 6, 11, 16, 21):
        fourth[k] = "no" * k
    docs = [
        (1, f"Before. {SENTENCE} After."), (2, SENTENCE.upper()), (3, " ".join(changed)), (4, " ".join(fourth)), (5, OTHER), (6, " ".join(words[:15])), (7, None), (8, ""), (9, "…"),
        (10, SENTENCE.replace(" ", " ").replace("a", "а")), (11, f"前文{ZH}后文"), (12, f"前文{ZH[:20]}后文"), (13, ("filler words here. " * 5000) + SENTENCE), (1, f"Before. {SENTENCE} After."),
    ]
    items = [(1, f"{SENTENCE} Pharmacists mixed 400 mg of saline and lost 217 ampoules of it."), (2, ZH), (3, None), (4, "")]
    assert found(spark, docs, items) == [(1, 1), (2, 1), (3, 1), (10, 1), (11, 2), (13, 1)]


def test_empty(spark):
    assert found(spark, [(1, SENTENCE)], [(1, None)]) == []
    d = spark.createDataFrame([], "doc_id bigint, text string")
    i = spark.createDataFrame([(1, SENTENCE)], "item_id bigint, text string")
    assert L.leaks(d, i).count() == 0 and L.leaks(i.selectExpr("item_id as doc_id", "text"), d.selectExpr("doc_id as item_id", "text")).count() == 0


def test_bounds_agree(spark, monkeypatch):
    """Neither the sieve's size nor the split of hot keys and of candidates changes the result."""
    docs, items = [(1, SENTENCE), (2, OTHER), (3, f"{OTHER} {SENTENCE}")], [(1, SENTENCE), (2, OTHER), (3, f"{SENTENCE} Yes."), (4, "Yes.")]
    whole = found(spark, docs, items)
    for name, value in (("SIEVE_BITS", 64), ("CANDIDATES", 1)):
        monkeypatch.setattr(L, name, value)
    monkeypatch.setattr(L.split_join, "__defaults__", ("inner", 1))
    monkeypatch.setattr("tessella.plans.pairs.SMALL", 0)
    assert found(spark, docs, items) == whole == [(1, 1), (1, 3), (2, 2), (3, 1), (3, 2), (3, 3)]


def test_short_sentences(spark):
    assert found(spark, [(1, "He said: no change, then."), (2, "change no"), (3, "no"), (4, "无变化。")], [(1, "No change."), (2, "NO!"), (3, "无变化")]) == [(1, 1), (1, 2), (2, 2), (3, 2), (4, 3)]


def test_against_brute_force():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]

    def brute(sentence, tokens):
        best = len(sentence)
        row = [0] * (len(tokens) + 1)
        for i, x in enumerate(sentence, 1):
            new = [i]
            for j, y in enumerate(tokens, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return min(best, *row)

    for _ in range(150):
        s = [rng.choice(vocabulary) for _ in range(rng.randint(10, 40))]
        t = s.copy()
        for _ in range(rng.randint(0, len(s) // 6)):
            k = rng.randrange(len(t))
            t[k : k + 1] = rng.choice([[], ["new"], [t[k], "more"]])
        tokens = [rng.choice(vocabulary) for _ in range(20)] + t + [rng.choice(vocabulary) for _ in range(20)]
        sentence = L.Sentence(s)
        post = {}
        for h, q in zip(*L.sentence_fingerprints(s, L.WORDS)):
            post.setdefault(int(h), []).append(int(q))
        hits = [(int(p) - q, q) for h, p in zip(*L.fingerprints(tokens, L.WORDS)) for q in post.get(int(h), ())]
        got = len({q for _, q in hits}) >= sentence.least_shared and sentence.held_at(tokens, [x for x, _ in hits])
        assert got == (brute(s, tokens) <= len(s) // 10)


def test_winnowing_guarantee():
    rng = random.Random(5)
    for _ in range(50):
        shared = [f"s{rng.randrange(1000)}" for _ in range(L.K + L.W - 1)]
        a = [f"a{rng.random()}" for _ in range(30)] + shared + [f"a{rng.random()}" for _ in range(30)]
        b = [f"b{rng.random()}" for _ in range(17)] + shared + [f"b{rng.random()}" for _ in range(9)]
        assert set(L.winnow(a)[0].tolist()) & set(L.winnow(b)[0].tolist())
