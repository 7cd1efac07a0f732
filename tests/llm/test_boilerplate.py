import random

from tessella.llm.boilerplate import article_blocks, pages_to_blocks, pages_to_text
from tessella.llm.dom import parse, walk

PAGE = """<html lang="en"><head><title>Daily Pharma</title></head><body>
<nav><ul><li data-n="1"><a href="#">Home</a></li><li data-n="2"><a href="#">News</a></li><li data-n="3"><a href="#">Jobs</a></li></ul></nav>
<div><h1 data-n="4">New plant opens in Varnholm</h1><p data-n="5">By K. Vashem, 2021-03-04</p><span data-n="6"><a href="#">Copy link</a></span>
<p data-n="7">The company opened a plant near Varnholm on Monday, which will employ three hundred people from next year.</p>
<p data-n="8">Advertisement</p><p data-n="9">It worked.</p>
<ul><li data-n="10">results are due in May</li><li data-n="11"><a href="#">dosing every 9 weeks</a></li></ul>
<div><p data-n="12"><a href="#">See also: Regulator accepts filing for another medicine</a></p></div>
<p data-n="13">Regulators granted the product a conditional licence after a review of all the safety data in the summer.</p>
<p data-n="14">Filed under: plants</p></div>
<div><h3 data-n="15">Most read</h3><li data-n="16"><a href="#">Agency accepts filing for a new medicine against asthma in adults</a></li><p data-n="17">A short summary of that other article stands here.</p></div>
<footer><p data-n="18">© 2021 Daily Pharma. All rights reserved.</p></footer></body></html>"""


ARTICLE = [4, 7, 9, 10, 11, 13]
FACTS = ["The company opened a plant near {0} on Monday, which will employ {1} people from next year.", "Analysts at {0} expected the market to grow by {1} percent over the coming ten years.", "Shares of the maker rose by {1} percent in {0} after the results had been announced.", "Doctors in {0} said that {1} patients had been treated without severe side effects so far."]
NOTES = ["Sign up for our free newsletter and never miss a story about {0}.", "{0} and its {1} partners may store information on your device for some purposes.", "I have taken this for {1} years and it never helped me at all in {0}."]
TOWNS = "Varnholm Marrowick Hexwold Osterlin Calvera Pontrelle Dunhaven Ondrava".split()


def corpus(n=60, seed=1):
    """Pages of the site: articles of shuffled facts with by-line, tags and an offer among them, notes around, other articles linked below."""
    rng = random.Random(seed)
    out = []
    for page in range(n):
        said = lambda x: x.format(rng.choice(TOWNS), rng.randint(2, 400))
        blocks = [f'<li data-n="{i}"><a href="#">{x}</a></li>' for i, x in enumerate(("Home", "News", "Jobs", "Events"), 1)]
        k, own = len(blocks), []

        def put(form, text, mine, k0=k):
            blocks.append(form.format(n=len(blocks) + 1, text=text))
            if mine:
                own.append(len(blocks))

        blocks.append("<div>")
        blocks[-1:] = []
        put("<div><h1 data-n='{n}'>{text}</h1>", said("New plant opens in {0} for {1} people"), True)
        put("<p data-n='{n}'>{text}</p>", f"By {rng.choice('KLMS')}. Vashem, 2021-03-{rng.randint(10, 28)}", False)
        for i in range(rng.randint(6, 9)):
            put("<p data-n='{n}'>{text}</p>", said(rng.choice(FACTS)), True)
            if i == 2:
                put("<h3 data-n='{n}'>{text}</h3>", "Background", True)
            if i == 3 and page % 4 == 0:
                put("<p data-n='{n}'>{text}</p>", said(NOTES[0]), False)
        put("<p data-n='{n}'>{text}</p></div>", said("Filed under: plants, {0}"), False)
        put("<div><p data-n='{n}'>{text}</p>", said(NOTES[0]), False)
        put("<p data-n='{n}'>{text}</p>", said(NOTES[1]), False)
        put("<p data-n='{n}'>{text}</p></div>", said(NOTES[2]), False)
        put("<div><h3 data-n='{n}'>{text}</h3>", "Most read", False)
        for _ in range(3):
            put("<p data-n='{n}'><a href='#'>{text}</a></p>", said("New plant opens in {0} for {1} people"), False)
        html = "<html><head><title>Daily Pharma</title></head><body><ul>" + "".join(blocks[:k]) + "</ul>" + "".join(blocks[k:]) + f"</div><footer><p data-n='{len(blocks) + 1}'>© 2021 Daily Pharma. All rights reserved.</p></footer></body></html>"
        out.append((page, html, own))
    return out


def scores(spark, pages, rounds):
    df = spark.createDataFrame([(p, h) for p, h, _ in pages], "page_id bigint, html string")
    found = {tuple(r) for r in pages_to_blocks(df, rounds=rounds).collect()}
    true = {(p, n) for p, _, own in pages for n in own}
    return len(found & true) / len(true), len(found & true) / max(1, len(found))


def test_corpus(spark):
    """Density alone keeps what stands in one box with the article; what all pages say tells by-lines, tags and offers from it."""
    pages = corpus()
    alone, weighed = scores(spark, pages, 0), scores(spark, pages, 2)
    assert alone[0] >= 0.95 and weighed[0] >= 0.95 and weighed[1] >= 0.95 and weighed[1] > alone[1] + 0.1, (alone, weighed)


SAID = [
    "The Phase I trial enrolled 40 patients in Basel and Lyon.", "Type I diabetes remains the main target of the maker in this year.", "By the end of 2024 the company expects first results.", "Von den 312 Patienten waren 2023 noch 40 am Leben.", "Das Mittel kostet je 100 mg etwa vierzig Euro, und je Patient fallen zwei Packungen an.",
    "The regulator published a white paper on cookies and the privacy policy of three makers.", "The approval is good news for patients with severe asthma, analysts said on Monday.", "Will the medicine be paid for by the insurers of the country?", "Stage I or II?", "Does Varnholm need a new plant?",
]


def test_words_alone_decide_nothing(spark):
    """An article may say what notices say: a sentence that stands nowhere else is judged by density."""
    pages = [(p, h.replace("<h3 data-n=", f"<p data-n='900'>{SAID[p]}</p><h3 data-n=", 1) if p < len(SAID) else h, own) for p, h, own in corpus()]
    df = spark.createDataFrame([(p, h) for p, h, _ in pages], "page_id bigint, html string")
    found = {tuple(r) for r in pages_to_blocks(df).collect()}
    assert [x for i, x in enumerate(SAID) if (i, 900) not in found] == []
    for text in SAID:
        assert set(article_blocks(PAGE.replace("It worked.", text))) >= set(ARTICLE), text


def test_one_page():
    assert set(article_blocks(PAGE)) >= set(ARTICLE) and not set(article_blocks(PAGE)) & {1, 2, 3, 15, 16, 17, 18}
    one = "<body><div><p data-n='1'>The company opened a plant near Varnholm on Monday, which will employ three hundred people.</p></div></body>"
    assert article_blocks(one) == [1]


def test_index_page():
    teasers = "".join(f'<h2 data-n="{2 * i}"><a href="#">Agency accepts filing for medicine number {i} in severe asthma</a></h2><p data-n="{2 * i + 1}">The round was led by a fund with several others.</p>' for i in range(1, 8))
    assert article_blocks(f"<html><body><div>{teasers}</div></body></html>") == []


def test_bad_markup():
    assert article_blocks(None) == article_blocks("") == article_blocks("<p") == article_blocks("no markup at all") == []
    cut = PAGE[: PAGE.index("It worked") + 20]
    assert set(article_blocks(cut)) >= {4, 7}
    assert 13 in article_blocks(PAGE.replace("</p>", ""))
    assert article_blocks("<p data-n='x'>a</p><p data-n='99999999999999999999'>b</p>") == []
    assert len(list(walk(parse("<div>" * 3000 + "x")))) == 3000 and article_blocks("<div data-n='1'>" * 3000 + "x") == []


def test_frame(spark):
    df = spark.createDataFrame([(1, PAGE, "a"), (2, None, "b"), (3, "", "c"), (None, PAGE, "d"), (4, "<p data-n='1'></p>", "e")], "page_id bigint, html string, block_n string").drop("block_n")
    found = [tuple(r) for r in pages_to_blocks(df).orderBy("block_n").collect()]
    assert {n for _, n in found} >= {7, 9, 13} and {p for p, _ in found} == {1} and len(found) == len(set(found))
    texts = {r.page_id: r.text for r in pages_to_text(df).where("page_id is not null").collect()}
    assert texts[2] is None and texts[3] == texts[4] == "" and "The company opened a plant" in texts[1]
    assert pages_to_blocks(df.limit(0)).count() == 0 == pages_to_text(df.limit(0)).count()
