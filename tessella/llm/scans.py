"""Text of scanned pages: repair into continuous paragraphs (problem 4).

Method: words are grouped by a skeleton of confusable glyphs; in a group the
frequent forms that the neighbouring words support replace the rare ones.
Running lines are found at the edges of pages by masking digits and comparing
the pages of a file; the rest is reflowed by windows over
the pages of a file, words broken at line and page ends being joined by what
the corpus knows. ``repairs`` lists what is wrong, ``paragraphs`` gives the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.plans.pairs import split_join
from tessella.plans.runtime import broadcast_if_small, cut, spread

# Hyphens at the end of a line.
HYPHENS = "-‐‑­¬"
# Glyphs that scanning mistakes for each other, by the strokes they are made of.
ONE_STROKE = {"i": "rl1!|íìîï", "t": "f", "c": "eéèêëç", "o": "a0äàáâãåöóôòõ", "s": "5", "b": "h6", "q": "g"}
MORE_STROKES = {"ii": "nuúùûüñ", "iii": "m", "vv": "w", "ci": "d", "ti": "ﬁﬂ", "tt": "ﬀ"}
_STROKES = str.maketrans({g: strokes for table in (ONE_STROKE, MORE_STROKES) for strokes, glyphs in table.items() for g in glyphs})
#: A form must be so many times as frequent as the one it replaces; with signs inside the word, and from the ratio on which context is not asked.
RATIO, RATIO_NOISE, RATIO_SURE, RATIO_SHORT = 4.0, 1.0, 60.0, 30.0
#: Page numbers of a file that one task orders.
PAGE_SLICE = 1024
_CJK = "぀-ヿ㐀-鿿"
_TOKEN = re.compile(rf"[^\s{_CJK}，。、；：！？（）【】《》]+")
_LETTER = re.compile(rf"[^\W\d_{_CJK}]")
_EDGE = ".,;:()[]{}\"'„“”‚‘’«»‹›?…–—*"
_NUM = r"[0-9lIi|!oOSsBbZz]{1,9}"
_NUMBER_LINE = re.compile(rf"^[\W_]*(?:(?:page|seite|p\.|s\.|第)\s*)?(?P<v>{_NUM}|[ivxlc]{{1,6}})\s*(?:页)?\s*(?:(?:of|von|/|\|)\s*{_NUM}|共\s*{_NUM}\s*页)?[\W_]*$", re.IGNORECASE)
_NUMBER_NEAR = re.compile(rf"^(?:(?P<a>{_NUM})\s{{2,}}(?P<x>\S.*)|(?P<y>.*\S)\s{{2,}}(?P<b>{_NUM}))$")
_ONLY_NUMBERS = re.compile(r"^[\s\d.,%±=<>/()nNpP+-]*$")
_DIGITS = str.maketrans("lIi|!oOSsBbZz", "1111100558822")


def glyph_skeleton(word: str) -> str:
    """The strokes of a word: equal for forms that scanning mistakes for each other."""
    return word.lower().translate(_STROKES)


def _lines(text: str | None) -> list[str]:
    return [] if text is None else [x[:-1] if x.endswith("\r") else x for x in text.split("\n")]


def _width(line: str) -> int:
    return len(line) + len(re.findall(rf"[{_CJK}，。、；：（）]", line))


def _value(digits: str) -> int | None:
    d = digits.translate(_DIGITS)
    if d.isdigit():
        return int(d)
    return None


def _roman(text: str) -> int | None:
    values, out, last = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}, 0, 0
    for ch in reversed(text.lower()):
        if ch not in values:
            return None
        out += values[ch] if values[ch] >= last else -values[ch]
        last = max(last, values[ch])
    return out


def _key(line: str) -> str:
    """A line with its digits masked and its words by skeleton: equal for running lines of a file, misread or not."""
    out = []
    for token in line.split():
        bare = token.strip(_EDGE + "-|")
        if bare and bare.translate(_DIGITS).isdigit() and (any(x.isdigit() for x in bare) or len(bare) < 3):
            out.append("#")
        else:
            out.append(re.sub(r"\d+", "#", token) if re.search(rf"[{_CJK}]", token) else glyph_skeleton(token))
    return " ".join(out)


def _edge_rows(page: int, pdf: str, number: int, text: str | None) -> list[tuple]:
    """Lines that may run: file, page, line, place and depth at the edge, kind, masked form, number on it, and whether it is set like a title."""
    lines = _lines(text)
    full = [i for i, x in enumerate(lines) if x.strip()]
    if not full:
        return []
    wide = sorted(_width(lines[i].strip()) for i in full)[int(0.8 * (len(full) - 1))]
    out = []

    def row(i: int, place: str, depth: int) -> None:
        line = lines[i].strip()
        m, kind, value, rest = _NUMBER_LINE.match(line), "text", None, line
        if m and (re.search(r"\d", line) or len(m.group("v")) <= 6):
            v = m.group("v")
            value = _value(v) if any(x.isdigit() for x in v) or len(v) == 1 and v in "lIoO" or _roman(v) is None else _roman(v)
            if value is None:
                value = _value(v)
            kind = "number"
            frame = line[: m.start("v")] + "#" + re.sub(r"[0-9lIiOo|!]+", "#", line[m.end("v") :])
            rest = re.sub(r"\s+", "", frame)
        else:
            near = _NUMBER_NEAR.match(line)
            if near:
                value = _value(near.group("a") or near.group("b"))
                rest = near.group("x") or near.group("y")
                kind = "both"
        title = rest.rstrip()[-1:] not in ".。,，;；:：" + HYPHENS and _width(rest) <= 0.8 * max(wide, 40) and not _ONLY_NUMBERS.match(rest)
        words = re.findall(r"[^\W\d_]+", rest)
        small = sum(w[0].islower() for w in words if not re.search(rf"[{_CJK}]", w))
        # Set like a title so plainly that it needs no second page: short, no sentence inside, mostly capitals.
        alone = title and _width(rest) <= 0.65 * max(wide, 40) and not re.search(r"[，。；]|[.;] ", rest) and small * 2 <= max(1, len(words))
        out.append((pdf, number, page, i + 1, place, depth, kind, rest if kind == "number" else _key(rest), value, title, alone))

    for depth, i in enumerate(full[:2]):
        row(i, "top", depth)
    for depth, i in enumerate(reversed(full[-2:])):
        if i not in full[:2]:
            row(i, "bottom", depth)
    for i in full[2:-2]:
        line = lines[i].strip()
        if line[-1] not in ".。,，;；:：" + HYPHENS and _width(line) <= 0.6 * wide and not _ONLY_NUMBERS.match(line):
            out.append((pdf, number, page, i + 1, "middle", 0, "text", _key(line), None, True, False))
    return out


_EDGE_SCHEMA = "pdf string, number int, page_id bigint, line_no int, place string, depth int, kind string, key string, value int, title boolean, alone boolean"


def running_lines(pages: DataFrame) -> DataFrame:
    """``(page_id, line_no)`` of the running headers, footers and page numbers of ``text``.

    A line at a page's edge runs if its masked form stands at that edge of
    another page of the file, or if it is set like a title though it is no
    heading that pages have inside; a number line, if the numbers of the file's
    pages at that edge go with the pages.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [x.split()[0] for x in _EDGE_SCHEMA.split(", ")]
        for batch in batches:
            rows = [r for p, f, n, t in zip(batch["page_id"], batch["pdf_name"], batch["page_number"], batch["text"]) for r in _edge_rows(int(p), f, int(n), t)]
            out = pd.DataFrame(rows, columns=columns)
            out["value"] = out["value"].astype("Int32")
            yield out

    source = pages.where(F.col("page_id").isNotNull() & (F.length("text") > 0)).select("page_id", F.coalesce("pdf_name", F.concat(F.lit("#"), F.col("page_id").cast("string"))).alias("pdf_name"), F.coalesce("page_number", F.lit(0)).alias("page_number"), "text")
    edges = cut(spread(source).mapInPandas(run, _EDGE_SCHEMA))
    headings = edges.where("place = 'middle'").groupBy("key").agg(F.approx_count_distinct("pdf").alias("files")).where("files >= 2").select("key", F.lit(True).alias("heading"))
    outer = edges.where("place <> 'middle'").withColumn("offset", F.col("value") - F.col("number"))
    # One key of a file may stand on very many pages, and one file have very many: both are plain aggregations.
    texts = outer.where("kind <> 'number'").groupBy("pdf", "place", "key").agg(F.count_distinct("number").alias("n"))
    numbers = outer.where("value is not null").groupBy("pdf", "place", "kind").agg(F.count_distinct("number").alias("numbered"), F.median("offset").alias("usual"))
    judged = outer.join(texts, ["pdf", "place", "key"], "left").join(numbers, ["pdf", "place", "kind"], "left").join(headings, "key", "left")
    steady = (F.abs(F.col("offset") - F.col("usual")) <= 3) & (F.col("numbered") >= 2)
    plain_number = F.col("key") == "#"
    number_runs = (F.col("kind") == "number") & F.when(plain_number, steady | ((F.col("numbered") == 1) & (F.col("place") == "bottom") & (F.col("value") == F.col("number")))).otherwise(steady | (F.col("numbered") >= 2) | (F.col("offset") == 0))
    # A number misread beyond reading still stands in the frame of the others.
    number_runs = number_runs | ((F.col("kind") == "number") & plain_number & (F.col("numbered") >= 3) & F.col("value").isNull())
    text_runs = (F.col("kind") == "text") & F.col("title") & F.col("heading").isNull() & ((F.col("n") >= 2) | ((F.col("place") == "top") & F.col("alone")))
    both_runs = (F.col("kind") == "both") & F.coalesce(F.col("title"), F.lit(False)) & ((F.col("n") >= 2) | steady | (F.col("offset") == 0))
    marked = judged.withColumn("runs", F.coalesce(number_runs | text_runs | both_runs, F.lit(False)))
    first = marked.where("depth = 0 and runs").select("page_id", "place", "line_no", "kind")
    # Under a running line a second one counts if it is of the other kind.
    second = marked.where("depth = 1 and runs and (kind <> 'text' or n >= 2)").select("page_id", "place", F.col("line_no").alias("line2"), F.col("kind").alias("kind2"))
    inner = first.join(second, ["page_id", "place"]).where("kind <> kind2").select("page_id", F.col("line2").alias("line_no"))
    return first.select("page_id", "line_no").unionByName(inner).distinct()


# ------------------------------------------------------------------ words


def _bare(token: str) -> str:
    return token.strip(_EDGE).lower()


def _tokens(text: str | None, dropped: set[int], goes_on: bool = True) -> tuple[list[tuple[int, str, str, str]], list[tuple[int, str, str]], tuple[int, str] | None, tuple[int, str, str, str] | None]:
    """Unbroken words (line, word, left, right), broken ones (line, head, tail), the head left open at the end, the first token.

    Where a text goes on from page to page, the first token (line, token, "broken" or "", right) is held back from the words.
    """
    flat: list[tuple[int, str, bool, bool]] = []  # line, token, first of its line, last of its line
    for i, line in enumerate(_lines(text), 1):
        if i in dropped or not line.strip() or _ONLY_NUMBERS.match(line):
            continue
        tokens = _TOKEN.findall(line)
        ends_token = bool(re.search(rf"[^\s{_CJK}，。、；：！？（）]\s*$", line))
        starts_token = bool(re.match(rf"^\s*[^\s{_CJK}，。、；：！？（）]", line))
        flat += [(i, t, starts_token and k == 0, ends_token and k == len(tokens) - 1) for k, t in enumerate(tokens)]
    words, broken, opened, first = [], [], None, None
    used: set[int] = set()
    for k, (line, token, _, last) in enumerate(flat):
        if last and token[-1] in HYPHENS and len(token) > 1 and token[-2].isalnum() and (_LETTER.search(token)):
            if k + 1 == len(flat):
                opened = (line, token[:-1])
                used.add(k)
            elif flat[k + 1][2]:
                broken.append((line, token[:-1], flat[k + 1][1]))
                used |= {k, k + 1}
    for k, (line, token, begins, _) in enumerate(flat):
        if k == 0 and begins and goes_on:
            first = (line, token, "broken" if 0 in used else "", _mask(flat[1][1]) if len(flat) > 1 else "")
            used.add(0)
        if k in used:
            continue
        word = _bare(token)
        if word and _LETTER.search(word):
            words.append((line, word, _mask(flat[k - 1][1]) if k else "", _mask(flat[k + 1][1]) if k + 1 < len(flat) else ""))
    return words, broken, opened, first


def _mask(token: str) -> str:
    return re.sub(r"\d+", "#", _bare(token))


#: A field's tokens as parallel arrays: unbroken words, broken ones, the head left open at the end, the first token held back.
_TOKENS_SCHEMA = "field string, page_id bigint, pdf string, number int, lines array<int>, words array<string>, lefts array<string>, rights array<string>, at array<int>, heads array<string>, tails array<string>, o_line int, o_head string, f_line int, f_token string, f_part string, f_right string"


def _token_row(page: int, pdf: str, number: int, field: str, text: str, dropped: object) -> tuple:
    words, broken, opened, first = _tokens(text, set() if dropped is None else {int(x) for x in dropped}, field == "text")
    lines, plain, lefts, rights = (list(x) for x in zip(*words)) if words else ([], [], [], [])
    at, heads, tails = (list(x) for x in zip(*broken)) if broken else ([], [], [])
    return (field, page, pdf, number, lines, plain, lefts, rights, at, heads, tails, *(opened or (None, None)), *(first or (0, "", "", "")))


def _skeleton_column(word: Column) -> Column:
    """``glyph_skeleton`` of a column."""
    out = F.translate(F.lower(word), "".join(ONE_STROKE.values()), "".join(k * len(v) for k, v in ONE_STROKE.items()))
    for strokes, glyphs in MORE_STROKES.items():
        for glyph in glyphs:
            out = F.replace(out, F.lit(glyph), F.lit(strokes))
    return out


def next_pages(numbers: DataFrame) -> DataFrame:
    """``(pdf, number, next)`` of distinct page numbers of files: the next one that is there, however far, null for the last.

    Windows run over slices of PAGE_SLICE numbers, and over the slices' first pages.
    """
    rows = numbers.select("pdf", "number", F.floor(F.col("number") / PAGE_SLICE).alias("slice")).distinct()
    later = F.lead("first").over(Window.partitionBy("pdf").orderBy("slice"))
    ahead = rows.groupBy("pdf", "slice").agg(F.min("number").alias("first")).select("pdf", "slice", later.alias("later"))
    following = F.lead("number").over(Window.partitionBy("pdf", "slice").orderBy("number"))
    return rows.withColumn("following", following).join(ahead, ["pdf", "slice"]).select("pdf", "number", F.coalesce("following", "later").alias("next"))


def before(rows: DataFrame, value: Column, into: str) -> DataFrame:
    """``rows`` of pages with the last ``value`` that isn't null of the pages before in their file, by the same slices."""
    rows = rows.withColumn("v", value).withColumn("slice", F.floor(F.col("number") / PAGE_SLICE))
    order = ["number", "page_id"]
    inside = F.last("v", ignorenulls=True).over(Window.partitionBy("pdf", "slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    last = rows.where("v is not null").groupBy("pdf", "slice").agg(F.max_by("v", F.struct(*order)).alias("lv"))
    slices = rows.select("pdf", "slice").distinct().join(last, ["pdf", "slice"], "left")
    carried = F.last("lv", ignorenulls=True).over(Window.partitionBy("pdf").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    slices = slices.select("pdf", "slice", carried.alias("carried"))
    return rows.withColumn("in", inside).join(slices, ["pdf", "slice"]).withColumn(into, F.coalesce("in", "carried")).drop("v", "in", "carried", "slice")


def repairs(pages: DataFrame) -> DataFrame:
    """``(field, page_id, line_no, kind, word)`` of what is to be repaired in ``text`` and ``data``.

    ``join``: a word broken across lines or pages; ``char``: an unbroken word
    with misread characters; ``drop``: a running line. Null and empty texts
    need nothing. A page goes on in the next one of its file that isn't blank.
    """
    return findings(pages).select("field", "page_id", "line_no", "kind", "word").distinct()


def findings(pages: DataFrame) -> DataFrame:
    """``repairs`` with ``was``, the form that a misread word has in the text, and ``crossing``, whether a word goes on in the next page."""
    drops = cut(running_lines(pages))
    by_page = drops.groupBy("page_id").agg(F.sort_array(F.collect_list("line_no")).alias("dropped"))
    source = pages.where(F.col("page_id").isNotNull()).select("page_id", F.coalesce("pdf_name", F.concat(F.lit("#"), F.col("page_id").cast("string"))).alias("pdf_name"), F.coalesce("page_number", F.lit(0)).alias("page_number"), "text", "data")
    texts = source.where(F.col("text").rlike(r"\S")).join(by_page, "page_id", "left").select("page_id", "pdf_name", "page_number", F.lit("text").alias("field"), F.col("text").alias("body"), "dropped")
    figures = source.where(F.length("data") > 0).select("page_id", "pdf_name", "page_number", F.lit("data").alias("field"), F.col("data").alias("body"), F.lit(None).cast("array<int>").alias("dropped"))
    fields = spread(texts.unionByName(figures))

    columns = [x.split()[0] for x in _TOKENS_SCHEMA.split(", ")]

    def tokenise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [_token_row(int(p), f, int(n), field, text, dropped) for p, f, n, field, text, dropped in zip(batch["page_id"], batch["pdf_name"], batch["page_number"], batch["field"], batch["body"], batch["dropped"])]
            out = pd.DataFrame(rows, columns=columns)
            yield out.astype({"o_line": "Int32", "f_line": "Int32"})

    # One pass in Python; all that follows reads its arrays.
    tokens = cut(fields.mapInPandas(tokenise, _TOKENS_SCHEMA))
    edges = tokens.where("field = 'text'")

    # Broken at the end of a page: the next page of the file that has text.
    firsts = edges.groupBy("pdf", "number").agg(F.min(F.when(F.col("f_token") != "", F.col("f_token"))).alias("tail"))
    ahead = next_pages(firsts).where("next is not null").join(firsts.select("pdf", F.col("number").alias("next"), "tail"), ["pdf", "next"]).where("tail is not null")
    crossing = cut(edges.where("o_head is not null").select("page_id", "pdf", "number", F.col("o_line").alias("line_no"), F.col("o_head").alias("a")).join(ahead, ["pdf", "number"]).select("page_id", "pdf", F.col("next").alias("at"), "line_no", "a", F.col("tail").alias("b")))
    # A page's first token is a whole word unless the page before left one open.
    begun = edges.where("f_token <> '' and f_line > 0").select("field", "page_id", "pdf", "number", F.col("f_line").alias("line_no"), F.col("f_token").alias("a"), F.col("f_part").alias("b"), F.col("f_right").alias("c"))
    begun = begun.join(crossing.select("pdf", F.col("at").alias("number")).distinct(), ["pdf", "number"], "left_anti")
    bare = lambda x: F.lower(F.regexp_replace(x, r"^[.,;:()\[\]{}\"'„“”‚‘’«»‹›?…–—*]+|[.,;:()\[\]{}\"'„“”‚‘’«»‹›?…–—*]+$", ""))
    masked = lambda x: F.regexp_replace(x, r"\d+", "#")
    begun = begun.select("field", "page_id", "line_no", bare(F.col("a")).alias("word"), F.lit("").alias("left"), F.col("c").alias("right"), (F.col("b") == "broken").alias("part"))
    whole = begun.where(~F.col("part") & F.col("word").rlike(r"\p{L}")).drop("part")
    running = tokens.select("field", "page_id", F.explode(F.arrays_zip("lines", "words", "lefts", "rights")).alias("x")).select("field", "page_id", F.col("x.lines").alias("line_no"), F.col("x.words").alias("word"), F.col("x.lefts").alias("left"), F.col("x.rights").alias("right"))
    pair = lambda l, r: F.struct(l.alias("word"), r.cast("string").alias("other"))
    after = F.when(F.col("right") != "", pair(masked(F.col("word")), F.concat(F.lit("\t"), "right")))
    said = running.unionByName(whole).select(F.explode(F.array_compact(F.array(pair(F.col("word"), F.lit(None)), pair(F.col("left"), masked(F.col("word"))), after))).alias("x"))
    counted = cut(said.groupBy("x.word", "x.other").agg(F.count("*").alias("n")))
    vocabulary = counted.where("other is null").select("word", "n").withColumn("s", _skeleton_column(F.col("word")))
    # (left, right) as one key; a right neighbour is kept apart by its mark.
    context = counted.where("other is not null").select(F.col("word").alias("l"), F.col("other").alias("r"), "n")
    noisy = lambda w: w.rlike(r"[!|ﬁﬂﬀ]|[a-zäöüß][0156]|[0156][a-zäöüß]")
    tops = vocabulary.groupBy("s").agg(F.max("n").alias("most"), F.max_by("word", F.struct(~noisy(F.col("word")), "n", "word")).alias("top"), F.max(F.when(~noisy(F.col("word")), F.col("n"))).alias("topn"), F.count("*").alias("forms"))
    several = vocabulary.join(tops.where("forms > 1").select("s", "most"), "s")
    strong = several.where((F.col("n") * 50 >= F.col("most")) & (F.col("n") >= 2) & ~noisy(F.col("word"))).select("s", F.col("word").alias("c"), F.col("n").alias("nc"))
    short = F.length("word") <= 3
    enough = F.col("nc") >= F.col("n") * F.when(noisy(F.col("word")), F.lit(RATIO_NOISE)).when(short, F.lit(RATIO_SHORT)).otherwise(F.lit(RATIO))
    ways = cut(several.select("s", "word", "n").join(strong, "s").where((F.col("word") != F.col("c")) & enough & F.col("word").rlike(r"..")).select("word", "n", "c", "nc"))
    broken = tokens.select("field", "page_id", F.explode(F.arrays_zip("at", "heads", "tails")).alias("x")).select("field", "page_id", F.col("x.at").alias("line_no"), F.col("x.heads").alias("a"), F.col("x.tails").alias("b"), F.lit(False).alias("crossing"))
    broken = broken.unionByName(crossing.select(F.lit("text").alias("field"), "page_id", "line_no", "a", "b", F.lit(True).alias("crossing")))

    # Only words that another form may replace go on; a frequent one of them is dealt over tasks.
    occurrences = running.unionByName(begun.drop("part"))
    doubtful = split_join(occurrences.join(broadcast_if_small(ways.select("word").distinct()), "word", "left_semi"), ways, "word")

    def support(df: DataFrame, form: str, into: str) -> DataFrame:
        before = context.where(~F.startswith("r", F.lit("\t"))).select(F.col("l").alias("left"), F.col("r").alias("m"), F.col("n").alias("x1"))
        after = context.where(F.startswith("r", F.lit("\t"))).select(F.col("l").alias("m"), F.substring("r", 2, 100000).alias("right"), F.col("n").alias("x2"))
        df = df.withColumn("m", masked(F.col(form)))
        df = df.join(before, ["left", "m"], "left").join(after, ["m", "right"], "left")
        return df.withColumn(into, F.coalesce("x1", F.lit(0)) + F.coalesce("x2", F.lit(0))).drop("x1", "x2", "m")

    weighed = support(support(doubtful, "c", "sc"), "word", "sw")
    # The word's own occurrences support it in both directions; they don't count.
    sound = (F.col("nc") >= RATIO_SURE * F.col("n")) | noisy(F.col("word")) | (F.col("sc") > F.col("sw") - 2) | ((F.col("n") == 1) & (F.col("nc") >= 8))
    fixed = weighed.where(sound).groupBy("field", "page_id", "line_no", "word", "left", "right").agg(F.max_by("c", F.struct("sc", "nc", "c")).alias("fixed"))
    misread = fixed.select("field", "page_id", "line_no", F.lit("char").alias("kind"), F.col("fixed").alias("word"), F.col("word").alias("was"), F.lit(False).alias("crossing"))

    # Broken words: with or without the hyphen, whichever the corpus has more of, misread or not.
    tail = bare(F.col("b"))
    head = F.lower(F.regexp_replace(F.col("a"), r"^[.,;:()\[\]{}\"'„“”‚‘’«»‹›?…–—*]+", ""))
    forms = broken.select("field", "page_id", "line_no", "crossing", head.alias("h"), tail.alias("t")).distinct()
    forms = forms.withColumns({"x": F.concat("h", "t"), "y": F.concat("h", F.lit("-"), "t")})
    known = vocabulary.select("word", "n")
    best = tops.where("topn is not null").select("s", "top", "topn")
    for form in ("x", "y"):
        forms = forms.withColumn("s", _skeleton_column(F.col(form))).join(known.select(F.col("word").alias(form), F.col("n").alias(f"n{form}")), form, "left").join(best.select("s", F.col("top").alias(f"t{form}"), F.col("topn").alias(f"m{form}")), "s", "left").drop("s")
        trust = F.coalesce(f"n{form}", F.lit(0)) * RATIO >= F.coalesce(f"m{form}", F.lit(0))
        forms = forms.withColumns({f"w{form}": F.when(trust, F.col(form)).otherwise(F.col(f"t{form}")), f"c{form}": F.greatest(F.coalesce(f"n{form}", F.lit(0)), F.coalesce(f"m{form}", F.lit(0)))})
    forms = forms.join(known.select(F.col("word").alias("h"), F.col("n").alias("nh")), "h", "left").join(known.select(F.col("word").alias("t"), F.col("n").alias("nt")), "t", "left")
    own_hyphen = (F.col("cy") > F.col("cx")) | ((F.col("cx") == 0) & (F.col("cy") == 0) & ((F.col("nh") >= 3) & (F.col("nt") >= 3) | F.col("t").rlike(r"^\d") | F.col("h").rlike(r"\d$")))
    joined = forms.select("field", "page_id", "line_no", F.lit("join").alias("kind"), F.when(F.coalesce(own_hyphen, F.lit(False)), F.col("wy")).otherwise(F.col("wx")).alias("word"), F.lit("").alias("was"), "crossing").where("word <> ''")
    dropped = drops.select(F.lit("text").alias("field"), "page_id", "line_no", F.lit("drop").alias("kind"), F.lit("").alias("word"), F.lit("").alias("was"), F.lit(False).alias("crossing"))
    return misread.unionByName(joined).unionByName(dropped).distinct()


# ------------------------------------------------------------------ paragraphs

_SENTENCE_END = re.compile(r"[.!?。！？…][\"'”’»」』)）]*$")


def _like(form: str, token: str) -> str:
    """A repaired form, in small letters, written as the token it replaces: in capitals, with a capital, or small; its edges stay."""
    lead = len(token) - len(token.lstrip(_EDGE))
    core = token.strip(_EDGE)
    letters = [x for x in core if x.isalpha()]
    if len(letters) > 1 and sum(x.isupper() for x in letters) * 2 > len(letters):
        form = form.upper()
    elif core[:1].isupper():
        form = form[:1].upper() + form[1:]
    return token[:lead] + form + token[lead + len(core) :]


def reflow(text: str | None, dropped: set[int], misread: dict[tuple[int, str], str], joins: dict[int, str], handed: str | None = None, hands_on: bool = False) -> tuple[list[str], bool]:
    """The paragraphs of a page's text, repaired, and whether the last one is open at the end.

    ``joins`` has the whole word of a line whose last word goes on in the next
    line. ``handed`` is the whole word that the page before began: it takes the
    place of the first one. With ``hands_on`` the last word goes to the next
    page and is left out. A line ends a paragraph if the next line's first word
    would still have fitted in, or a blank line follows.
    """
    lines = [(i, x.strip()) for i, x in enumerate(_lines(text), 1) if i not in dropped]
    wide = max((_width(x) for _, x in lines), default=0)
    paragraphs: list[str] = []
    open_, pending = False, handed  # the word that the next line's first token is part of
    full = [k for k, (_, x) in enumerate(lines) if x]
    for k, (i, line) in enumerate(lines):
        if not line:
            open_ = open_ and k > full[-1] if full else False
            continue
        tokens = list(re.finditer(r"\S+", line))
        out, at = [], 0
        for n, m in enumerate(tokens):
            token, last = m.group(), n == len(tokens) - 1
            out.append(line[at : m.start()] if n else "")
            at = m.end()
            if n == 0 and pending is not None:
                edge = len(token.rstrip(_EDGE))
                token, pending = pending + token[edge:], None
            elif last and token[-1] in HYPHENS and (i in joins or (hands_on and k == full[-1])):
                if i in joins:
                    pending = _like(joins[i], token[:-1])
                out.append("")
                continue
            else:
                token = _TOKEN.sub(lambda t: _like(misread[i, _bare(t.group())], t.group()) if (i, _bare(t.group())) in misread else t.group(), token)
            out.append(token)
        said = "".join(out).rstrip()
        if open_ and paragraphs:
            blank = "" if not said or not paragraphs[-1] or (re.match(rf"[{_CJK}，。、；：]", said) and re.search(rf"[{_CJK}，。、；：]$", paragraphs[-1])) else " "
            paragraphs[-1] += blank + said
        else:
            paragraphs.append(said)
        # Does the paragraph go on in the next line?
        after = next((lines[j][1] for j in full if j > k), None)
        if pending is not None or after is None:
            open_ = True
        else:
            word = 2 if re.match(rf"[{_CJK}]", after) else _width(after.split()[0])
            open_ = _width(line) + 1 + word > wide - 2
    opened = bool(paragraphs) and open_ and (hands_on or not _SENTENCE_END.search(paragraphs[-1]))
    return [x for x in paragraphs if x] if not opened else [x for x in paragraphs[:-1] if x] + paragraphs[-1:], opened


def paragraphs(pages: DataFrame) -> DataFrame:
    """``(field, pdf_name, page_id, para_no, text)``: the continuous paragraphs of ``text`` and ``data``, by the page and place where each begins.

    Running lines are gone, words are repaired and joined, a paragraph that a
    page leaves open goes on in the next page of its file that isn't blank.
    Pages delivered twice count once (the least page_id); null and blank fields
    have no paragraphs; rows with a null key fall out.
    """
    source = pages.where(F.col("page_id").isNotNull()).select("page_id", F.coalesce("pdf_name", F.concat(F.lit("#"), F.col("page_id").cast("string"))).alias("pdf"), F.coalesce("page_number", F.lit(0)).alias("number"), "pdf_name", "text", "data")
    same = source.groupBy("pdf", "number", F.md5(F.coalesce("text", F.lit(""))).alias("t"), F.md5(F.coalesce("data", F.lit(""))).alias("d")).agg(F.min("page_id").alias("page_id")).select("page_id")
    found = cut(findings(pages))
    kept = cut(source.join(same.distinct(), "page_id", "left_semi").dropDuplicates(["page_id"]))
    fixes = found.groupBy("field", "page_id").agg(F.collect_list(F.struct("line_no", "kind", "word", "was", "crossing")).alias("fixes"))
    texts = kept.where(F.col("text").rlike(r"\S")).select("page_id", "pdf", "number", F.lit("text").alias("field"), F.col("text").alias("body"))
    figures = kept.where(F.col("data").rlike(r"\S")).select("page_id", "pdf", "number", F.lit("data").alias("field"), F.col("data").alias("body"))
    # The word that a page begins and the next one ends is handed on.
    begun = found.where("crossing").join(kept.select("page_id", "pdf", "number"), "page_id").groupBy("pdf", "number").agg(F.max("word").alias("handed"))
    handed = begun.join(next_pages(texts), ["pdf", "number"]).where("next is not null").select("pdf", F.col("next").alias("number"), F.lit("text").alias("field"), "handed")
    rows = texts.unionByName(figures).join(fixes, ["field", "page_id"], "left").join(handed, ["pdf", "number", "field"], "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                dropped, misread, joins, hands_on = set(), {}, {}, False
                for x in row.fixes if row.fixes is not None else ():
                    if x["kind"] == "drop":
                        dropped.add(x["line_no"])
                    elif x["kind"] == "char":
                        misread[x["line_no"], x["was"]] = x["word"]
                    elif x["crossing"]:
                        hands_on = True
                    else:
                        joins[x["line_no"]] = x["word"]
                got, opened = reflow(row.body, dropped, misread, joins, None if pd.isna(row.handed) else row.handed, hands_on)
                out += [(row.field, row.pdf, row.number, row.page_id, n, len(got), opened and row.field == "text", t) for n, t in enumerate(got, 1)]
            yield pd.DataFrame(out, columns=["field", "pdf", "number", "page_id", "para_no", "n", "opened", "text"])

    kind = pages.schema["page_id"].dataType.simpleString()
    pieces = cut(spread(rows).mapInPandas(run, f"field string, pdf string, number int, page_id {kind}, para_no int, n int, opened boolean, text string"))
    # Where a page's first paragraph began: on the last page before that has a beginning of its own at its end.
    sheets = pieces.where("field = 'text' and para_no = 1").select("pdf", "number", "page_id", "n", "opened")
    sheets = before(sheets, F.col("opened"), "goes_on").withColumn("goes_on", F.coalesce("goes_on", F.lit(False)))
    own = F.when((F.col("n") > 1) | ~F.col("goes_on"), F.struct(F.col("page_id").alias("p"), F.col("n").alias("k")))
    anchors = before(sheets, own, "anchor").where("goes_on").select("page_id", F.lit("text").alias("field"), F.lit(1).alias("para_no"), "anchor")
    placed = pieces.join(anchors, ["field", "page_id", "para_no"], "left").withColumn("a", F.coalesce("anchor", F.struct(F.col("page_id").alias("p"), F.col("para_no").alias("k"))))
    whole = placed.groupBy("field", "pdf", F.col("a.p").alias("page_id"), F.col("a.k").alias("para_no")).agg(F.array_sort(F.collect_list(F.struct("number", F.col("page_id").alias("page"), "para_no", "text"))).alias("x"))
    east = rf"[{_CJK}，。、；：]"
    join = lambda a, b: F.when(F.rlike(a, F.lit(east + "$")) & F.rlike(b, F.lit("^" + east)), F.concat(a, b)).otherwise(F.trim(F.concat(a, F.lit(" "), b)))
    text = F.aggregate(F.slice("x", F.lit(2), F.greatest(F.size("x") - 1, F.lit(0))), F.element_at("x", 1)["text"], lambda done, y: join(done, y["text"]))
    named = F.when(~F.startswith("pdf", F.lit("#")), F.col("pdf"))
    return whole.select("field", named.alias("pdf_name"), "page_id", "para_no", text.alias("text")).where("text <> ''")
