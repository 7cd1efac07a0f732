"""The main body of a web page, without what a site puts around it (problem 1).

Method: composite text density. Every DOM node gets its characters per tag,
adjusted for links; a node's density sum is that of its children; the subtree
of the greatest sum is the body, and the least density on its path to the
page's body is the threshold under which boxes inside are dropped.

No list of words takes part. What stands in one box with the article (by-lines,
tags, pointers, offers) is told by what density says of all pages: blocks amid
the sentences of the densest subtrees, and blocks outside of them, are counted
by their masked word sequences. A block whose sequences stand amid articles
rarely, or often outside of them, carries no characters for the density of its
own page, which is then weighed again. Lists of links are told by structure.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from tessella.llm.dom import Node, parse, walk
from tessella.plans.runtime import cut, spread

#: Buckets of the hashed word sequences: the size of what the corpus says, whatever the corpus.
BUCKETS = 1 << 19
#: Pages whose lists are in Python at once.
SLICE = 256
#: Times that the corpus is counted and the pages are weighed again.
ROUNDS = 2
#: Share of a sequence's blocks amid articles under which it speaks against an article, and of those outside of them over which it does.
AMID, OUTSIDE = 0.2, 0.4
#: What is added to the first score; the score under which a block goes; that for list items and cells, whose words tell less.
LEAN, LEAST, LEAST_LISTED = 0.2, 0.0, -1.0
#: Occurrences from which a sequence counts, and from which a whole block's does alone.
SEEN, SEEN_WHOLE = 3, 6
#: Share of a block's sequences that the corpus must know to judge it.
KNOWN = 0.4
#: Share of the threshold under which a box inside the body is dropped: the path's own density is that of far larger subtrees.
THIN = 0.2
#: Width in Latin letters from which a link may be a title, from which a text may be a sentence; blocks before the first sentence among which the headline is.
TITLE_WIDTH, SENTENCE_WIDTH, HEADLINE_WITHIN = 38, 25, 12
_BUTTONS = frozenset({"button", "option", "label", "input"})
_INLINE_BOXES = frozenset("ul ol dl li dt dd table tbody thead tr figure blockquote b i em strong a span p h1 h2 h3 h4 h5 h6".split())
_BOXES = frozenset("div aside section nav footer".split())
_EAST = "぀-ヿ㐀-鿿"
_CJK = re.compile(rf"[{_EAST}]")
_TOKEN = re.compile(rf"[{_EAST}]|[^\W\d_{_EAST}]+|\d+(?:[.,:/-]\d+)*|[^\w\s]")
_TITLE = re.compile(r"<title[^>]*>(.*?)</title", re.IGNORECASE | re.DOTALL)


def _width(text: str) -> int:
    """Length in Latin letters: an East Asian character says as much as three."""
    return len(text) + 2 * len(_CJK.findall(text))


@dataclass
class Page:
    """A page as lists: its nodes in document order (0 is the root), of its blocks the nodes with what density needs, and their word sequences' buckets one after the other."""

    parents: list[int] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    chars: list[int] = field(default_factory=list)
    nodes: list[int] = field(default_factory=list)
    numbers: list[int] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    links: list[bool] = field(default_factory=list)
    bare: list[bool] = field(default_factory=list)
    sequences: list[int] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)
    wholes: list[int] = field(default_factory=list)


_PAGE = "parents array<int>, tags array<string>, chars array<int>, nodes array<int>, numbers array<int>, texts array<string>, links array<boolean>, bare array<boolean>, sequences array<int>, ends array<int>, wholes array<int>"
_FIELDS = [x.split()[0] for x in _PAGE.split(", ")]


def _own_text(node: Node) -> tuple[str, int]:
    """A block's text without that of numbered blocks that bad markup put inside it, and its characters in links."""
    out, linked = [], 0
    stack = [(iter(node.content), False)]
    while stack:
        parts, in_link = stack[-1]
        for x in parts:
            if isinstance(x, str):
                out.append(x)
                linked += in_link * len("".join(x.split()))
            elif "data-n" not in x.attrs:
                stack.append((iter(x.content), in_link or x.tag == "a"))
                break
        else:
            stack.pop()
    return "".join(out), linked


def read_page(html: str | None) -> Page:
    """The lists of a page; null, empty and unreadable pages have no blocks."""
    page = Page()
    if not html:
        return page
    root = parse(html)
    order = [root, *walk(root)]
    place = {id(x): i for i, x in enumerate(order)}
    title = _TITLE.search(html)
    site = " ".join(title.group(1).split()).casefold() if title else ""
    for i, x in enumerate(order):
        page.parents.append(place[id(x.parent)] if x.parent is not None else -1)
        page.tags.append(x.tag)
        page.chars.append(sum(len("".join(t.split())) for t in x.content if isinstance(t, str)))
        n = x.attrs.get("data-n", "").strip()
        if not (n.isascii() and n.isdigit()) or len(n) > 9:
            continue
        own, linked = _own_text(x)
        text = " ".join(own.split())
        up = x
        while up is not None and up.tag != "a":
            up = up.parent
        page.nodes.append(i)
        page.numbers.append(int(n))
        page.texts.append(text)
        page.links.append(bool(text) and (up is not None or linked >= 0.8 * len("".join(text.split()))))
        # Bare of an article's text whatever it says: nothing, a button, the site's name.
        page.bare.append(not text or x.tag in _BUTTONS or text.casefold() == site)
    page.sequences, page.ends, page.wholes = sequences(page.texts)
    return page


class _Hashes(dict):
    def __missing__(self, token: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[token] = value = xxhash.xxh64_intdigest(token)
        return value


_HASHES = _Hashes()
_MIX, _LAST = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x5851F42D4C957F2D)
_NUMBER, _DIGITS = re.compile(r"\d+(?:[.,]\d+)?"), re.compile(r"\d+")


def sequences(texts: list[str]) -> tuple[list[int], list[int], list[int]]:
    """Buckets of the sequences of one to three words of each block, digits masked, and of its last ones: all blocks' after each other, where each block's end, and the bucket of each whole."""
    tokens, sizes = [], []
    for text in texts:
        before = len(tokens)
        for t in _TOKEN.findall(text):
            if t[0].isdigit():
                t = "#" if t.isdecimal() or _NUMBER.fullmatch(t) else _DIGITS.sub("#", t)
            tokens.append(_HASHES[t.lower()])
        sizes.append(len(tokens) - before)
    one = np.array(tokens, np.uint64)
    last = np.cumsum(sizes, dtype=np.int64)
    wholes = [xxhash.xxh64_intdigest(one[e - n : e].tobytes(), 1) & (BUCKETS - 1) for e, n in zip(last.tolist(), sizes)]
    if not tokens:
        return [], [0] * len(texts), wholes
    owner = np.repeat(np.arange(len(sizes)), sizes)
    filled = np.flatnonzero(np.array(sizes) > 0)
    with np.errstate(over="ignore"):
        h, parts, owners = one, [one, one[last[filled] - 1] ^ _LAST], [owner, filled]
        for n in (2, 3):
            h = (h[:-1] ^ (h[:-1] >> np.uint64(29))) * _MIX + one[n - 1 :]
            inside = np.flatnonzero(owner[: len(h)] == owner[n - 1 :])
            parts.append(h[inside])
            owners.append(owner[inside])
            if n == 2:
                several = filled[np.array(sizes)[filled] > 1]
                parts.append(h[last[several] - 2] ^ _LAST)
                owners.append(several)
        h = np.concatenate(parts)
        h ^= h >> np.uint64(31)
    keys = np.unique(np.concatenate(owners) * BUCKETS + (h & np.uint64(BUCKETS - 1)).astype(np.int64))
    return (keys & (BUCKETS - 1)).tolist(), np.searchsorted(keys, np.arange(1, len(sizes) + 1) * BUCKETS).tolist(), wholes


@dataclass
class Corpus:
    """What the pages' densities say of each bucket: log odds of standing amid articles, of standing inside, of being a title elsewhere; 0 where unseen."""

    amid: np.ndarray
    inside: np.ndarray
    title: np.ndarray
    seen: np.ndarray  # bit 0: amid counts, bit 1: inside counts, bit 2: inside counts for a whole block

    @staticmethod
    def of(counts: pd.DataFrame) -> Corpus:
        full = {c: np.zeros(BUCKETS) for c in _COUNTS}
        for c in _COUNTS:
            full[c][counts["bucket"].to_numpy()] = counts[c].to_numpy()
        pos, neg, ins, outs, tit = (full[c] for c in _COUNTS)
        amid = np.log((pos + 0.25) / (neg + 0.75)) - math.log(AMID / (1 - AMID))
        inside = np.log((ins + 0.75) / (outs + 0.25)) - math.log((1 - OUTSIDE) / OUTSIDE)
        title = np.log((tit + 0.5) / (pos + np.maximum(0, neg - tit) + 0.5))
        seen = (pos + neg >= SEEN).astype(np.uint8) | ((ins + outs >= SEEN) << 1).astype(np.uint8) | ((ins + outs >= SEEN_WHOLE) << 2).astype(np.uint8)
        return Corpus(amid.astype(np.float32), inside.astype(np.float32), title.astype(np.float32), seen)

    def scores(self, page: Page) -> tuple[list[float], list[float]]:
        """Of each block how much the corpus speaks for it as part of an article, 0 if it knows too few of its sequences to say anything; and how much it reads like the titles by which other pages link articles."""
        buckets, ends, wholes = np.array(page.sequences, np.int64), np.array(page.ends, np.int64), np.array(page.wholes, np.int64)
        starts = np.concatenate([[0], ends[:-1]])

        def sums(x: np.ndarray) -> np.ndarray:
            upto = np.concatenate([[0], np.cumsum(x, dtype=np.float64)])
            return upto[ends] - upto[starts]

        seen, whole = self.seen[buckets], (self.seen[wholes] & 4) > 0
        some, within = (seen & 1) > 0, (seen & 2) > 0
        known = sums(some)
        first = sums(self.amid[buckets] * some) / (known + 1)
        second = np.where(whole, self.inside[wholes], sums(self.inside[buckets] * within) / (sums(within) + 1))
        judged = whole | (known >= KNOWN * (ends - starts))
        title = np.where(known > 0, sums(self.title[buckets] * some) / np.maximum(known, 1), -9.0)
        return np.where(judged, np.minimum(first + LEAN, second), 0.0).tolist(), title.tolist()


_COUNTS = ("pos", "neg", "ins", "outs", "tit")


class _Layout:
    """A page's blocks with what its structure says of them."""

    def __init__(self, page: Page):
        self.page, self.n = page, len(page.nodes)
        tags, parents = page.tags, page.parents
        self.tag = [tags[x] for x in page.nodes]
        self.width = [_width(t) for t in page.texts]
        self.box, self.listed = [], []
        for x in page.nodes:
            up = parents[x]
            self.listed.append(tags[x] in ("td", "th") or (tags[x] == "li" and up >= 0 and tags[up] in ("ul", "ol")))
            while up > 0 and parents[up] >= 0 and tags[up] in _INLINE_BOXES:
                up = parents[up]
            self.box.append(up)
        ends = [t.rstrip("\"”»」)）")[-1:] for t in page.texts]
        self.title_like = [l and w >= TITLE_WIDTH and t[-1:] not in ".。!！" and not li for l, w, t, li in zip(page.links, self.width, page.texts, self.listed)]
        self.sentence = [not l and e != "" and e in ".。!！?？" and w >= SENTENCE_WIDTH for l, e, w in zip(page.links, ends, self.width)]

    def runs(self, out: list[bool]) -> list[bool]:
        """``out`` with the lists of links: under a short heading, titles in a row with their summaries, navigation."""
        out, page, n, box = list(out), self.page, self.n, self.box
        i = 0
        while i < n:
            if page.links[i] or self.sentence[i] or self.listed[i] or self.tag[i] == "h1":
                i += 1
                continue
            j, links = i + 1, 0
            while j < n and box[j] == box[i] and (page.links[j] or (links and page.links[j - 1])) and self.tag[j] != "h1":
                links += page.links[j] and self.width[j] >= 20
                j += 1
            if links >= 2:
                out[i:j] = [True] * (j - i)
                i = j
            else:
                i += 1
        i = 0
        while i < n:
            if not self.title_like[i]:
                i += 1
                continue
            last, j, summaries = i, i + 1, False
            while j < n and j - last <= 2 and box[j] == box[i]:
                if self.title_like[j]:
                    summaries |= j - last == 2
                    last = j
                j += 1
            if last > i or (i > 0 and out[i - 1]):
                if summaries and last + 1 < n and box[last + 1] == box[i] and not page.links[last + 1]:
                    last += 1
                out[i : last + 1] = [True] * (last + 1 - i)
            i = last + 1
        i = 0
        while i < n:
            j = i
            while j < n and page.links[j] and self.width[j] < TITLE_WIDTH:
                j += 1
            if j - i >= 3 or (j > i and (i == 0 or out[i - 1]) and (j == n or out[j])):
                up = page.parents[page.nodes[i]]
                listed = self.listed[i] and any(box[k] == box[i] and self.listed[k] and not page.links[k] and not out[k] and page.parents[page.nodes[k]] == up for k in range(n))
                amid = any(box[k] == box[i] and self.sentence[k] and not out[k] for k in range(i)) and any(box[k] == box[i] and not page.links[k] and not out[k] for k in range(j, n))
                if not listed and not (amid and all(self.listed[i:j])):
                    out[i:j] = [True] * (j - i)
            i = max(j, i + 1)
        return out

    def dense(self, out: list[bool]) -> list[bool]:
        """The blocks that the page's densest subtree holds when those that are out carry no characters."""
        page = self.page
        parents, tags, m = page.parents, page.tags, len(page.parents)
        if self.n == 0:
            return []
        gone = [False] * m
        for x, o in zip(page.nodes, out):
            gone[x] = o
        chars, count, link_chars, link_tags = [0 if g else c for g, c in zip(gone, page.chars)], [0] * m, [0] * m, [0] * m
        for x in range(m - 1, -1, -1):
            if tags[x] == "a":
                link_chars[x] = chars[x]
            up = parents[x]
            if up >= 0:
                count[up] += 1 + count[x]
                link_tags[up] += link_tags[x] + (tags[x] == "a")
                if not gone[up]:
                    chars[up] += chars[x]
                    link_chars[up] += link_chars[x]
        body = next((x for x in range(m) if tags[x] == "body"), 0)
        part = link_chars[body] / max(1, chars[body])
        value, total = [0.0] * m, [0.0] * m
        for x in range(m):
            c = chars[x]
            if c:
                t, lc, lt = max(1, count[x]), max(1, link_chars[x]), max(1, link_tags[x])
                base = math.log(c / max(1, c - link_chars[x]) * link_chars[x] + part * c + math.e)
                value[x] = c / t * math.log(max(1.0, c / lc * t / lt) + base - 1) / math.log(max(base, 1.0) + math.e - 1)
                if parents[x] >= 0:
                    total[parents[x]] += value[x]
        best = max((x for x in range(m) if tags[x] not in _INLINE_BOXES), key=total.__getitem__, default=0)
        if not total or total[best] <= 0:
            return [False] * self.n
        # The threshold: the least density on the way from the body of the page to the subtree.
        threshold, x = value[best], best
        while x != body and parents[x] >= 0:
            threshold = min(threshold, value[x])
            x = parents[x]
        numbered = set(page.nodes)
        held = [False] * m
        for x in range(best, m):
            up = parents[x]
            thin = x != best and tags[x] in _BOXES and x not in numbered and value[x] < THIN * threshold
            held[x] = x == best or (up >= best and held[up] and not thin)
        return [held[x] and not o for x, o in zip(page.nodes, out)]


class _Reading:
    """Which blocks of a page are its article's, as far as structure, density and the corpus say."""

    def __init__(self, page: Page, corpus: Corpus | None):
        self.page, self.layout = page, _Layout(page)
        layout = self.layout
        self.linked = layout.runs(page.bare)
        if corpus is None or not page.nodes:
            self.kept = layout.dense(self.linked)
        else:
            scores, self.titles = corpus.scores(page)
            self.kept = layout.dense(layout.runs([o or s < (LEAST_LISTED if li else LEAST) for o, s, li in zip(page.bare, scores, layout.listed)]))
        self.core = [i for i in range(layout.n) if self.kept[i] and layout.sentence[i]]
        if not self.core:
            self.kept = [False] * layout.n
        elif corpus is not None:
            self._headline()

    def _headline(self) -> None:
        """The headline: before the first sentence, a top heading or what reads most like titles elsewhere; the article begins with it."""
        page, layout, ways = self.page, self.layout, []
        for i in range(max(0, self.core[0] - HEADLINE_WITHIN), self.core[0]):
            if not page.links[i] and not page.bare[i] and (layout.tag[i] == "h1" or not layout.sentence[i]):
                ways.append((layout.tag[i] == "h1", self.titles[i], i))
        ways = [w for w in ways if w[0] or w[1] > -1.0]
        if ways:
            at = max(ways)[2]
            self.kept = [False] * at + [True] + self.kept[at + 1 :]

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """The buckets of all blocks, and of each of them what it adds to the counts, a bit each.

        Amid an article is what stands after its first and before its last but
        one sentence, inside what stands between its first and its last one;
        outside what is neither, and no list of links.
        """
        page, core, flags = self.page, self.core, []
        first, last = (core[0], core[-1]) if core else (self.layout.n, -1)
        late = core[-2] if len(core) >= 4 else -1
        for i, text in enumerate(page.texts):
            amid, inside = first < i < late and self.kept[i], first <= i <= last
            outside = not inside and not self.linked[i] and not page.links[i]
            flags.append(0 if not text else (1 if amid else 2) | 4 * inside | 8 * outside | 16 * (page.links[i] and self.layout.width[i] >= TITLE_WIDTH))
        flags = np.array(flags, np.uint8)
        sizes = np.diff(np.array([0, *page.ends]))
        return np.array(page.sequences + page.wholes, np.int64), np.concatenate([np.repeat(flags, sizes), flags])

    def numbers(self) -> list[int]:
        return sorted({n for n, k in zip(self.page.numbers, self.kept) if k})

    def text(self) -> str:
        return "\n".join(t for t, k in zip(self.page.texts, self.kept) if k)


def article_blocks(html: str | None, corpus: Corpus | None = None) -> list[int]:
    """The numbers (``data-n``) of the blocks of a page's own article, ascending.

    Null, empty and unreadable pages, and index pages without an article of
    their own, have none. Without a corpus, structure and density alone decide.
    """
    return _Reading(read_page(html), corpus).numbers()


def article_text(html: str | None, corpus: Corpus | None = None) -> str | None:
    """The text of a page's own article, a block a line; null for a null page, empty where there is none."""
    return None if html is None else _Reading(read_page(html), corpus).text()


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Few pages at a time, whatever the batches: a page's lists take many times its bytes in Python."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def _pages(batch: pa.RecordBatch) -> Iterator[Page]:
    for row in zip(*(batch.column(c).to_pylist() for c in _FIELDS)):
        yield Page(*row)


def _arrow(schema: str) -> pa.Schema:
    return to_arrow_schema(_parse_datatype_string(schema))


def _read(pages: DataFrame, key: str, html: str) -> DataFrame:
    """The pages' lists, written once: a page is parsed a single time."""
    schema = f"key {pages.schema[key].dataType.simpleString()}, missing boolean, {_PAGE}"
    fields = _arrow(_PAGE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            texts = batch.column("html")
            read = [read_page(h) for h in texts.to_pylist()]
            lists = [pa.array([getattr(p, f.name) for p in read], f.type) for f in fields]
            yield pa.RecordBatch.from_arrays([batch.column("key"), texts.is_null(), *lists], ["key", "missing", *_FIELDS])

    return cut(spread(pages.select(F.col(key).alias("key"), F.col(html).alias("html"))).mapInArrow(run, schema))


def learn(read: DataFrame, rounds: int = ROUNDS) -> Corpus | None:
    """What all pages' densities say of word sequences; each round weighs the pages by what the one before found.

    The counts are added up where they arise; what is gathered has BUCKETS rows at most.
    """
    spark, corpus = read.sparkSession, None
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(corpus)

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known = shared.value
            sums = {c: np.zeros(BUCKETS, np.int64) for c in _COUNTS}
            for batch in _slices(batches):
                found = [_Reading(page, known).counts() for page in _pages(batch) if page.nodes]
                if found:
                    buckets, flags = (np.concatenate(x) for x in zip(*found))
                    for bit, c in enumerate(_COUNTS):
                        sums[c] += np.bincount(buckets[(flags >> bit) & 1 > 0], minlength=BUCKETS)
            some = np.flatnonzero(sum(sums.values()))
            yield pa.RecordBatch.from_pydict({"bucket": some, **{c: x[some] for c, x in sums.items()}})

        counts = read.mapInArrow(count, "bucket bigint, " + ", ".join(f"{c} bigint" for c in _COUNTS)).groupBy("bucket").agg(*[F.sum(c).alias(c) for c in _COUNTS])
        corpus = Corpus.of(counts.where(F.col("pos") + F.col("neg") >= SEEN).toArrow().to_pandas())
    return corpus


def pages_to_blocks(pages: DataFrame, key: str = "page_id", html: str = "html", rounds: int = ROUNDS) -> DataFrame:
    """``(page_id, block_n)`` of the numbered blocks of each page's own article; rows with a null key fall out.

    ``rounds`` 0 leaves out what the corpus says: structure and density of the page alone.
    """
    schema = f"{key} {pages.schema[key].dataType.simpleString()}, block_n int"
    read = _read(pages.where(F.length(html) > 0), key, html)
    shared = pages.sparkSession.sparkContext.broadcast(learn(read, rounds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            found = [_Reading(page, shared.value).numbers() for page in _pages(batch)]
            rows = np.repeat(np.arange(len(found)), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(rows)), pa.array([n for x in found for n in x], pa.int32())], [key, "block_n"])

    return read.where("key is not null").mapInArrow(run, schema)


def pages_to_text(pages: DataFrame, key: str = "page_id", html: str = "html", rounds: int = ROUNDS) -> DataFrame:
    """``(page_id, text)``: the article's text of each page (see ``article_text``)."""
    schema = f"{key} {pages.schema[key].dataType.simpleString()}, text string"
    read = _read(pages, key, html)
    shared = pages.sparkSession.sparkContext.broadcast(learn(read, rounds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            texts = [None if m else _Reading(page, shared.value).text() for m, page in zip(batch.column("missing").to_pylist(), _pages(batch))]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(texts, pa.string())], [key, "text"])

    return read.mapInArrow(run, schema)
