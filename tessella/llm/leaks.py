"""Evaluation passages inside training text (problem 9).

Method: winnowing. Of every text, on both sides, only the least k-gram hash of
each window of w k-grams is kept; the fingerprints of corpus and evaluation
items are joined, and each hit is extended to the whole sentence. Every shared
span of k + w - 1 tokens shares a fingerprint. With one token in ten changed,
the longest untouched run of a sentence of ten tokens or more has at least
five, which sets k and w; how many fingerprints a sentence must share follows
from the same count and thins the candidates before they are extended.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.sentences import split_sentences
from tessella.llm.skeleton import skeleton
from tessella.plans.pairs import split_join
from tessella.plans.runtime import broadcast_if_small, cut, spread

K, W = 4, 2
#: Bits of the sieve of the items' fingerprints: of fixed size, it only keeps corpus fingerprints that meet nothing from being shuffled.
SIEVE_BITS = 1 << 24
#: Candidate sentences of one document that are extended in one row.
CANDIDATES = 512
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
_MARKS = re.compile(r"[^\w\s]|_")
_WORD = re.compile(r"\w")
_AFTER_LETTER = re.compile(r"(?<=\s\w\.)\s+(?=[^\W\da-z])")
_MIX = np.uint64(0x9E3779B97F4A7C15)


# Greek small letters whose capital has a Latin shape; in capitals they can't be told apart.
_CAPITAL_SHAPES = str.maketrans("αβεζηικμορτυχ", "abezhikmoptyx")


def plain(text: str) -> str:
    """A text without case and character variants."""
    return unicodedata.normalize("NFC", skeleton(text)).casefold().translate(_CAPITAL_SHAPES)


def item_sentences(text: str) -> list[str]:
    """The sentences of an item. A single letter may end one ("type A. Then"); only short pieces are joined again."""
    out: list[str] = []
    for sentence in split_sentences(text):
        parts = _AFTER_LETTER.split(sentence)
        if len(parts) > 1 and all(len(x.split()) >= 6 for x in parts):
            out += parts
        else:
            out.append(sentence)
    return out


def words_of(text: str) -> list[str]:
    """The words of a plain text, without punctuation."""
    return _MARKS.sub("", text).split()


def characters_of(text: str) -> list[str]:
    """The letters and digits of a plain text."""
    return [x for x in text if x.isalnum()]


class _Hashes(dict):
    def __missing__(self, token: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[token] = value = xxhash.xxh64_intdigest(token)
        return value


_HASHES = _Hashes()


def winnow(tokens: list[str], k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of the fingerprints of a token list; fewer than k tokens have none."""
    n = len(tokens) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    one = np.fromiter(map(_HASHES.__getitem__, tokens), np.uint64, len(tokens))
    grams = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            grams = (grams ^ (grams >> np.uint64(29))) * _MIX + one[j : j + n]
        grams ^= grams >> np.uint64(32)
    if w == 1:
        at = np.arange(n)
    elif n <= w:
        at = np.array([int(np.argmin(grams))])
    elif w == 2:
        at = np.arange(n - 1) + (grams[1:] <= grams[:-1])
        at = at[np.concatenate([[True], at[1:] != at[:-1]])]
    else:
        windows = np.lib.stride_tricks.sliding_window_view(grams, w)
        at = np.unique(np.arange(len(windows)) + w - 1 - np.argmin(windows[:, ::-1], axis=1))
    return grams[at], at


class Sentence:
    """A sentence of an item, ready to be sought in token lists."""

    def __init__(self, tokens: list[str]):
        self.tokens, self.spare = tokens, len(tokens) // 10
        self.set = frozenset(tokens)
        self.masks: dict[str, int] = defaultdict(int)
        for i, token in enumerate(tokens):
            self.masks[token] |= 1 << i

    @property
    def least_shared(self) -> int:
        """How many fingerprints a text that holds the sentence shares with it at least.

        Of its n - K - W + 2 windows each changed token spoils K + W - 1 at
        most, and a fingerprint is the choice of W windows at most.
        """
        n = len(self.tokens)
        return max(1, -(-(n - K - W + 2 - (K + W - 1) * self.spare) // W))

    def distance(self, window: list[str]) -> int:
        """The least edit distance of the sentence and any span of the window, bit-parallel."""
        m, masks = len(self.tokens), self.masks
        full, top = (1 << m) - 1, 1 << (m - 1)
        pv, mv, score, best = full, 0, m, m
        for token in window:
            eq = masks.get(token, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | (full & ~(xh | pv))
            mh = pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
                if score < best:
                    best = score
            ph = (ph << 1) & full
            mh = (mh << 1) & full
            pv = mh | (full & ~(xv | ph))
            mv = ph & xv
        return best

    def held_at(self, tokens: list[str], starts: list[int]) -> bool:
        """Whether the token list holds the sentence near one of the places where a hit lets it start."""
        n, spare, done = len(self.tokens), self.spare, -1 << 60
        for start in sorted(starts):
            if start + n + spare <= done:
                continue
            window = tokens[max(0, start - spare) : start + n + 2 * spare + 1]
            if len(self.set.intersection(window)) < len(self.set) - spare:
                done = start + n  # the next start may lie better
                continue
            if self.distance(window) <= spare:
                return True
            done = start + n + 2 * spare + 1
        return False


#: The kinds of tokens, with the seed of their hashes.
WORDS, CHARACTERS = 0, 1


def fingerprints(tokens: list[str], kind: int, short: frozenset[int] = frozenset()) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (signed) and positions of a text's fingerprints; for sentences too short for winnowing, all grams of the lengths ``short`` beside."""
    hashes, at = winnow(tokens)
    parts, places = [hashes], [at]
    for n in sorted(short):
        more, where = winnow(tokens, n, 1)
        parts.append(more ^ np.uint64((n << 8) * 0x51ED2701))
        places.append(where)
    out = np.concatenate(parts) ^ np.uint64(kind * 0x2545F4914F6CDD1D)
    return out.view(np.int64), np.concatenate(places)


def sentence_fingerprints(tokens: list[str], kind: int) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprints of an item's sentence; one of fewer than K + W - 1 tokens has itself as its one."""
    n = len(tokens)
    if n >= K + W - 1:
        return fingerprints(tokens, kind)
    hashes, at = fingerprints(tokens, kind, frozenset({n}))
    return hashes[-1:], at[-1:]


def tokens_of(sentence: str) -> tuple[int, list[str]] | None:
    """Kind and tokens of an item's sentence; None without words. East Asian sentences go by characters."""
    p = plain(sentence)
    if not _WORD.search(p):
        return None
    kind = CHARACTERS if len(_CJK.findall(p)) * 4 >= len(p) else WORDS
    tokens = characters_of(p) if kind == CHARACTERS else words_of(p)
    return (kind, tokens) if tokens else None


def _sieve(prints: DataFrame) -> np.ndarray:
    """One bit for each value that the low bits of the items' fingerprints have: SIEVE_BITS / 64 numbers at most."""
    bits = prints.select(F.pmod(F.col("hash"), F.lit(SIEVE_BITS)).alias("bit"))
    words = bits.groupBy((F.col("bit") / 64).cast("int").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("set"))
    out = np.zeros(SIEVE_BITS // 64, np.int64)
    for row in words.collect():
        out[row.w] = row.set
    return out


def leaks(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(key, item_key)``: documents that hold a full sentence of an item, one word (East Asian: character) in ten apart.

    Null, empty and wordless texts and items match nothing; rows with null
    keys are left out; repeated rows count once. Sentences that stand in
    several items are sought once. Of the corpus, fingerprints that pass the
    items' sieve are shuffled, and the texts of documents with candidates.
    """
    spark = documents.sparkSession
    kinds = {"doc": documents.schema[key].dataType.simpleString(), "item": items.schema[item_key].dataType.simpleString()}
    corpus = documents.where(F.col(key).isNotNull() & (F.length(text) > 0)).select(F.col(key).alias("doc"), F.col(text).alias("body"))
    asked = items.where(F.col(item_key).isNotNull() & (F.length(item_text) > 0)).select(F.col(item_key).alias("item"), F.col(item_text).alias("body"))

    def cut_items(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for item, body in zip(batch["item"], batch["body"]):
                for sentence in item_sentences(body):
                    if found := tokens_of(sentence):
                        kind, tokens = found
                        joined = " ".join(tokens)
                        rows.append((item, hashlib.md5(f"{kind} {joined}".encode()).hexdigest(), kind, joined))
            yield pd.DataFrame(rows, columns=["item", "sid", "kind", "tokens"])

    owners = cut(spread(asked).mapInPandas(cut_items, f"item {kinds['item']}, sid string, kind int, tokens string"))
    sentences = cut(owners.groupBy("sid").agg(F.first("kind").alias("kind"), F.first("tokens").alias("tokens")))

    def print_items(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for sid, kind, joined in zip(batch["sid"], batch["kind"], batch["tokens"]):
                tokens = joined.split(" ")
                need = Sentence(tokens).least_shared
                rows += [(int(h), sid, int(q), need) for h, q in zip(*sentence_fingerprints(tokens, kind))]
            yield pd.DataFrame(rows, columns=["hash", "sid", "q", "need"])

    prints = cut(spread(sentences).mapInPandas(print_items, "hash bigint, sid string, q int, need int"))
    sieve = spark.sparkContext.broadcast(_sieve(prints))
    lengths = sentences.select("kind", F.size(F.split("tokens", " ")).alias("n")).where(F.col("n") < K + W - 1).distinct().collect()
    short = tuple(frozenset(r.n for r in lengths if r.kind == kind) for kind in (WORDS, CHARACTERS))
    present = frozenset(r.kind for r in sentences.select("kind").distinct().collect())

    def print_corpus(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.unpackbits(sieve.value.view(np.uint8), bitorder="little").view(bool)
        for batch in batches:
            owner, hashes, places = [], [], []
            for i, body in enumerate(batch["body"]):
                p = plain(body)
                for kind in present:
                    if kind == CHARACTERS and not _CJK.search(p):
                        continue
                    h, at = fingerprints(characters_of(p) if kind == CHARACTERS else words_of(p), kind, short[kind])
                    hit = np.flatnonzero(bits[h & (SIEVE_BITS - 1)])
                    if len(hit):
                        owner.append(np.full(len(hit), i))
                        hashes.append(h[hit])
                        places.append(at[hit])
            if owner:
                yield pd.DataFrame({"doc": batch["doc"].to_numpy()[np.concatenate(owner)], "hash": np.concatenate(hashes), "pos": np.concatenate(places)})

    met = cut(spread(corpus).mapInPandas(print_corpus, f"doc {kinds['doc']}, hash bigint, pos int"))
    hits = split_join(met, prints, "hash").groupBy("doc", "sid").agg(F.collect_set(F.col("pos") - F.col("q")).alias("starts"), F.size(F.collect_set("q")).alias("shared"), F.first("need").alias("need"))
    hits = cut(hits.where("shared >= need").select("doc", "sid", "starts"))
    # A document's candidates in rows of bounded size, with its text.
    parts = hits.groupBy("doc").agg(F.ceil(F.count("*") / CANDIDATES).cast("int").alias("parts"))
    several = hits.join(sentences, "sid").join(parts, "doc").groupBy("doc", F.pmod(F.xxhash64("sid"), F.col("parts")).alias("part")).agg(F.collect_list(F.struct("sid", "kind", "tokens", "starts")).alias("candidates"))
    rows = corpus.join(broadcast_if_small(cut(several), 8 << 20), "doc").select("doc", "body", "candidates")

    def extend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, Sentence] = {}
        for batch in batches:
            out = []
            for doc, body, candidates in zip(batch["doc"], batch["body"], batch["candidates"]):
                p, tokens = plain(body), {}
                for c in candidates:
                    kind = c["kind"]
                    if kind not in tokens:
                        tokens[kind] = characters_of(p) if kind == CHARACTERS else words_of(p)
                    if c["sid"] not in known:
                        if len(known) > 20_000:
                            known.clear()
                        known[c["sid"]] = Sentence(c["tokens"].split(" "))
                    if known[c["sid"]].held_at(tokens[kind], list(c["starts"])):
                        out.append((doc, c["sid"]))
            yield pd.DataFrame(out, columns=["doc", "sid"])

    held = spread(rows).mapInPandas(extend, f"doc {kinds['doc']}, sid string").distinct()
    return split_join(owners.select("sid", "item"), held, "sid").select(F.col("doc").alias(key), F.col("item").alias(item_key)).distinct()
