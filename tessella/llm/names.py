"""Variant spellings of names typed by people (problem 7).

Method: noisy-channel attribution. Frequent, complete spellings are candidate
canonical forms; a variant goes to the candidate of greatest posterior, which
is the candidate's frequency times the likelihood that typing it gave the
variant: typos, abbreviations, initials, nicknames, dropped and moved parts.
Candidates come from an equi-join on deletion neighbourhoods of the rare part
of a name, one or two letters deep, on its sorted tokens, and on each of its
tokens with the initial of another: any two forms that the likelihood links
share a key. Which of two unknown tokens is the given name is told by the other
spelling's initials, not by a list; the list only knows nicknames. One mistyped character in a Chinese name of
six or more, before the last two, links it if the canonical form is frequent
enough (``supported``).
"""

from __future__ import annotations

import functools
import itertools
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.skeleton import skeleton
from tessella.operators.components import components
from tessella.operators.packed import split_names
from tessella.plans.pairs import pairs_within, split_join
from tessella.plans.runtime import cut, spread

# Given names and their short forms.
NICKNAMES = {
    "alexander": "alex sasha sandy alec xander", "alexandra": "alex sasha sandra", "andrew": "andy drew", "anthony": "tony", "benjamin": "ben", "catherine": "kate kathy cathy katie", "charlotte": "lottie charlie lotte", "charles": "charlie chuck", "christopher": "chris", "daniel": "dan danny", "david": "dave", "edward": "ed ted eddie", "elizabeth": "liz beth betsy lizzie eliza betty", "francisco": "paco pancho cisco", "frederick": "fred freddie freddy", "giovanna": "gianna gia vanna", "giovanni": "gianni", "heinrich": "heinz heiner", "james": "jim jimmy jamie", "johannes": "hans johann", "john": "jack johnny", "joseph": "joe jo joey", "katherine": "kate kathy katie kat", "margaret": "maggie peggy meg", "matthew": "matt", "michael": "mike mick", "nicholas": "nick nicky", "patricia": "pat patty tricia trish", "patrick": "pat paddy", "peter": "pete", "rebecca": "becky", "richard": "dick rick rich", "robert": "bob rob bobby", "samuel": "sam", "stephen": "steve", "susanna": "sue susie susan", "theodore": "ted theo", "thomas": "tom tommy", "victoria": "vicky tori vicki", "william": "bill will billy liam",
}
# Words in names of organisations that don't tell one from another by themselves.
ORGANISATION_WORDS = frozenset(
    "university hospital institute oncology medical medicine research foundation life sciences science fund funds capital partners partner ventures venture therapeutics pharmaceuticals pharmaceutical pharma biosciences bioscience biotech biotechnology biologics healthcare health care investment investments management labs laboratories laboratory clinic center centre college school bank trust holdings holding international global asset advisors equity technologies technology systems genomics diagnostics".split()
)
# Words of a name that are often left out.
OPTIONAL_WORDS = frozenset("partners partner group holding holdings international global".split())
# Short forms that no rule gives.
SHORT_WORDS = {"tx": "therapeutics", "rx": "pharmaceuticals", "hcare": "healthcare", "intl": "international", "natl": "national", "bros": "brothers", "mgt": "management", "mgmt": "management", "inv": "investment", "hosp": "hospital", "inst": "institute", "dept": "department"}
# Legal forms, without dots; each row is one form.
LEGAL = {name: row.split()[0] for row in ("ltd limited coltd", "inc incorporated", "corp corporation", "llc", "lp", "llp", "gmbh mbh", "ag", "kg", "sa", "as a/s", "plc", "bv", "nv", "sas", "sarl", "srl", "spa", "ab", "oy", "co company", "kk", "pty") for name in row.split()}
# Words around a name.
AROUND = frozenset("the group of and for dr prof mr mrs ms sir jr sr von de".split())
# Chinese legal forms and notes, longest first.
CHINESE_FORMS = ("股份有限公司", "有限责任公司", "集团有限公司", "有限公司", "有限合伙", "集团", "公司")
_CJK = re.compile(r"[㐀-鿿]")
_WORDS = frozenset(NICKNAMES) | frozenset(x for v in NICKNAMES.values() for x in v.split()) | ORGANISATION_WORDS
_FULL = {nick: {full for full, v in NICKNAMES.items() if nick in v.split()} for nick in {x for v in NICKNAMES.values() for x in v.split()}}
#: Log likelihoods of what typing does to a name, and the least sum that still links.
TYPO, SHORTENED, INITIAL, NICKNAME, FUSED, MOVED, LEGAL_LOST, LEGAL_OTHER, WORD_LOST, EXTRA_INITIAL, STRANGE, LEAST = -3.5, -2.5, -2.0, -2.0, -2.0, -0.5, -0.5, -3.0, -2.0, -1.0, -20.0, -10.0
#: A variant is left alone unless one candidate has this share of the posterior.
LEAST_SHARE = 0.6
#: Stems with one key that one task compares with all others of the key.
KEY_BLOCK = 500
#: Rare parts of more letters are sought by halves: their pairs of letters would be too many.
LONG = 24


def plain_form(name: str) -> str:
    """A spelling without case, accents, quotes and points; Chinese names without legal form and with the place in front."""
    text = unicodedata.normalize("NFC", "".join(x for x in skeleton(name) if not unicodedata.combining(x))).casefold()
    if _CJK.search(text):
        text = re.sub(r"\s+", "", text)
        text = re.sub(rf"[(（](?:{'|'.join(CHINESE_FORMS)}|普通合伙|合伙)[)）]$", "", text)
        form = next((f for f in CHINESE_FORMS if text.endswith(f) and len(text) > len(f) + 2), "")
        text = text[: len(text) - len(form)]
        m = re.fullmatch(r"(.+?)[(（](.{2,4}?)市?[)）](.*)", text)
        if m:
            text = m.group(2) + m.group(1) + m.group(3)
        return re.sub(r"^(..)市(?=...)", r"\1", text)
    text = re.sub(r"[\"“”„()\[\]]", " ", text)
    text = re.sub(r"\ba/s\b", "as", text).replace("’", "'")
    text = re.sub(r"\b(?:\w\.){2,}\w?(?=\W|$)", lambda m: m.group().replace(".", "") + " ", text)
    text = re.sub(r"['`]", "", text)
    return " ".join(re.findall(r"\w+", text.replace(" co., ltd", " coltd").replace("health care", "healthcare")))


@functools.lru_cache(200_000)
def _edits(a: str, b: str, most: int) -> int:
    """Edit distance with neighbours' swaps, or most + 1."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, now[-1] + 1, one[j - 1] + (x != y))
            if two and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            now.append(d)
        if min(now) > most:
            return most + 1
        two, one = one, now
    return one[-1]


def _subsequence(short: str, long: str) -> bool:
    rest = iter(long)
    return all(x in rest for x in short)


@functools.lru_cache(200_000)
def _word(token: str) -> str | None:
    """The word of the lexicon that a token is, misspelled or shortened; None for the rare part of a name."""
    if token in _WORDS:
        return token
    if token in SHORT_WORDS:
        return SHORT_WORDS[token]
    if len(token) >= 5:
        for w in sorted(_WORDS):
            if len(w) >= 5 and w[0] == token[0] and _edits(token, w, 1) <= 1:
                return w
    if len(token) > 6:
        return next((w for w in sorted(ORGANISATION_WORDS) if w.startswith(token)), None)
    if len(token) >= 3:
        for w in sorted(ORGANISATION_WORDS):
            if w[0] == token[0] and len(w) > len(token) and (w.startswith(token) or (_subsequence(token, w) and not re.search(r"[aeiou]", token[1:-1]))):
                return w
            if token.endswith("s") and w.endswith("s") and w.startswith(token[:-1]) and len(token) > 3:
                return w
    return None


@functools.lru_cache(50_000)
def parse(form: str) -> tuple[tuple[str, ...], tuple[str, ...], tuple[str, ...], tuple[str, ...]]:
    """(rare tokens, words, initials, legal forms) of a plain form."""
    rare, words, initials, legal = [], [], [], []
    tokens = [t for t in form.split() if t not in AROUND] or form.split()
    for t in tokens:
        if t in LEGAL:
            legal.append(LEGAL[t])
        elif len(t) <= 2 and t.isalpha() and t not in SHORT_WORDS:
            initials += [t]
        elif _word(t):
            words.append(t)
        else:
            rare.append(t)
    organisation = [w for w in words if (_word(w) or "") in ORGANISATION_WORDS]
    if len(rare) == 1 and not organisation and legal:
        # "Surname K.G." is a person's initials, not a legal form.
        letters = [t for t in tokens if t in LEGAL and len(t) == 2]
        if letters and len(legal) == len(letters):
            initials += letters
            legal = []
    if not organisation:
        initials = [x for t in initials for x in t] if len(rare) <= 1 else initials
    if not rare and words:
        rare, words = words, []
    return tuple(rare), tuple(words), tuple(initials), tuple(legal)


def complete(form: str) -> int:
    """How well a form can stand for an entity: with words beside the rare part best, with two rare tokens better than with initials."""
    if _CJK.search(form):
        return len(form)
    rare, words, _, _ = parse(form)
    return 2 if words else int(len(rare) > 1)


def _of_organisation(words: tuple[str, ...]) -> bool:
    return any((_word(w) or "") in ORGANISATION_WORDS for w in words)


def _told_by_initials(rare: tuple[str, ...], words: tuple[str, ...], other: tuple[str, ...], initials: tuple[str, ...]) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Rare tokens and words of a name when the other spelling has initials for some of its rare tokens: those are given names, and count as words."""
    spare = len(rare) - len(other)
    if spare < 1 or not other or not initials:
        return rare, words
    ways = []
    for given in itertools.combinations(range(len(rare)), spare):
        if not Counter(rare[i][0] for i in given) - Counter(x[0] for x in initials):
            rest = tuple(t for i, t in enumerate(rare) if i not in given)
            ways.append((_edits("".join(rest), "".join(other), 2), rest, tuple(rare[i] for i in given)))
    return (min(ways)[1], words + min(ways)[2]) if ways else (rare, words)


def _token_cost(v: str, c: str) -> float:
    """How likely a token gave another one: 0 for itself."""
    if v == c:
        return 0.0
    if SHORT_WORDS.get(v) == c or SHORT_WORDS.get(c) == v:
        return SHORTENED
    if c in _FULL.get(v, ()) or v in _FULL.get(c, ()) or (_FULL.get(v) and _FULL.get(c) and _FULL[v] & _FULL[c]):
        return NICKNAME
    most = 1 if min(len(v), len(c)) < 9 else 2
    if min(len(v), len(c)) >= 4 and (e := _edits(v, c, most)) <= most:
        return TYPO * e
    short, long = sorted((v, c), key=len)
    if len(long) > len(short) and long[0] == short[0]:
        if len(short) == 1:
            return INITIAL
        if long.startswith(short) or (len(short) >= 2 and _subsequence(short, long) and len(short) <= 7 and _word(long)):
            return SHORTENED
    return STRANGE


def likelihood(variant: str, canonical: str) -> float:
    """Log likelihood that typing the canonical form gave the variant (both plain)."""
    if _CJK.search(variant) or _CJK.search(canonical):
        if variant == canonical:
            return 0.0
        if canonical[2:] == variant and len(variant) >= 4:
            return WORD_LOST
        both = _CJK.search(variant) and _CJK.search(canonical)
        one = len(variant) == len(canonical) and sum(a != b for a, b in zip(variant, canonical)) == 1
        return TYPO if both and one and len(variant) >= 6 and variant[-2:] == canonical[-2:] else STRANGE
    vr, vw, vi, vl = parse(variant)
    cr, cw, ci, cl = parse(canonical)
    if not vr or not cr:
        return STRANGE  # initials and legal forms alone tell nobody
    if any(len(t) > 1 for t in ci) and not any(len(t) > 1 for t in vi):
        return likelihood(canonical, variant)  # an acronym on the other side: the same channel backwards
    if not _of_organisation(vw) and not _of_organisation(cw):
        cr, cw = _told_by_initials(cr, cw, vr, vi)
        vr, vw = _told_by_initials(vr, vw, cr, ci)
    total = 0.0
    # The rare part, as one string: typos, fused and hyphenated parts.
    a, b = "".join(vr), "".join(cr)
    if a != b:
        most = 1 if len(b) < 9 else 2
        e = _edits(a, b, most)
        if e > most:
            if sorted(vr) != sorted(cr):
                return STRANGE
            total += MOVED
        else:
            total += TYPO * e
    if len(vr) != len(cr):
        total += FUSED
    # Words and given names, each to its best counterpart.
    left = list(cw) + list(ci)
    missing_v = []
    for t in vw:
        best = max(left, key=lambda c: _token_cost(t, c), default=None)
        if best is not None and _token_cost(t, best) > STRANGE:
            total += _token_cost(t, best)
            left.remove(best)
        else:
            missing_v.append(t)
    for t in vi:
        if len(t) > 1:
            runs = [cw[i : i + len(t)] for i in range(len(cw) - len(t) + 1)]
            run = next((r for r in runs if "".join(w[0] for w in r) == t and all(w in left for w in r)), None)
            if run:
                total += SHORTENED
                for w in run:
                    left.remove(w)
                continue
        best = max(left, key=lambda c: _token_cost(t, c), default=None)
        if best is not None and _token_cost(t, best) > STRANGE:
            total += _token_cost(t, best)
            left.remove(best)
        elif len(t) == 1:
            total += EXTRA_INITIAL
            missing_v.append(t)
        else:
            missing_v.append(t)
    lost = [x for x in left if len(x) > 1]
    if missing_v and (lost or (left and len(missing_v) == len(vw) + len(vi))):
        return STRANGE  # each has what the other lacks: different entities
    if any(len(t) > 1 for t in missing_v):
        # A given name twice ("Katherine "Kate" X") says nothing new.
        if not all(any(_token_cost(t, w) > STRANGE for w in cw) for t in missing_v if len(t) > 1):
            return STRANGE
        total += NICKNAME
    if lost and len(lost) < len(cw) and {_word(x) for x in lost} & ORGANISATION_WORDS:
        # Some of the words gone, the legal form kept: a "University" is not the "University Hospital".
        if vl and not {_word(x) for x in lost} <= OPTIONAL_WORDS:
            return STRANGE
        total += WORD_LOST
    total += WORD_LOST * min(1, len(lost))
    if set(vl) != set(cl):
        total += LEGAL_OTHER if vl and cl and not set(vl) & set(cl) else LEGAL_LOST
    return total


def supported(variant: str, canonical: str, score: float, n_variant: int, n_canonical: int) -> bool:
    """Whether the counts support a link: one mistyped Chinese character makes another real name
    so often that the canonical form, mistyped, must be likelier than the variant as a name of its own."""
    if not (_CJK.search(variant) and _CJK.search(canonical) and score == TYPO):
        return True
    return score + math.log(n_canonical) >= math.log(n_variant)


def stems(form: str) -> set[str]:
    """What a form is sought by: its rare part as written, with typos, its rare tokens in order of the alphabet, as they are, and for a name of no organisation what is left of it when one or more tokens shrink to their initials."""
    if _CJK.search(form):
        return {form}
    rare, words, initials, _ = parse(form)
    out = {"".join(rare) or form} | ({"~" + "".join(sorted(rare))} if len(rare) > 1 else set())
    if not _of_organisation(words):
        out |= {f"{t}@{x[0]}" for t in rare for x in initials} if len(rare) == 1 else {f"{t}@{x[0]}" for i, t in enumerate(rare) for x in (*rare[:i], *rare[i + 1 :])}
        if len(rare) > 2 or (len(rare) > 1 and initials):
            # Of three tokens one may shrink, too: what is left, written together.
            out |= {f"{''.join(rare[:i] + rare[i + 1 :])}@{t[0]}" for i, t in enumerate(rare)} | {f"{''.join(rare)}@{x[0]}" for x in initials}
    return out


def _deleted(text: str, most: int) -> set[str]:
    """A text and what is left of it without up to ``most`` letters."""
    found = {text}
    for _ in range(most):
        found |= {x[:i] + x[i + 1 :] for x in found for i in range(len(x))}
    return found


def stem_keys(stem: str) -> set[int]:
    """Hashes of which two stems share one if they are as many typos apart as the likelihood accepts.

    One from the first letter on, two from 9 letters on, one of which may be 7 long on
    the other side. Of two stems beyond LONG letters, the first or the second halves
    are at most one typo apart, and start or end 2 letters apart at most.
    """
    n = len(stem)
    if _CJK.search(stem):
        parts = {stem, stem[2:]} if n >= 6 else {stem}
        if n >= 6:
            parts |= {stem[:i] + "_" + stem[i + 1 :] for i in range(n - 2)}
    elif stem.startswith("~"):
        parts = {stem}
    elif "@" in stem:
        rest, mark, initial = stem.rpartition("@")
        parts = {x + mark + initial for x in (_deleted(rest, 1 if len(rest) < 7 else 2) if len(rest) <= LONG else {rest})}
    else:
        parts = _deleted(stem, 1 if n < 7 else 2) if n <= LONG + 2 else {stem}
        if n > LONG:
            for m in range(n // 2 - 2, n // 2 + 3):
                parts |= {"<" + x for x in _deleted(stem[:m], 1)} | {">" + x for x in _deleted(stem[n - m - n % 2 :], 1)}
    return {xxhash.xxh64_intdigest(x) - (1 << 63) for x in parts}


def block_keys(form: str) -> set[int]:
    """The keys of all stems of a form: any two forms that the likelihood links share one."""
    return {k for s in stems(form) for k in stem_keys(s)}


def _alike(a: str, b: str) -> bool:
    """Whether two stems that share a key can be one: beyond their typos, only Chinese names are left to the likelihood."""
    if _CJK.search(a) or _CJK.search(b):
        return True
    most = 1 if max(len(a), len(b)) < 9 else 2
    return _edits(a, b, most) <= most


def spellings(news: DataFrame, requests: DataFrame) -> DataFrame:
    """``(spelling, n)`` of all names in both columns, without outer blanks; null, empty and placeholder values are none."""
    typed = requests.select(F.explode("classification_input").alias("name")).select(F.regexp_replace("name", r"^[\s 　]+|[\s 　]+$", "").alias("spelling")).where("spelling <> ''")
    written = split_names(news, "news_id", "invester").select(F.col("val").alias("spelling"))
    return typed.unionByName(written).groupBy("spelling").agg(F.count("*").alias("n"))


def attribute(names: DataFrame) -> DataFrame:
    """``(spelling, entity)`` of distinct spellings with counts ``n``: the entity is one of its plain forms.

    A form goes to one that is more complete, or as complete and more frequent,
    so that no circle arises. Spellings of one plain form share their entity.
    Names unlike all others are entities of their own.
    """

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"spelling": batch["spelling"], "n": batch["n"], "form": [plain_form(x) or x for x in batch["spelling"]]})

    formed = cut(spread(names).mapInPandas(reduce, "spelling string, n bigint, form string"))
    forms = formed.groupBy("form").agg(F.sum("n").alias("n"))

    def seek(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(f, n, complete(f), s) for f, n in zip(batch["form"], batch["n"]) for s in stems(f)], columns=["form", "n", "rank", "stem"])

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(s, k) for s in batch["stem"] for k in stem_keys(s)], columns=["stem", "key"])

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[[_alike(a, b) for a, b in zip(batch["sv"], batch["sc"])]]

    sought = cut(spread(forms).mapInPandas(seek, "form string, n bigint, rank int, stem string"))
    stem = sought.select("stem").distinct()
    keyed = cut(spread(stem).mapInPandas(keys, "stem string, key bigint"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("stems")).where("stems > 1").select("key")
    keyed = cut(keyed.join(shared, "key"))
    met = split_join(keyed.withColumnRenamed("stem", "sv"), keyed.withColumnRenamed("stem", "sc"), "key", block=KEY_BLOCK).where("sv < sc").select("sv", "sc").distinct()
    met = cut(spread(met).mapInPandas(near, "sv string, sc string"))
    met = met.unionByName(met.select(F.col("sc").alias("sv"), F.col("sv").alias("sc"))).unionByName(stem.select(F.col("stem").alias("sv"), F.col("stem").alias("sc")))
    variants = sought.select(F.col("stem").alias("sv"), F.col("form").alias("v"), F.col("n").alias("nv"), F.struct("rank", "n", "form").alias("rv"))
    canonicals = sought.select(F.col("stem").alias("sc"), F.col("form").alias("c"), F.col("n").alias("nc"), F.struct("rank", "n", "form").alias("rc"))
    pairs = spread(split_join(split_join(variants, met, "sv"), canonicals, "sc").where("rc > rv").select("v", "nv", "c", "nc").distinct())

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            score = [likelihood(v, c) for v, c in zip(batch["v"], batch["c"])]
            out = batch.assign(score=score)
            out = out[[s >= LEAST and supported(v, c, s, nv, nc) for v, c, s, nv, nc in zip(out["v"], out["c"], score, out["nv"], out["nc"])]]
            yield out.assign(score=[s + math.log(n) for s, n in zip(out["score"], out["nc"])])[["v", "c", "score"]]

    weighed = cut(pairs.mapInPandas(weigh, "v string, c string, score double"))
    # Candidates that are one another's variants count as one when a variant's posterior is shared out.
    best = weighed.groupBy("v").agg(F.max_by("c", F.struct("score", "c")).alias("c"), F.max("score").alias("score"))
    rivals = weighed.alias("w").join(best.withColumnRenamed("c", "top").withColumnRenamed("score", "s"), "v").where("c <> top")
    kin = weighed.select(F.col("v").alias("x"), F.col("c").alias("y"))
    kin = kin.unionByName(kin.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct().withColumn("kin", F.lit(True))
    others = rivals.join(kin, (F.col("x") == F.col("c")) & (F.col("y") == F.col("top")), "left").where("kin is null").groupBy("v").agg(F.sum(F.exp(F.col("w.score") - F.col("s"))).alias("others"))
    links = best.join(others, "v", "left").where(1 / (1 + F.coalesce("others", F.lit(0.0))) >= LEAST_SHARE).select(F.col("v").alias("a"), F.col("c").alias("b"))
    entity = components(links)
    return formed.join(entity.select(F.col("vertex").alias("form"), "component"), "form", "left").select("spelling", F.coalesce("component", "form").alias("entity"))


def linked_names(news: DataFrame, requests: DataFrame) -> DataFrame:
    """``(name_a, name_b)``: pairs of different spellings of one entity, smaller first by code point."""
    return pairs_within(attribute(spellings(news, requests)), "entity", "spelling", "name_a", "name_b")
