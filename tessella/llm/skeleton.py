"""Texts that look the same: one consistent form by a look-alike skeleton (problem 10).

Method: decompose (NFD), replace every character by the prototype of its
look-alike class, decompose again; texts with equal skeletons look the same.
Differences that a reader sees (case, accents, digits, raised figures, the
number of blanks) survive, so only forms of *equal shape* share a prototype.
"""

from __future__ import annotations

import functools
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from tessella.plans.pairs import split_join
from tessella.plans.runtime import cut, spread

# Letters of other scripts with the shape of a Latin letter.
LOOK_ALIKES = {
    # Cyrillic small and capital letters
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ո": "n",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Ӏ": "I",
    # Greek capitals and the few small letters of Latin shape
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j", "Ϲ": "C", "Ϳ": "J",
    # letters and signs of Latin shape
    "ı": "i", "ɑ": "a", "ɡ": "g", "ꞌ": "'", "ǃ": "!", "ℓ": "l", "µ": "μ", "…": "...", "∶": ":", "։": ":", "˸": ":", "⁄": "/", "∕": "/", "∖": "\\", "‚": ",", "‐": "-", "‑": "-", "﹘": "–", "˗": "-", "−": "–", "∙": "·", "⋅": "·", "・": "·", "•": "·", "ʹ": "'", "∗": "*", "∣": "|", "ǀ": "|", "〇": "○", "ß": "ß",
}

#: (first, last) of blocks whose compatibility form has the very same shape or differs in width only.
SAME_SHAPE_BLOCKS = ((0x2E80, 0x2FDF), (0x2160, 0x217F), (0xFB00, 0xFB06), (0xFF61, 0xFFDC), (0xFFE8, 0xFFEE), (0x3392, 0x33DF), (0x01C4, 0x01CC), (0x01F1, 0x01F3), (0x0132, 0x0133), (0xFE30, 0xFE4F), (0xFE50, 0xFE6B))

#: Characters that leave no mark, besides the category of format characters.
INVISIBLE = [0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)]


class _Prototypes(dict):
    """A character without a prototype stands for itself; remembered, as a lookup that fails costs most of the time."""

    def __missing__(self, point: int) -> str:
        self[point] = same = chr(point)
        return same


@functools.lru_cache(1)
def prototypes() -> dict[int, str]:
    """The look-alike table, by code point: built from rules, then the fixed values."""
    table: dict[int, str] = {}
    for cp in [*range(0x20), *range(0x7F, 0xA0)]:
        if chr(cp) not in "\t\n\r\x0b\x0c\x85":
            table[cp] = ""
    for cp in range(0xA0, 0x30000):
        kind = unicodedata.category(chr(cp))
        if kind == "Zs":
            table[cp] = " "
        elif kind == "Cf" and not 0x0600 <= cp <= 0x06DD:
            table[cp] = ""
    table[ord("\t")] = " "
    for cp in (0x0B, 0x0C, 0x85, 0x2028, 0x2029, 0x0D):
        table[cp] = "\n"
    for cp in range(0xFF01, 0xFF5F):
        table[cp] = chr(cp - 0xFEE0)
    for cp in range(0xFFE0, 0xFFE7):
        table[cp] = unicodedata.normalize("NFKC", chr(cp))
    for first, last in SAME_SHAPE_BLOCKS:
        for cp in range(first, last + 1):
            form = unicodedata.normalize("NFKC", chr(cp))
            if form != chr(cp) and not form.startswith(" "):
                table[cp] = form
    for cp in [*INVISIBLE, *range(0xE0000, 0xE0080)]:
        table[cp] = ""
    for char, form in LOOK_ALIKES.items():
        table[ord(char)] = form
    return _Prototypes({cp: "".join(LOOK_ALIKES.get(x, x) for x in form) for cp, form in table.items() if form != chr(cp)})


_PLAIN_CONTROLS = "".join(map(chr, [*range(10), *range(11, 32), 127]))
_PLAIN = str.maketrans("", "", _PLAIN_CONTROLS)


def skeleton(text: str | None) -> str | None:
    """The skeleton of a text; null stays null, the empty text stays empty.

    Two texts look the same if and only if their skeletons are equal.
    """
    if not text:
        return text
    if text.isascii() and text.translate(_PLAIN) == text:
        return text
    if "\r" in text:
        text = text.replace("\r\n", "\n")
    out = unicodedata.normalize("NFD", text).translate(prototypes())
    return unicodedata.normalize("NFD", out)


@pandas_udf(StringType())
def _skeletons(texts: pd.Series) -> pd.Series:
    return pd.Series([skeleton(x) for x in texts], dtype=object)


def skeleton_column(text: Column | str) -> Column:
    """The skeleton of a string column."""
    return _skeletons(F.col(text) if isinstance(text, str) else text)


def canonical_text(documents: DataFrame, text: str = "text", into: str = "canonical") -> DataFrame:
    """``documents`` with the consistent form of ``text`` (composed skeleton) in ``into``; null stays null."""

    @pandas_udf("string")
    def composed(texts: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else unicodedata.normalize("NFC", skeleton(x)) for x in texts], dtype=object)

    return documents.withColumn(into, composed(F.col(text)))


#: Rows of one look-alike group that one task of the pair join takes on its left side.
GROUP_BLOCK = 2000


def look_alike_pairs(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pairs ``(doc_a, doc_b)``, smaller key first, of documents that look the same though their texts differ.

    Exact copies are no pair of each other. Null texts pair with nothing; an
    empty text pairs with texts of invisible characters only. Repeated keys
    count once. Texts are read once, and go on as two hashes in a written
    table. Groups without two different texts are dropped after a map-side
    aggregation; a hot group's left side is dealt over several tasks.
    """
    rows = cut(spread(documents.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(key, text)).select(F.col(key).alias("k"), F.md5(skeleton_column(text)).alias("s"), F.md5(F.col(text)).alias("t")).distinct())
    mixed = rows.groupBy("s").agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("s", F.ceil(F.col("n") / GROUP_BLOCK).cast("int").alias("blocks"))
    kept = rows.join(mixed, "s")
    left = kept.select("s", F.col("k").alias("a"), F.col("t").alias("ta"), F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int").alias("block"))
    right = kept.select("s", F.col("k").alias("b"), F.col("t").alias("tb"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    pairs = left.join(right, ["s", "block"]).where("a < b and ta <> tb")
    return pairs.select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b")).distinct()


def look_alike_classes(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, class_id, texts, members)`` of each document that looks like another one: the least key of its class, the class's different texts and its documents.

    The membership beside ``look_alike_pairs``: its size is that of the
    corpus, however large a class is. Exact copies are members too; classes
    of one text only are left out, null texts and null keys belong to none.
    """
    rows = cut(spread(documents.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(key, text)).select(F.col(key).alias("k"), F.md5(skeleton_column(text)).alias("s"), F.md5(F.col(text)).alias("t")).distinct())
    texts = rows.groupBy("s", "t").agg(F.count_distinct("k").alias("n"), F.min("k").alias("lo")).groupBy("s").agg(F.count("*").alias("texts"), F.sum("n").alias("members"), F.min("lo").alias("class_id")).where("texts > 1")
    return split_join(rows.select("k", "s").distinct(), texts, "s").select(F.col("k").alias(key), "class_id", "texts", "members")
