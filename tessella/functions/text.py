"""Cleaning, sentences, chunks: text functions as Column expressions.

Null stays null. Where the order of rewriting matters beyond what expressions
say, the function is an Arrow UDF and says so.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from tessella.plans.runtime import let

# Blanks that Python's split knows and Java's \s doesn't.
BLANKS = r"[\s\u00a0\u1680\u180e\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\x1c-\x1f\x85]"
# Characters that are taken out, not replaced by a blank.
INVISIBLE = "\u200b\u200c\u200d\u2060\ufeff\u00ad\u200e\u200f"
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "\u3000"
_HALF = "".join(chr(c) for c in range(0x21, 0x7F)) + " "


def remove_controls(text: Column) -> Column:
    """Without control characters other than tab, line feed and carriage return."""
    return F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f]|ï|¿", "")


def unescape(text: Column) -> Column:
    """The common named and the decimal HTML entities as characters; ``&amp;`` last, so that nothing is unescaped twice."""
    out = text
    for name, char in (("nbsp", "\u00a0"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("#39", "'"), ("ldquo", "“"), ("rdquo", "”"), ("mdash", "—"), ("hellip", "…"), ("amp", "&")):
        out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    return out


def strip_tags(html: Column) -> Column:
    """The text of markup: scripts, styles and comments dropped with their content, tags dropped, entities unescaped, line ends removed."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</(script|style)\s*>", "")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", "")
    return F.regexp_replace(unescape(F.regexp_replace(out, r"<[^>]*>", "")), r"[\r\n]+", "")


def strip_tags_simple(text: Column) -> Column:
    """Tags out, runs of blanks to one blank."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"<[^<]+?>", ""), r"\s+", " "))


def collapse(text: Column) -> Column:
    """Runs of blanks of any kind to one, none at the ends."""
    return F.trim(F.regexp_replace(text, BLANKS + "+", " "))


def clean_text(text: Column) -> Column:
    """Full cleaning: controls, entities; invisible characters, tabs and line feeds are deleted (not spaced); blanks collapsed."""
    return collapse(F.translate(unescape(remove_controls(text)), INVISIBLE + "\n\t", ""))


def clean_spaces_cjk(text: Column) -> Column:
    """Blanks removed after East Asian characters and signs and on either side of digits, line feeds removed; other single blanks stay."""
    out = F.regexp_replace(text, r"(?<=[一-龥。.,，:：《》、()（）]) +(?![a-zA-Z])", "")
    out = F.regexp_replace(out, r"(?<=\d) +| +(?=\d)", "")
    out = F.regexp_replace(out, r" +(?=[一-龥])", "")
    return F.trim(F.translate(F.regexp_replace(out, r" {2,}", " "), "\n", ""))


def full_to_half(text: Column) -> Column:
    """Full-width letters, digits, signs and blanks in half width."""
    return F.translate(text, _WIDE, _HALF)


def half_digits(text: Column) -> Column:
    """Full-width digits in ASCII."""
    return F.translate(text, "０１２３４５６７８９", "0123456789")


def remove_punctuation(text: Column) -> Column:
    """Without blanks, ASCII and East Asian punctuation."""
    return F.regexp_replace(text, r"[\p{P}\p{S}\s\u3000]+", "")


def replace_all(text: Column, table: Mapping[str, str]) -> Column:
    """All keys of a table replaced at once: what was put in isn't looked at again. By an Arrow UDF; longer keys first."""
    pattern = re.compile("|".join(map(re.escape, sorted(table, key=len, reverse=True))))

    @pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: x if x is None else pattern.sub(lambda m: table[m.group()], x))

    return run(text)


def tidy_label(text: Column) -> Column:
    """A label's text: repeated signs to one, bullets and trailing page marks out."""
    out = F.regexp_replace(text, r"([.\-_=*~])\1{2,}", "$1")
    out = F.regexp_replace(out, r"(?m)^\s*[•●▪■◦·]\s*", "")
    return F.trim(F.regexp_replace(out, r"(?m)\s*(Page \d+ of \d+|- ?\d+ ?-)\s*$", ""))


def trim_field(text: Column) -> Column:
    """A field's text without leading colons, closing brackets and blanks, nor hyphens at either end."""
    return F.regexp_replace(F.regexp_replace(text, r"^[\s:：)）]+", ""), r"^[-\s]+|[-\s]+$", "")


def is_chinese(text: Column) -> Column:
    """Whether all characters are Chinese; true for the empty text."""
    return F.regexp_like(text, F.lit("^[一-龥]*$"))


def ends_sentence(text: Column) -> Column:
    """Whether the last character ends a sentence."""
    return F.regexp_like(text, F.lit(r"[.!?。！？…]$"))


def blanks_to_space(text: Column) -> Column:
    """No-break blanks, tabs and line feeds as blanks, one for one."""
    return F.translate(text, "\u00a0\t\n", "   ")


def plain_name(text: Column) -> Column:
    """A name for matching: lower case without hyphens and blanks."""
    return F.lower(F.translate(text, "- ", ""))


def signs_to_space(text: Column) -> Column:
    """Brackets, dashes, commas and blanks as one blank."""
    return F.regexp_replace(text, r"[()\-–,\s]+", " ")


def before_marker(text: Column, markers: Sequence[str]) -> Column:
    """The text before the marker listed first among those it holds; whole if it holds none."""
    out = text
    for m in reversed(list(markers)):
        out = F.when(F.contains(text, F.lit(m)), F.substring_index(text, m, 1)).otherwise(out)
    return out


def map_codes(text: Column, table: Mapping[str, str], delimiter: str = ",") -> Column:
    """A delimited list of labels by a table; what the table lacks falls out."""
    lookup = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.array_compact(F.transform(F.split(text, re.escape(delimiter)), lambda x: F.try_element_at(lookup, F.trim(x))))


def canonical_label(text: Column, labels: Sequence[str]) -> Column:
    """The label (greatest as a string, as the reference chooses) that the text without blanks, in capitals, holds."""
    plain = F.upper(F.regexp_replace(text, r"\s", ""))
    return F.array_max(F.filter(F.array(*map(F.lit, labels)), lambda x: F.contains(plain, F.upper(x))))


def english_date(day: Column) -> Column:
    """A date as ``June, 5th, 2020``."""
    d = F.day(day)
    suffix = F.when(d.between(11, 13), "th").when(d % 10 == 1, "st").when(d % 10 == 2, "nd").when(d % 10 == 3, "rd").otherwise("th")
    return F.concat(F.date_format(day, "MMMM"), F.lit(", "), d.cast("string"), suffix, F.lit(", "), F.year(day).cast("string"))


def area_of(name: Column, areas: Sequence[str]) -> Column:
    """The first listed area in a name, ``<area>大学`` not counting."""
    out = F.lit(None).cast("string")
    for a in reversed(list(areas)):
        out = F.when(F.contains(F.replace(name, F.lit(a + "大学"), F.lit("")), F.lit(a)), F.lit(a)).otherwise(out)
    return out


# ------------------------------------------------------------------ sentences and tokens


#: A sentence within a line: up to end marks or an ellipsis with the quotes that close there, unless a comma or another mark goes on behind those; or the rest of the line.
_SENTENCE_ZH = r"[^\n]+?(?:(?:[。！？?!]|\.{6}|…)+(?:[”’」』]+(?![，。！？?!…]))?(?![”’」』。！？?!…])|(?=\n)|$)"


def sentences_zh(text: Column) -> Column:
    """Sentences by Chinese end marks (closing quotes stay with them), ellipses and line feeds; trimmed, none empty.

    Marks that follow each other end one sentence together.
    """
    found = F.regexp_extract_all(text, F.lit(_SENTENCE_ZH), F.lit(0))
    return F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: x != "")


def chunks_of(values: Column, size: int) -> Column:
    """An array cut into arrays of ``size`` members, the last one shorter; none for an empty array, null for null."""
    return F.transform(F.when(F.size(values) > 0, F.sequence(F.lit(1), F.size(values), F.lit(size))).when(values.isNotNull(), F.array().cast("array<int>")), lambda i: F.slice(values, i, F.lit(size)))


def sentences_naive(text: Column) -> Column:
    """Sentences with their end marks; text after the last mark is dropped."""
    return F.regexp_extract_all(text, F.lit(r"([^。！!.？?]*[。！!.？?])"), F.lit(1))


def sentences_en(text: Column) -> Column:
    """English sentences: an end mark, blanks, then a capital, a digit or a quote."""
    marked = F.regexp_replace(text, r"([.!?][\"')\]]*)\s+(?=[A-Z0-9\"'(])", "$1\n")
    return F.filter(F.transform(F.split(marked, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def filter_sentences(sentences: Column, least: int = 10, unwanted: str = r"(?i)^\s*(advert|figure|table|图|表|广告)") -> Column:
    """Sentences of a least length without asterisks, those on figures and advertising dropped."""
    plain = F.transform(sentences, lambda x: F.trim(F.replace(x, F.lit("*"), F.lit(""))))
    return F.filter(plain, lambda x: (F.length(x) >= least) & ~F.regexp_like(x, F.lit(unwanted)))


_HYBRID = re.compile(r"[一-龥、，/]|[^\s一-龥、，/]+")
_ANTI = re.compile(r"^(anti[-–])(.+)$", re.IGNORECASE)


def hybrid_tokens(text: str | None) -> list[str] | None:
    """Tokens of mixed Chinese and Latin text.

    East Asian characters and ``、，/`` stand alone, the rest is cut at blanks;
    bracketed parts and signs at either end are split off, as is a prefix
    ``anti-`` before something. Null gives null.
    """
    if text is None:
        return None
    out: list[str] = []
    for piece in _HYBRID.findall(text):
        parts = [p for p in re.split(r"([()（）])", piece) if p] if re.search(r"\(.*\)|（.*）", piece) else [piece]
        for p in parts:
            tail = []
            if len(p) > 1 and not p[0].isalnum():
                out.append(p[0])
                p = p[1:]
            while len(p) > 1 and not p[-1].isalnum() and len(tail) < 2:
                tail.insert(0, p[-1])
                p = p[:-1]
            m = _ANTI.match(p)
            out += [m.group(1), m.group(2)] if m else [p]
            out += tail
    return out


def hybrid_tokens_column(text: Column) -> Column:
    """``hybrid_tokens`` as an Arrow UDF."""
    return pandas_udf(lambda s: s.map(hybrid_tokens), ArrayType(StringType()))(text)


def token_offsets_column(text: Column) -> Column:
    """Hybrid tokens with inclusive start and end offsets, as an Arrow UDF."""
    kind = ArrayType(StructType([StructField("token", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())]))

    def run(x: str | None) -> list | None:
        if x is None:
            return None
        at, out = 0, []
        for t in hybrid_tokens(x):
            at = x.index(t, at)
            out.append({"token": t, "start": at, "end": at + len(t) - 1})
            at += len(t)
        return out

    return pandas_udf(lambda s: s.map(run), kind)(text)


# ------------------------------------------------------------------ chunks


def windows(text: Column, size: int = 400, overlap: int = 200) -> Column:
    """Overlapping windows of characters as an array.

    The step is size - overlap (size if that is less than 1); empty windows are
    dropped, and the last of several if it is shorter than the overlap.
    """
    step = size - overlap if size - overlap >= 1 else size
    parts = F.transform(F.sequence(F.lit(0), (F.length(text) / step).cast("int")), lambda i: F.substring(text, (i * step + 1).cast("int"), F.lit(size)))
    full = F.filter(parts, lambda x: x != "")
    return F.when((F.size(full) > 1) & (F.length(F.element_at(full, -1)) < overlap), F.slice(full, F.lit(1), F.size(full) - 1)).otherwise(full)


def token_windows(tokens: Column, size: int, share: float = 0.8) -> Column:
    """Windows of ``size`` tokens, one every ``share`` of it."""
    step = max(1, int(size * share))
    return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(tokens) - 1), F.lit(step)), lambda i: F.slice(tokens, i + 1, F.lit(size)))


def fraction_windows(text: Column, size: int, overlap: float = 0.1) -> Column:
    """Windows i of ``size`` characters that begin ``overlap`` of a window early: [int((i - overlap) * n), (i + 1) * n)."""
    count = F.ceil(F.length(text) / size).cast("int")
    begin = lambda i: F.greatest(F.lit(0), ((i - overlap) * size).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), count - 1)), lambda i: F.substring(text, begin(i) + 1, F.least(F.length(text), (i + 1) * size) - begin(i)))


def chunk_rows(df: DataFrame, text: str, size: int = 400, overlap: int = 200, into: str = "chunk") -> DataFrame:
    """One row per window of a text, its number in ``pos``; other columns stay. Null and empty texts give no row."""
    others = [c for c in df.columns if c != text]
    return df.where(F.length(text) > 0).select(*others, F.posexplode(windows(F.col(text), size, overlap)).alias("pos", into))


def entities_inside(chunk: Column, entities: Column) -> Column:
    """The entities that occur in a chunk."""
    return F.filter(entities, lambda e: F.contains(chunk, e))


def merge_windows(outputs: Column, separator: str = "|", nothing: str = "") -> Column:
    """Outputs of windows as one: split, those inside a different one and the word for nothing dropped; that word if none is left."""
    parts = F.array_distinct(F.flatten(F.transform(outputs, lambda x: F.split(x, re.escape(separator)))))
    kept = let(parts, lambda p: F.filter(p, lambda x: (x != nothing) & (x != "") & ~F.exists(p, lambda y: (y != x) & F.contains(y, x))))
    return F.when(F.size(kept) == 0, F.lit(nothing)).otherwise(F.array_join(kept, separator))


def paragraphs(html: Column) -> Column:
    """Paragraphs of markup: cut at block ends, breaks and blank lines; trimmed, none empty."""
    out = F.regexp_replace(html, r"(?i)</p\s*>|<br\s*/?>|</div\s*>|</h[1-6]\s*>|\n\s*\n", "\u0001")
    plain = F.transform(F.split(out, "\u0001"), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"<[^>]*>", ""), r"[\r\n]+", "")))
    return F.filter(plain, lambda x: x != "")


def titled(title: Column, body: Column, day: Column | None = None) -> Column:
    """Title and text as one; with a day, a sentence on it before."""
    parts = [F.concat(F.lit("Published on "), F.date_format(day, "yyyy-MM-dd"), F.lit("."))] if day is not None else []
    return F.concat_ws(" ", *parts, title, body)


def length_gate(text: Column, longer: Column, least: int = 50, otherwise: object = 0) -> Column:
    """``longer`` for texts over a length, else a default."""
    return F.when(F.length(text) > least, longer).otherwise(F.lit(otherwise))


def abstract_or_title(abstract: Column, title: Column) -> Column:
    """The abstract, or the title if there is none."""
    return F.when(abstract.isNull() | F.trim(abstract).isin("", "No abstract available", "No abstract available."), title).otherwise(clean_text(abstract))


# ------------------------------------------------------------------ running lines of plain texts


def drop_page_marks(df: DataFrame, key: str, text: str, mark: str = r"^\s*-\s*\d+\s*-\s*$") -> DataFrame:
    """``(key, text)`` without page footers (lines like ``- 3 -``) and headers (a line after a footer that comes after several)."""
    lines = df.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n")).alias("n", "line"))
    w = Window.partitionBy(key).orderBy("n")
    marked = lines.withColumn("footer", F.regexp_like("line", F.lit(mark))).withColumn("after", F.coalesce(F.lag("footer").over(w), F.lit(False)))
    headers = marked.where("after").groupBy(key, "line").agg(F.count("*").alias("c")).where("c > 1").select(key, "line", F.lit(True).alias("header"))
    kept = marked.join(headers, [key, "line"], "left").where(~F.col("footer") & ~(F.col("after") & F.coalesce("header", F.lit(False))))
    packed = F.sort_array(F.collect_list(F.struct("n", "line")))
    return kept.groupBy(key).agg(F.array_join(F.transform(packed, lambda x: x["line"]), "\n").alias(text))
