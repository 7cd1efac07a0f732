"""Fields, dates, ranges, codes and other values out of text."""

from __future__ import annotations

import difflib
import math
import re
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, StringType

from tessella.plans.runtime import let


def between_markers(text: Column, starts: Sequence[str], ends: Sequence[str]) -> Column:
    """The trimmed text after the first start marker found and before the nearest end marker after it; null without a start."""
    out = F.lit(None).cast("string")
    for s in reversed(list(starts)):
        rest = F.substring(text, F.instr(text, s) + len(s), F.length(text))
        ended = rest
        for e in ends:
            ended = F.when(F.length(F.substring_index(rest, e, 1)) < F.length(ended), F.substring_index(rest, e, 1)).otherwise(ended)
        out = F.when(F.contains(text, F.lit(s)), F.trim(ended)).otherwise(out)
    return out


def first_matches(text: Column, patterns: Sequence[str], group: int = 0) -> Column:
    """All matches of the first pattern that has any; null if none has."""
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(group)) for p in patterns]
    return F.coalesce(*[F.when(F.size(x) > 0, x) for x in found])


def table_lookup(table: Column, key_pattern: str) -> Column:
    """The value of a map whose key matches (the least such key); null without one."""
    hits = F.map_filter(table, lambda k, v: F.regexp_like(k, F.lit(key_pattern)))
    return F.when(F.size(hits) > 0, F.try_element_at(hits, F.array_min(F.map_keys(hits))))


def rows_to_map(rows: Column) -> Column:
    """A raw table (array of arrays) as a map from its first column, in lower case without blanks, to the rest; later rows win, rows without one fall out."""
    entries = F.transform(rows, lambda r, i: F.struct(F.lower(F.regexp_replace(r[0], r"\s+", "")).alias("k"), i.alias("i"), F.slice(r, 2, 1000000).alias("v")))

    def last(e: Column) -> Column:
        # In order of keys and places, what no row of its key follows; comparing each row with all later ones would be quadratic.
        return F.filter(e, lambda x, i: ~F.coalesce(F.get(e, i + 1)["k"] == x["k"], F.lit(False)))

    kept = let(F.array_sort(F.filter(entries, lambda x: x["k"].isNotNull())), last)
    return F.map_from_entries(F.transform(F.array_sort(F.transform(kept, lambda x: F.struct(x["i"], x["k"], x["v"]))), lambda x: F.struct(x["k"], x["v"])))


def columns_to_map(rows: Column) -> Column:
    """A raw table with a header row as a map from header to column."""
    head, body = rows[0], F.slice(rows, 2, 1000000)
    return F.map_from_arrays(head, F.transform(head, lambda h, i: F.transform(body, lambda r: F.get(r, i))))


#: A range of more numbers is a misreading: it stands for none of them, rather than for an array that no row can hold.
LONGEST_RANGE = 1_000_000


def _numbers(lo: Column, hi: Column) -> Column:
    return F.when(F.coalesce(F.abs(hi - lo) < LONGEST_RANGE, F.lit(False)), F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))


def ranges_to_values(text: Column) -> Column:
    """``1-2,4`` as [1, 2, 4]; a range of over ``LONGEST_RANGE`` numbers or beyond INT is left out."""
    spans = F.filter(F.transform(F.split(text, r"\s*,\s*"), lambda x: F.split(F.trim(x), r"\s*-\s*")), lambda p: F.regexp_like(p[0], F.lit(r"^\d+$")))
    return F.flatten(F.transform(spans, lambda p: _numbers(p[0].try_cast("int"), F.element_at(p, -1).try_cast("int"))))


def values_to_ranges(values: Column) -> Column:
    """Ascending distinct numbers as ranges: [1, 2, 4, 6, 7] as ``1-2,4,6-7``."""
    empty = F.array().cast("array<struct<lo:int,hi:int>>")

    def put(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        grown = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last["lo"].alias("lo"), x.alias("hi"))))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["hi"] + 1 == x), grown).otherwise(F.concat(done, F.array(F.struct(x.alias("lo"), x.alias("hi")))))

    spans = F.aggregate(F.transform(F.array_sort(F.array_distinct(values)), lambda v: v.cast("int")), empty, put)
    return F.array_join(F.transform(spans, lambda s: F.when(s["lo"] == s["hi"], s["lo"].cast("string")).otherwise(F.concat(s["lo"].cast("string"), F.lit("-"), s["hi"].cast("string")))), ",")


def text_ranges(text: Column) -> Column:
    """``1,2,4`` as ``1-2,4``; a text that isn't a list of numbers stays as it is."""
    listed = F.regexp_like(text, F.lit(r"^\s*\d+(\s*,\s*\d+)*\s*$"))
    return F.when(listed, values_to_ranges(F.transform(F.split(text, ","), lambda x: F.try_to_number(F.trim(x), F.lit("999999999")).cast("int")))).otherwise(text)


#: How a claim names its parents, in order: a range, one claim; several are listed after "claims".
_FROM_TO = r"(?i)claims?\s+(\d+)\s*(?:-|–|to|through)\s*(\d+)|权利要求(\d+)\s*[-–~～至到]\s*(\d+)"
_LISTED = r"(?i)claims?\s+(\d+(?:\s*(?:,|or|and|或|和|、)\s*\d+)*)|权利要求(\d+(?:\s*(?:,|or|and|或|和|、)\s*(?:权利要求)?\d+)*)"


def claim_parents(text: Column) -> Column:
    """The claims that a claim's text refers to, ascending and distinct: a range expanded, else the first list or number. None gives an empty array."""
    g = lambda p, i: F.regexp_extract(text, p, i)
    lo, hi = F.concat(g(_FROM_TO, 1), g(_FROM_TO, 3)).try_cast("int"), F.concat(g(_FROM_TO, 2), g(_FROM_TO, 4)).try_cast("int")
    listed = F.transform(F.regexp_extract_all(F.concat(g(_LISTED, 1), g(_LISTED, 2)), F.lit(r"(\d+)"), F.lit(1)), lambda x: x.try_cast("int"))
    return F.when(lo.isNotNull() & hi.isNotNull(), _numbers(F.least(lo, hi), F.greatest(lo, hi))).otherwise(F.array_sort(F.array_distinct(listed)))


def document_number(html: Column) -> Column:
    """An official document number that stands between tags (``>…<``), or null."""
    return F.nullif(F.regexp_extract(html, r">\s*([^<>]{1,20}[〔\[（(]\d{4}[〕\]）)]\s*\d+\s*号)\s*<", 1), F.lit(""))


def table_or_text(from_table: Column, from_text: Column) -> Column:
    """The value of the table where there is one, else that of the text."""
    return F.coalesce(F.nullif(F.trim(from_table), F.lit("")), from_text)


def part(text: Column, delimiter: str, number: int) -> Column:
    """Part ``number`` (from 1) of a delimited text; null if there are fewer."""
    return F.try_element_at(F.split(text, re.escape(delimiter)), F.lit(number))


def typed_result(text: Column, types: Sequence[str]) -> Column:
    """``type, result`` as a struct; null unless the type is one of those allowed."""
    kind = F.trim(F.substring_index(text, ",", 1))
    return F.when(kind.isin(list(types)) & F.contains(text, F.lit(",")), F.struct(kind.alias("type"), F.trim(F.substring(text, F.length(F.substring_index(text, ",", 1)) + 2, F.length(text))).alias("result")))


# ------------------------------------------------------------------ dates and numbers


def ms_to_day(ms: Column) -> Column:
    """Epoch milliseconds as ``YYYY-MM-DD`` (session zone)."""
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd")


def day_to_ms(day: Column) -> Column:
    """``YYYY-MM-DD`` as epoch milliseconds; null if it is no date."""
    return F.unix_millis(F.try_to_timestamp(day, F.lit("yyyy-MM-dd")))


# The first and last year that a date read from a page can have.
FIRST_YEAR, LAST_YEAR = 1929, 2025
#: The written forms of a date on a page, in the order in which they are tried: (pattern, whether the year may have two digits).
_DATE_FORMS = (
    (r"^\s*(\d{4})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*[日号]?\s*$", False),
    (r"^\s*((?:19|20)\d\d|(?!19|20)\d\d)\.?(\d{1,2})\.(\d{1,2})\s*$", True),
    (r"^\s*((?:19|20)\d\d|(?!19|20)\d\d)\.?(\d)(\d{1,2})\s*$", True),
    (r"^\s*((?:19|20)\d\d|(?!19|20)\d\d)\.?(\d\d)(\d{1,2})\s*$", True),
)


def repair_date_column(text: Column) -> Column:
    """A date as recognised on a page, as year-month-day without leading zeros; ``''`` if it can't be one, null included.

    ``2020年1月2日`` in parts; else a year of four digits (19…, 20…) or two (0-2
    in this century), then month and day with a point between, or run together:
    the first form that gives a day of the calendar counts. Years other than
    those of the Chinese form lie in FIRST_YEAR to LAST_YEAR.
    """
    found = []
    for pattern, bounded in _DATE_FORMS:
        written, month, day = (F.regexp_extract(text, pattern, i) for i in (1, 2, 3))
        year = F.when(F.length(written) == 2, F.concat(F.when(written < "3", "20").otherwise("19"), written)).otherwise(written)
        date = F.array_join(F.transform(F.array(year, month, day), lambda x: F.regexp_replace(x, r"^0+(?=\d)", "")), "-")
        sound = F.try_to_timestamp(date, F.lit("y-M-d")).isNotNull()
        found.append(F.when(sound & year.try_cast("int").between(FIRST_YEAR, LAST_YEAR) if bounded else sound, date))
    return F.coalesce(*found, F.lit(""))


# The months.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def repair_month(word: Column) -> Column:
    """The number of the month that a word is, or is one edit from; null for none."""
    out = F.lit(None).cast("int")
    for i, m in reversed(list(enumerate(MONTHS, 1))):
        out = F.when(F.levenshtein(F.lower(word), F.lit(m)) <= 1, F.lit(i)).otherwise(out)
    return out


def valid_date(day: Column) -> Column:
    """Whether ``Y-M-D`` is a date after 1900 and not in the future."""
    parsed = F.try_to_timestamp(day, F.lit("y-M-d"))
    return F.coalesce((F.year(parsed) > 1900) & (parsed <= F.current_timestamp()), F.lit(False))


def combination_key(nation: Column, number: Column) -> Column:
    """A patent's combined key: nation, number without its last character, and ``W`` for an international one, else ``A``."""
    return F.concat(nation, F.substring(number, F.lit(1), F.length(number) - 1), F.when(F.contains(F.lower(number), F.lit("pct")), "W").otherwise("A"))


def western_number(number: Column) -> Column:
    """A Japanese number with an era year in western form: 昭 + 1925, 平 + 1988; its serial filled to six digits."""
    era, year, serial = (F.regexp_extract(number, r"(昭|平)\D*(\d+)\D+(\d+)", i) for i in (1, 2, 3))
    base = F.when(era == "昭", 1925).when(era == "平", 1988)
    return F.when(base.isNotNull(), F.concat((base + year.cast("int")).cast("string"), F.lpad(serial, 6, "0"))).otherwise(number)


def softmax(values: Column) -> Column:
    """The softmax of an array of doubles, shifted by its greatest member."""
    exps = let(F.array_max(values), lambda top: F.transform(values, lambda x: F.exp(x - top)))
    return let(exps, lambda e: let(F.aggregate(e, F.lit(0.0), lambda a, y: a + y), lambda total: F.transform(e, lambda x: x / total)))


def list_median(values: Column) -> Column:
    """The median of an array; of an even number the mean of the middle two; null for none."""
    s, n = F.array_sort(values), F.size(values)
    return F.when(n > 0, (F.try_element_at(s, F.floor((n + 1) / 2).cast("int")) + F.try_element_at(s, F.floor(n / 2).cast("int") + 1)) / F.lit(2.0))


def calendar_difference(a: Column, b: Column) -> Column:
    """From a to b in whole years, months and days; if b is earlier, years are negative, months and days count forwards from there."""
    months = F.floor(F.months_between(b, a)).cast("int")
    return F.struct(F.floor(months / 12).cast("int").alias("years"), F.pmod(months, F.lit(12)).cast("int").alias("months"), F.datediff(b, F.add_months(a, months)).alias("days"))


# ------------------------------------------------------------------ entities


def decode_set(text: Column, delimiter: str = "|") -> Column:
    """A delimited set: trimmed, blanks collapsed, empties and repeats dropped; order kept."""
    return F.array_distinct(F.filter(F.transform(F.split(text, re.escape(delimiter)), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != ""))


def encode_set(values: Column, delimiter: str = "|") -> Column:
    """``|a|b|``; the bare delimiter for an empty set."""
    return F.when(F.size(values) > 0, F.concat(F.lit(delimiter), F.array_join(values, delimiter), F.lit(delimiter))).otherwise(F.lit(delimiter))


def keep_in_text(text: Column, entities: Column) -> Column:
    """The entities that the text holds."""
    return F.filter(entities, lambda e: F.contains(text, e))


def task_prefix(text: Column) -> Column:
    """``task: text`` as a struct (prefix null if there is none)."""
    has = F.regexp_like(text, F.lit(r"^[\w.]+: "))
    return F.struct(F.when(has, F.substring_index(text, ": ", 1)).alias("prefix"), F.when(has, F.regexp_replace(text, r"^[\w.]+: ", "")).otherwise(text).alias("body"))


def _common_subsequence(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def edit_ratio(a: str | None, b: str | None) -> float | None:
    """1 - insertions and deletions / total length; 1 for two empty texts, null with a null."""
    if a is None or b is None:
        return None
    total = len(a) + len(b)
    return 2 * _common_subsequence(a, b) / total if total else 1.0


def edit_ratio_column(a: Column, b: Column) -> Column:
    """``edit_ratio`` as an Arrow UDF."""
    return pandas_udf(lambda x, y: pd.Series([edit_ratio(p, q) for p, q in zip(x, y)], dtype="float64"), DoubleType())(a, b)


def sequence_ratio_column(a: Column, b: Column) -> Column:
    """The matching-blocks ratio of two texts, as an Arrow UDF."""
    return pandas_udf(lambda x, y: pd.Series([None if p is None or q is None else difflib.SequenceMatcher(None, p, q).ratio() for p, q in zip(x, y)], dtype="float64"), DoubleType())(a, b)


def repair_entity(text: str | None, entity: str | None, nothing: str = "") -> str | None:
    """An entity that a model wrote, as it stands in the text.

    Itself if the text holds it; else the span of the text that its characters
    align with, unless that is twice as long or longer, or nothing aligns.
    """
    if text is None or entity is None:
        return None
    if entity == nothing or entity in text:
        return entity
    blocks = [b for b in difflib.SequenceMatcher(None, text, entity, autojunk=False).get_matching_blocks() if b.size]
    if not blocks or sum(b.size for b in blocks) * 2 < len(entity):
        return nothing
    span = text[blocks[0].a : blocks[-1].a + blocks[-1].size]
    return span if len(span) < 2 * len(entity) else nothing


def repair_entity_column(text: Column, entity: Column, nothing: str = "") -> Column:
    """``repair_entity`` as an Arrow UDF."""
    return pandas_udf(lambda x, y: pd.Series([repair_entity(p, q, nothing) for p, q in zip(x, y)], dtype=object), StringType())(text, entity)


def correct_keywords(words: Column, keywords: Sequence[str], most: int = 2) -> Column:
    """Tokens within so many edits of a keyword replaced by the nearest (of equals the one listed first)."""
    def fix(w: Column) -> Column:
        out, best = w, F.lit(most + 1)
        for k in keywords:
            d = F.levenshtein(w, F.lit(k))
            out, best = F.when(d < best, F.lit(k)).otherwise(out), F.least(best, d)
        return out

    return F.transform(words, fix)


def split_at_keywords(text: Column, keywords: Sequence[str], most: int = 4, begin: int = 10, least: int = 8) -> Column:
    """The text cut before the first ``most`` keywords found from offset ``begin``; pieces over ``least`` characters. An Arrow UDF."""
    pattern = re.compile("|".join(map(re.escape, sorted(keywords, key=len, reverse=True))))

    def run(x: str | None) -> list[str] | None:
        if x is None:
            return None
        cuts = [m.start() for _, m in zip(range(most), pattern.finditer(x, begin))]
        bounds = [0, *cuts, len(x)]
        return [x[a:b] for a, b in zip(bounds, bounds[1:]) if b - a > least]

    return pandas_udf(lambda s: s.map(run), ArrayType(StringType()))(text)


def keyword_then_date(df: DataFrame, key: str, text: str, keyword: str, date_pattern: str) -> DataFrame:
    """``(key, date)``: the date on the first line with the keyword, or on the line after it; null without a date there."""
    lines = df.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, r"\r?\n")).alias("n", "line"))
    following = lines.withColumn("next", F.lead("line").over(Window.partitionBy(key).orderBy("n")))
    hit = following.where(F.contains("line", F.lit(keyword)))
    date = F.coalesce(F.nullif(F.regexp_extract("line", date_pattern, 0), F.lit("")), F.nullif(F.regexp_extract(F.coalesce("next", F.lit("")), date_pattern, 0), F.lit("")))
    return hit.groupBy(key).agg(F.min_by(date, "n").alias("date"))


def inches_to_cm(*columns: str) -> list[Column]:
    """Box columns in centimetres."""
    return [(F.col(c) * 2.54).alias(c) for c in columns]


def url_parts(url: Column) -> Column:
    """Host, path and query of an address as a struct."""
    return F.struct(*[F.try_parse_url(url, F.lit(p)).alias(p.lower()) for p in ("HOST", "PATH", "QUERY")])


def merge_maps(first: Column, second: Column, both: str = "second") -> Column:
    """Two maps as one; for keys of both, the value of the ``first`` or ``second``, or the ``greatest``."""
    pick = {"first": lambda k, a, b: F.coalesce(a, b), "second": lambda k, a, b: F.coalesce(b, a), "greatest": lambda k, a, b: F.greatest(a, b)}[both]
    return F.map_zip_with(first, second, pick)


def parameter_grid(spark, options: Mapping[str, Sequence]) -> DataFrame:
    """The Cartesian product of parameter values, one row each: a product of literal lists on one row."""
    out = spark.createDataFrame([(0,)], "__x int")
    for name, values in options.items():
        out = out.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return out.drop("__x")


def log_odds(p: float) -> float:
    """ln(p / (1 - p))."""
    return math.log(p / (1 - p))
