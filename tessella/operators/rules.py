"""Rules over records: scripted predicates, mappings, cascades, taxonomies."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.plans.runtime import spread


def is_head(key: str = "esid", similar: str = "similar_esid") -> Column:
    """Whether a record is the head of its fold: it names itself, or nothing."""
    return F.col(similar).isNull() | (F.col(similar) == F.col(key))


def keep_where(value: Column, condition: Column, other: object = None) -> Column:
    """The value where the condition holds, else another; an unknown condition doesn't hold."""
    return F.when(F.coalesce(condition, F.lit(False)), value).otherwise(F.lit(other) if not isinstance(other, Column) else other)


def mask_where(value: Column, condition: Column, other: object = None) -> Column:
    """The value where the condition doesn't hold, else another."""
    return keep_where(value, ~F.coalesce(condition, F.lit(False)), other)


def mapped(value: Column, table: Mapping) -> Column:
    """A value by a table; null for what the table lacks."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), value)


def full_match(text: Column, pattern: str) -> Column:
    """Whether a pattern fits the whole text."""
    return F.regexp_like(text, F.lit(rf"^(?:{pattern})$"))


# Frequent words of languages in Latin script.
STOP_WORDS = {"en": "the of and with was were for that in to", "de": "der die das und mit für von nicht zu ist", "fr": "le la les des et une dans pour que du", "es": "el la los las una con para del que en", "pt": "o os uma com para do da não que em"}


def likely_language(text: Column) -> Column:
    """A language by script and frequent words: ja, zh, ru, else the Latin language of most of them; null without any."""
    count = lambda words: F.regexp_count(F.lower(text), F.lit(rf"\b(?:{'|'.join(words.split())})\b"))
    best = F.array_max(F.array(*[F.struct(count(w).alias("n"), F.lit(c).alias("c")) for c, w in STOP_WORDS.items()]))
    return F.when(F.regexp_like(text, F.lit("[぀-ヿ]")), "ja").when(F.regexp_like(text, F.lit("[一-鿿]")), "zh").when(F.regexp_like(text, F.lit("[а-яА-Я]")), "ru").when(best["n"] > 0, best["c"])


def language_filter(df: DataFrame, text: str, languages: Sequence[str]) -> DataFrame:
    """The rows whose likely language is listed."""
    return df.where(likely_language(F.col(text)).isin(list(languages)))


def mentions(texts: DataFrame, companies: DataFrame, key: str, text: str, name: str, aliases: Sequence[str]) -> DataFrame:
    """``(key, names)``: companies one of whose aliases stands in a text, ascending; texts without one are left out."""
    from tessella.operators.dictionary import occurrences

    table = companies.select(F.col(name).alias("__n"), F.explode(F.array(*aliases)).alias("entry")).where("entry <> ''")
    hits = occurrences(texts, table.select("entry"), key, text).select(key, "entry").distinct()
    return hits.join(table, "entry").groupBy(key).agg(F.sort_array(F.collect_set("__n")).alias("names"))


def cascade(rules: Sequence[tuple[Column, object]], otherwise: Column) -> Column:
    """The value of the first rule whose condition holds, else another (as a model's answer)."""
    return functools.reduce(lambda rest, rule: F.when(F.coalesce(rule[0], F.lit(False)), F.lit(rule[1])).otherwise(rest), reversed(list(rules)), otherwise)


def valid_label(first: Column, second: Column, taxonomy: Mapping[str, Sequence[str]], other: str = "other") -> Column:
    """Both levels of a label as a struct; a first level out of the taxonomy, or a second one not of the first, is ``other``."""
    table = F.create_map(*[x for k, v in taxonomy.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    own = F.try_element_at(table, first)
    good = F.coalesce(F.array_contains(own, second), F.lit(False))
    return F.struct(F.when(own.isNotNull(), first).otherwise(other).alias("first"), F.when(good, second).otherwise(other).alias("second"))


def name_tokens(tokens: Column, least: int = 4) -> Column:
    """Tokens that can be names of substances: trimmed, digits and # dropped, none with capitals, none under ``least`` letters."""
    plain = F.transform(tokens, lambda x: F.regexp_replace(F.trim(x), r"[\d#]", ""))
    return F.filter(plain, lambda x: (F.length(x) >= least) & ~F.regexp_like(x, F.lit("[A-Z]")))


def translated(df: DataFrame, key: str, text: str, language: Column, translate: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """``(key, text)`` translated sentence by sentence by a function of (texts), with the separators between sentences kept; a text in the target language is the function's own affair."""
    parts = F.regexp_extract_all(F.col(text), F.lit(r"([^.!?。！？\n]*[.!?。！？\n]*\s*)"), F.lit(1))
    rows = df.where(F.col(text).isNotNull()).select(key, language.alias("lang"), F.posexplode(parts).alias("pos", "part")).where("part <> ''")
    split = rows.select(key, "lang", "pos", F.regexp_extract("part", r"^(\s*)", 1).alias("a"), F.trim(F.regexp_replace("part", r"^\s+|\s+$", "")).alias("s"), F.regexp_extract("part", r"\S(\s*)$", 1).alias("z"))
    from tessella.operators.inference import predict

    done = predict(split, "s", translate, "string", "t")
    packed = F.sort_array(F.collect_list(F.struct("pos", F.concat("a", F.coalesce("t", F.lit("")), "z").alias("x"))))
    return done.groupBy(key).agg(F.array_join(F.transform(packed, lambda p: p["x"]), "").alias(text))


def requests(df: DataFrame, column: str, ask: Callable[[str], str], into: str, per_task: int = 8, retries: int = 2) -> DataFrame:
    """``df`` with the answers of a service: at most ``per_task`` questions at once in each task, failures asked again and null in the end."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{into}` string"

    def one(x: str | None) -> str | None:
        for _ in range(retries + 1):
            try:
                return None if x is None else ask(x)
            except Exception:  # noqa: BLE001 - a service may fail in any way
                continue
        return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(per_task) as pool:
            for b in batches:
                yield b.assign(**{into: list(pool.map(one, b[column]))})

    return spread(df).mapInPandas(run, schema)
