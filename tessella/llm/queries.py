"""Queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import boilerplate, languages, leaks, names, scans, skeleton, splits, tokens
from tessella.plans.runtime import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.pages_to_blocks(table(spark, d, "news_page"))


def p1_text(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.pages_to_text(table(spark, d, "news_page"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.tied_codes(table(spark, d, "patent_claim"))


def p2_splits(spark: SparkSession, d: str) -> DataFrame:
    return splits.assign_splits(table(spark, d, "patent_claim"))


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    return splits.tied_groups(table(spark, d, "patent_claim"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.repairs(table(spark, d, "title_page"))


def p4_text(spark: SparkSession, d: str) -> DataFrame:
    return scans.paragraphs(table(spark, d, "title_page"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return languages.unnamed_languages(table(spark, d, "news_body"), table(spark, d, "documents"))


def p5_records(spark: SparkSession, d: str) -> DataFrame:
    return languages.record_languages(table(spark, d, "news_body"), table(spark, d, "documents"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return names.linked_names(table(spark, d, "finance_news"), table(spark, d, "person_input"))


def p7_entities(spark: SparkSession, d: str) -> DataFrame:
    return names.attribute(names.spellings(table(spark, d, "finance_news"), table(spark, d, "person_input")))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_documents(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_item"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return skeleton.look_alike_pairs(table(spark, d, "documents"))


def p10_classes(spark: SparkSession, d: str) -> DataFrame:
    return skeleton.look_alike_classes(table(spark, d, "documents"))


QUERIES: dict[str, Query] = {"p1_found": p1_found, "p1_text": p1_text, "p2_found": p2_found, "p2_splits": p2_splits, "p2_classes": p2_classes, "p4_found": p4_found, "p4_text": p4_text, "p5_found": p5_found, "p5_records": p5_records, "p7_found": p7_found, "p7_entities": p7_entities, "p8_ids": p8_ids, "p9_found": p9_found, "p10_found": p10_found, "p10_classes": p10_classes}
SQL: dict[str, str] = {
    "p2_found": r"""
    with recursive t as (
      select distinct upper(regexp_replace(patent_code, '[\s\x{a0}\x{3000}\-\x{2010}-\x{2015}]', '', 'g')) as c, lower(regexp_replace(esid, '[\s\x{a0}\x{3000}\-\x{2010}-\x{2015}]', '', 'g')) as e
      from patent_claim where patent_code is not null and esid is not null),
    ed as (select distinct a.c as a, b.c as b from t a join t b on a.e = b.e and a.c <> b.c),
    r as (select a, b from ed union select r.a, ed.b from r join ed on ed.a = r.b)
    select a as code_a, b as code_b from r where a < b
    """,
}
