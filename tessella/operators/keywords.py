"""Keyword scores from where and how often a term's names stand in abstract and content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.dictionary import occurrences

# Weights, smoothing and threshold of the score.
W_POS_ABSTRACT, W_POS_CONTENT, W_FREQ_ABSTRACT, W_FREQ_CONTENT, SMOOTH, THRESHOLD = 1.8, 0.8, 2.2, 1.2, 0.8, 2.5


def visible(html: Column) -> Column:
    """The text between tags, without line feeds, commas and quotes, as the score reads it."""
    return F.translate(F.array_join(F.regexp_extract_all(F.translate(html, "\n", " "), F.lit(r">([^<>]*)<"), F.lit(1)), ""), ",'", "")


def term_statistics(texts: DataFrame, names: DataFrame, key: str, text: str, term: str = "term", name: str = "name") -> DataFrame:
    """``(key, term, n, pos, share)``: over all names of a term, occurrences, the median of the names' median positions (the text's length if none) and the share of sentences with it.

    A row for every term of ``names`` and every text.
    """
    body = texts.where(F.col(text).isNotNull()).select(key, F.col(text).alias("__t"))
    hits = occurrences(body, names.select(F.col(name).alias("entry")), key, "__t").join(names.select(F.col(term).alias("term"), F.col(name).alias("entry")), "entry")
    by_name = hits.groupBy(key, "term", "entry").agg(F.count("*").alias("c"), F.median("start").alias("m"))
    by_term = by_name.groupBy(key, "term").agg(F.sum("c").alias("n"), F.median("m").alias("pos"))
    sentence = hits.join(body, key).select(key, "term", F.size(F.split(F.substring("__t", F.lit(1), F.col("start")), r"[.。!！?？]")).alias("s")).groupBy(key, "term").agg(F.count_distinct("s").alias("s"))
    count = body.select(key, F.length("__t").alias("len"), F.greatest(F.lit(1), F.size(F.filter(F.split("__t", r"[.。!！?？]"), lambda x: F.trim(x) != ""))).alias("sentences"))
    from tessella.plans.runtime import broadcast_if_small

    every = count.join(broadcast_if_small(names.select(F.col(term).alias("term")).distinct()), F.lit(True))
    out = every.join(by_term, [key, "term"], "left").join(sentence, [key, "term"], "left")
    return out.select(key, "term", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("pos", F.col("len").cast("double")).alias("pos"), (F.coalesce("s", F.lit(0)) / F.col("sentences")).alias("share"))


def score(abstract: DataFrame, content: DataFrame, key: str) -> DataFrame:
    """``(key, term, score)`` of the statistics of both parts; lower is better."""
    a = abstract.select(key, "term", F.col("n").alias("n1"), F.col("pos").alias("p1"))
    c = content.select(key, "term", F.col("n").alias("n2"), F.col("pos").alias("p2"), "share")
    w = Window.partitionBy(key)
    deep = lambda p: F.ln(F.ln(F.col(p) + 3))
    top = W_POS_ABSTRACT * deep("p1") + W_POS_CONTENT * deep("p2")
    below = W_FREQ_ABSTRACT * F.col("n1") / (F.avg("n1").over(w) + SMOOTH) + W_FREQ_CONTENT * F.col("n2") / (F.avg("n2").over(w) + SMOOTH) + F.col("share")
    # A term that stands nowhere has nothing below: the worst score.
    return a.join(c, [key, "term"]).select(key, "term", F.when(below > 0, top / F.when(below > 0, below)).otherwise(F.lit(float("inf"))).alias("score"))


def rank(scores: DataFrame, key: str, threshold: float = THRESHOLD) -> DataFrame:
    """``(key, term, score, rank)`` of the terms under the threshold, best first, ties by term."""
    w = Window.partitionBy(key).orderBy("score", "term")
    return scores.where(F.col("score") < threshold).withColumn("rank", F.row_number().over(w))
