"""Scores of predictions: entity sets, precision and recall, retrieval, overlap of texts."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from tessella.functions.extract import edit_ratio
from tessella.plans.runtime import let


def entity_score(df: DataFrame, truth: str, guess: str, by: Sequence[str] = (), weight: tuple[float, float] | None = None) -> DataFrame:
    """Entity-set scores, per group of ``by`` (and over all, where it is null) or over all.

    A sample with entities counts correct ones, wrong ones (guessed in their
    stead), omitted and redundant ones; its score is correct / all four. A
    sample without counts correct if nothing was guessed; score correct /
    (correct + redundant). The total weighs both by ``weight`` or by their
    numbers of samples; a side without samples counts 0 and has no weight.
    """
    t, g = F.array_distinct(F.coalesce(truth, F.array().cast("array<string>"))), F.array_distinct(F.coalesce(guess, F.array().cast("array<string>")))
    rows = df.select(*by, F.size(t).alias("nt"), F.size(g).alias("ng"), F.size(F.array_intersect(t, g)).alias("c"))
    pos, more = F.col("nt") > 0, F.col("ng") > F.col("nt")
    sums = [
        F.count_if(pos).alias("pos_n"), F.count_if(~pos).alias("neg_n"), F.coalesce(F.sum(F.when(pos, F.col("c"))), F.lit(0)).alias("correct"),
        F.coalesce(F.sum(F.when(pos, F.least("nt", "ng") - F.col("c"))), F.lit(0)).alias("wrong"), F.coalesce(F.sum(F.when(pos & ~more, F.col("nt") - F.col("ng"))), F.lit(0)).alias("omitted"),
        F.coalesce(F.sum(F.when(pos & more, F.col("ng") - F.col("nt"))), F.lit(0)).alias("redundant"), F.count_if(~pos & (F.col("ng") == 0)).alias("neg_correct"), F.coalesce(F.sum(F.when(~pos, F.col("ng"))), F.lit(0)).alias("neg_redundant"),
    ]
    total = (rows.groupingSets([[*by], []], *by) if by else rows.groupBy()).agg(*sums)
    everything = F.col("correct") + F.col("wrong") + F.col("omitted") + F.col("redundant")
    out = total.withColumn("pos_score", F.coalesce(F.try_divide("correct", everything), F.lit(0.0))).withColumn("neg_score", F.coalesce(F.try_divide("neg_correct", F.col("neg_correct") + F.col("neg_redundant")), F.lit(0.0)))
    a, b = (F.lit(float(weight[0])), F.lit(float(weight[1]))) if weight else (F.col("pos_n"), F.col("neg_n"))
    a, b = F.when(F.col("pos_n") > 0, a).otherwise(0), F.when(F.col("neg_n") > 0, b).otherwise(0)
    return out.withColumn("score", F.round(F.coalesce(F.try_divide(a * F.col("pos_score") + b * F.col("neg_score"), a + b), F.lit(0.0)), 6)).withColumns({"pos_score": F.round("pos_score", 6), "neg_score": F.round("neg_score", 6)})


def set_accuracy(df: DataFrame, truth: str, guess: str, by: Sequence[str] = (), loose: bool = True) -> DataFrame:
    """Σ|t∩p| / Σ max(|t|, |p|); loosely, a sample with both empty counts 1 / 1."""
    hit = F.size(F.array_intersect(truth, guess))
    most = F.greatest(F.size(F.array_distinct(F.col(truth))), F.size(F.array_distinct(F.col(guess))))
    if loose:
        hit, most = F.when(most == 0, 1).otherwise(hit), F.when(most == 0, 1).otherwise(most)
    return df.groupBy(*by).agg(F.round(F.coalesce(F.try_divide(F.sum(hit), F.sum(most)), F.lit(0.0)), 6).alias("score"))


def retrieval_recall(df: DataFrame, truth: str, found: str) -> DataFrame:
    """The share of queries all of whose truths were found."""
    return df.agg(F.round(F.avg((F.size(F.array_except(truth, found)) == 0).cast("double")), 6).alias("recall"))


def _f(p: Column, r: Column) -> Column:
    return F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def keyword_prf(df: DataFrame, truth: str, guess: str, flawed_f: bool = False) -> DataFrame:
    """One row of macro and micro precision, recall and F over documents' keyword sets.

    Both empty: P = R = 1; one empty: its ratio is 0. F is 0 where P = R = 0;
    ``flawed_f`` gives 1 there, as some evaluations have it.
    """
    t, g = F.array_distinct(F.col(truth)), F.array_distinct(F.col(guess))
    rows = df.select(F.size(t).alias("nt"), F.size(g).alias("ng"), F.size(F.array_intersect(t, g)).alias("c"))
    empty = (F.col("nt") == 0) & (F.col("ng") == 0)
    p, r = F.when(empty, 1.0).otherwise(F.coalesce(F.try_divide("c", "ng"), F.lit(0.0))), F.when(empty, 1.0).otherwise(F.coalesce(F.try_divide("c", "nt"), F.lit(0.0)))
    scored = rows.withColumn("p", p).withColumn("r", r).withColumn("f", F.when((F.col("p") == 0) & (F.col("r") == 0), float(flawed_f)).otherwise(_f(F.col("p"), F.col("r"))))
    micro = scored.agg(*[F.round(F.avg(x), 6).alias(f"macro_{x}") for x in "prf"], F.coalesce(F.try_divide(F.sum("c"), F.sum("ng")), F.lit(0.0)).alias("micro_p"), F.coalesce(F.try_divide(F.sum("c"), F.sum("nt")), F.lit(0.0)).alias("micro_r"))
    return micro.withColumn("micro_f", F.round(_f(F.col("micro_p"), F.col("micro_r")), 6)).withColumns({"micro_p": F.round("micro_p", 6), "micro_r": F.round("micro_r", 6)})


def classification_report(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """``(label, precision, recall, f1, support)`` of each label, and ``macro avg`` and ``accuracy`` (in f1)."""
    pairs = df.groupBy(F.col(truth).cast("string").alias("t"), F.col(guess).cast("string").alias("g")).agg(F.count("*").alias("n"))
    both = pairs.select(F.explode(F.array(F.struct(F.col("t").alias("label"), F.col("n").alias("st"), F.lit(0).cast("bigint").alias("sg"), F.when(F.col("t") == F.col("g"), F.col("n")).otherwise(0).alias("c")), F.struct(F.col("g").alias("label"), F.lit(0).cast("bigint").alias("st"), F.col("n").alias("sg"), F.lit(0).cast("bigint").alias("c")))).alias("x")).select("x.*")
    sums = both.groupBy("label").agg(F.sum("st").alias("support"), F.sum("sg").alias("guessed"), F.sum("c").alias("c"))
    p, r = F.coalesce(F.try_divide("c", "guessed"), F.lit(0.0)), F.coalesce(F.try_divide("c", "support"), F.lit(0.0))
    per = sums.select("label", p.alias("p"), r.alias("r"), _f(p, r).alias("f"), "support", "c")
    total = per.agg(F.avg("p").alias("p"), F.avg("r").alias("r"), F.avg("f").alias("f"), F.sum("support").alias("support"), F.sum("c").alias("c"))
    out = per.unionByName(total.withColumn("label", F.lit("macro avg"))).unionByName(total.select(F.lit("accuracy").alias("label"), F.lit(None).cast("double").alias("p"), F.lit(None).cast("double").alias("r"), F.try_divide("c", "support").alias("f"), "support", "c"))
    return out.select("label", *[F.round(c, 6).alias(n) for c, n in (("p", "precision"), ("r", "recall"), ("f", "f1"))], "support")


def phrase_report(true_spans: DataFrame, guessed_spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(kind, precision, recall, f1, support)`` of entity spans: right if class, start and end agree."""
    on = [*keys, "kind", "start", "end"]
    t, g = true_spans.select(*on).distinct(), guessed_spans.select(*on).distinct()
    both = t.withColumn("t", F.lit(1)).join(g.withColumn("g", F.lit(1)), on, "full_outer").fillna(0, ["t", "g"])
    sums = both.groupBy("kind").agg(F.sum("t").alias("support"), F.sum("g").alias("n"), F.sum(F.col("t") * F.col("g")).alias("c"))
    p, r = F.coalesce(F.try_divide("c", "n"), F.lit(0.0)), F.coalesce(F.try_divide("c", "support"), F.lit(0.0))
    return sums.select("kind", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(_f(p, r), 6).alias("f1"), "support")


def rouge_n(truth: Column, guess: Column, n: int = 1) -> Column:
    """Precision, recall and F of word n-grams, each distinct gram once, as a struct."""
    def grams(x: Column) -> Column:
        def cut(t: Column) -> Column:
            return F.when(F.size(t) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.array_join(F.slice(t, i, F.lit(n)), " ")))).otherwise(F.array().cast("array<string>"))

        return let(F.filter(F.split(F.lower(x), r"\s+"), lambda w: w != ""), cut)

    a, b = grams(truth), grams(guess)
    c = F.size(F.array_intersect(a, b))
    p, r = F.coalesce(F.try_divide(c, F.size(b)), F.lit(0.0)), F.coalesce(F.try_divide(c, F.size(a)), F.lit(0.0))
    return F.struct(F.round(p, 6).alias("p"), F.round(r, 6).alias("r"), F.round(_f(p, r), 6).alias("f"))


def rouge_l(truth: Column, guess: Column) -> Column:
    """The F of the longest common subsequence of words, as an Arrow UDF."""
    def one(a: str | None, b: str | None) -> float | None:
        if a is None or b is None:
            return None
        x, y = a.lower().split(), b.lower().split()
        row = [0] * (len(y) + 1)
        for w in x:
            last = 0
            for j, v in enumerate(y, 1):
                last, row[j] = row[j], last + 1 if w == v else max(row[j], row[j - 1])
        return 2 * row[-1] / (len(x) + len(y)) if x or y else 0.0

    return pandas_udf(lambda s, t: pd.Series([one(a, b) for a, b in zip(s, t)], dtype="float64"), DoubleType())(truth, guess)


def average_edit_ratio(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """The mean edit ratio of pairs; pairs with a null don't count."""
    ratio = pandas_udf(lambda s, t: pd.Series([edit_ratio(a, b) for a, b in zip(s, t)], dtype="float64"), DoubleType())
    return df.agg(F.round(F.avg(ratio(truth, guess)), 6).alias("ratio"))


def reference_accuracy(df: DataFrame, article: str, truth: str, guess: str) -> DataFrame:
    """``(article_accuracy, flat_accuracy)`` of claim references: articles all of whose claims are right; claims right over the longer list of both."""
    n = F.greatest(F.size(truth), F.size(guess))
    right = F.size(F.filter(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), n - 1)), lambda i: F.get(F.col(truth), i).eqNullSafe(F.get(F.col(guess), i)) & (i < n)), lambda x: x))
    rows = df.select(article, n.alias("n"), F.when(n > 0, right).otherwise(0).alias("right"))
    per = rows.groupBy(article).agg(F.bool_and(F.col("right") == F.col("n")).alias("ok"), F.sum("right").alias("right"), F.sum("n").alias("n"))
    return per.agg(F.round(F.avg(F.col("ok").cast("double")), 6).alias("article_accuracy"), F.round(F.coalesce(F.try_divide(F.sum("right"), F.sum("n")), F.lit(0.0)), 6).alias("flat_accuracy"))


def version_table(scores: DataFrame, versions: Sequence[str]) -> DataFrame:
    """``(subproject, metric)`` by version: the mean value of each."""
    return scores.groupBy("subproject", "metric").pivot("version", list(versions)).agg(F.round(F.avg("value"), 6))


def macro_micro(df: DataFrame, group: str, truth: str, guess: str) -> DataFrame:
    """Accuracy over all rows (micro) and the mean of the groups' accuracies (macro)."""
    per = df.groupBy(group).agg(F.avg((F.col(truth) == F.col(guess)).cast("double")).alias("a"), F.count("*").alias("n"))
    return per.agg(F.round(F.avg("a"), 6).alias("macro"), F.round(F.sum(F.col("a") * F.col("n")) / F.sum("n"), 6).alias("micro"))
