"""Functions over rows, and the dataflow around models that the caller plugs in.

No model is shipped: a scorer is any function from a pandas Series (or frame)
to a Series. Rule-based fallbacks run without one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DataType

from tessella.functions import extract, text as T
from tessella.plans.runtime import spread


def map_rows(df: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str, init: Callable[[], object] | None = None) -> DataFrame:
    """A function over batches on all cores; ``init`` runs once per task and its value is the function's second argument. As many rows must come out as went in."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = init() if init else None
        for b in batches:
            out = function(b, state) if init else function(b)
            if len(out) != len(b):
                raise ValueError(f"{len(b)} rows went in, {len(out)} came out")
            yield out

    return spread(df).mapInPandas(run, schema)


def predict(df: DataFrame, column: str, scorer: Callable[[pd.Series], pd.Series], kind: str | DataType, into: str) -> DataFrame:
    """``df`` with a scorer's answer for a column; each different input is asked once."""
    answer = pandas_udf(scorer, kind)
    known = df.select(column).where(F.col(column).isNotNull()).distinct().withColumn(into, answer(F.col(column)))
    return df.join(known, column, "left").select(*df.columns, into)


def predict_chunks(df: DataFrame, key: str, column: str, scorer: Callable[[pd.Series], pd.Series], size: int = 400, overlap: int = 200, delimiter: str = "|") -> DataFrame:
    """``(key, prediction)``: windows of a text asked one by one, their answers as one set in the windows' order; a text without any gives the bare delimiter."""
    chunks = T.chunk_rows(df.select(key, column), column, size, overlap)
    asked = predict(chunks, "chunk", scorer, "string", "__p")
    packed = F.sort_array(F.collect_list(F.struct("pos", "__p")))
    merged = asked.groupBy(key).agg(extract.encode_set(extract.decode_set(F.array_join(F.transform(packed, lambda x: x["__p"]), delimiter), delimiter), delimiter).alias("prediction"))
    return df.select(key).distinct().join(merged, key, "left").select(key, F.coalesce("prediction", F.lit(delimiter)).alias("prediction"))


def expand(df: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A function from rows to any number of rows."""
    return df.mapInPandas(lambda batches: (function(b) for b in batches), schema)


def route(length_of: Column, least: int, rule: Column, model: Column) -> Column:
    """The rule's answer for long texts, the model's for short ones."""
    return F.when(length_of >= least, rule).otherwise(model)


def fuse(rule: Column, model: Column) -> Column:
    """The rule's answer where there is one, else the model's."""
    return F.coalesce(F.nullif(rule, F.lit("")), model)


#: Preprocessors by version.
VERSIONS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def version(name: str) -> Callable:
    """Registers a preprocessor under a version."""
    def register(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        VERSIONS[name] = f
        return f

    return register


# ------------------------------------------------------------------ summaries


def sentence_scores(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, pos, sentence, score)``: without a model, the mean frequency in the text of a sentence's tokens over 1 + its position's logarithm."""
    from tessella.plans.query import tokens

    s = df.select(key, F.posexplode(T.sentences_en(F.col(text))).alias("pos", "sentence"))
    t = s.select(key, "pos", F.explode(tokens("sentence")).alias("w")).where(F.length("w") > 2)
    counts = t.groupBy(key, "w").agg(F.count("*").alias("c"))
    mean = t.join(counts, [key, "w"]).groupBy(key, "pos").agg(F.avg("c").alias("m"))
    return s.join(mean, [key, "pos"], "left").select(key, "pos", "sentence", F.round(F.coalesce("m", F.lit(0.0)) / (1 + F.log2(F.col("pos") + 2)), 6).alias("score"))


def summary(scored: DataFrame, key: str, k: int, block: bool = False) -> DataFrame:
    """``(key, summary)``: the k best sentences in the text's order; with ``block``, a sentence that shares a trigram with a better chosen one is passed over."""
    if not block:
        w = Window.partitionBy(key).orderBy(F.desc("score"), "pos")
        top = scored.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
        return top.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "sentence"))), lambda x: x["sentence"]), " ").alias("summary"))
    kind = scored.schema[key].dataType.simpleString()

    def choose(g: pd.DataFrame) -> pd.DataFrame:
        chosen, seen = [], set()
        for row in g.sort_values(["score", "pos"], ascending=[False, True]).itertuples():
            words = row.sentence.lower().split()
            grams = {tuple(words[i : i + 3]) for i in range(len(words) - 2)}
            if not grams & seen:
                chosen.append((row.pos, row.sentence))
                seen |= grams
            if len(chosen) == k:
                break
        return pd.DataFrame({key: [g[key].iloc[0]], "summary": [" ".join(s for _, s in sorted(chosen))]})

    return scored.select(key, "pos", "sentence", "score").groupBy(key).applyInPandas(choose, f"{key} {kind}, summary string")


def answer(scored: DataFrame, key: str, question: Column | None = None) -> DataFrame:
    """``(key, answer)``: without a model, the sentence that shares most of the question's different words of over two letters, of several the one of the greatest score, then the first.

    Null where no sentence shares a word with the question. Without a question the score alone decides.
    """
    from tessella.plans.query import tokens

    long = lambda x: F.filter(F.array_distinct(tokens(x)), lambda w: F.length(w) > 2)
    shared = F.lit(0) if question is None else F.size(F.array_intersect(long(F.col("sentence")), long(question)))
    rated = scored.select(key, "sentence", "score", "pos", shared.alias("shared"))
    said = F.min_by(F.struct("sentence", "shared"), F.struct(-F.col("shared"), -F.col("score"), F.col("pos")))
    best = rated.groupBy(key).agg(said.alias("x"))
    return best.select(key, (F.col("x.sentence") if question is None else F.when(F.col("x.shared") > 0, F.col("x.sentence"))).alias("answer"))


# ------------------------------------------------------------------ staged pipelines


def article_label(paragraph_labels: DataFrame, key: str, label: str = "label") -> DataFrame:
    """The label of an article: the least of its paragraphs'."""
    return paragraph_labels.groupBy(key).agg(F.min(label).alias(label))


def financing_news(news: DataFrame, classify: Callable[[pd.Series], pd.Series], recognise: Mapping[str, Callable[[pd.Series], pd.Series]], least: int = 50) -> DataFrame:
    """``(esid, label, fields)`` of financing news: paragraphs over ``least`` characters are classified, the article takes the least label, and the first paragraph so labelled (else the first) is asked for each field."""
    p = news.select("esid", F.posexplode_outer("paragraphs").alias("pos", "paragraph"))
    labelled = predict(p.where(F.length("paragraph") > least), "paragraph", classify, "int", "l")
    label = labelled.groupBy("esid").agg(F.min("l").alias("label"))
    chosen = labelled.join(label, "esid").groupBy("esid").agg(F.min_by("paragraph", F.when(F.col("l") == F.col("label"), F.col("pos"))).alias("chosen"))
    first = p.groupBy("esid").agg(F.min_by("paragraph", "pos").alias("first"))
    base = news.select("esid").distinct().join(label, "esid", "left").join(chosen, "esid", "left").join(first, "esid", "left").withColumn("paragraph", F.coalesce("chosen", "first"))
    for name, f in recognise.items():
        base = predict(base, "paragraph", f, "string", name)
    entries = [x for name in recognise for x in (F.lit(name), F.col(name))]
    return base.select("esid", F.coalesce("label", F.lit(0)).alias("label"), F.create_map(*entries).alias("fields"))


def round_default(value: Column) -> Column:
    """A financing round as reported; undisclosed ones count as strategic."""
    return F.when(F.trim(value) == "未披露", "战略投资").otherwise(value)


def claim_pipeline(claims: DataFrame, kind: Callable[[pd.Series], pd.Series] | None = None) -> DataFrame:
    """``(main_id, claim_num, claim_class, claim_type, claim_ref)``: a claim with parents is dependent (D), else independent (I); its type by a model where given, else by its first words; its parents by rule."""
    refs = extract.claim_parents(F.col("claim_text"))
    out = claims.select("main_id", "claim_num", "claim_text", refs.alias("claim_ref")).withColumn("claim_class", F.when(F.size("claim_ref") > 0, "D").otherwise("I"))
    if kind is not None:
        out = predict(out, "claim_text", kind, "string", "claim_type")
    else:
        rules = (("use", r"(?i)^use of|用途"), ("method", r"(?i)^(a|the) (method|process)|方法"), ("kit", r"(?i)^(a|the) kit|试剂盒"), ("composition", r"(?i)composition|组合物"))
        rule = F.lit(None).cast("string")
        for name, pattern in reversed(rules):
            rule = F.when(F.regexp_like("claim_text", F.lit(pattern)), name).otherwise(rule)
        out = out.withColumn("claim_type", rule)
    return out.select("main_id", "claim_num", "claim_class", "claim_type", "claim_ref")


def clean_content_labels(labels: Column, title: Column, unwanted: Sequence[str] = ()) -> Column:
    """Labels of a news text that its title holds, blacklisted parts taken out, empties dropped."""
    out = labels
    for w in unwanted:
        out = F.transform(out, lambda x, w=w: F.replace(x, F.lit(w), F.lit("")))
    return F.filter(F.array_distinct(out), lambda x: (x != "") & F.contains(title, x))


def best_synonym(names: DataFrame, synonyms: DataFrame, key: str, name: str, term: str = "term", synonym: str = "name") -> DataFrame:
    """``(key, term, ratio)``: the term whose synonym has the greatest edit ratio to the name, ties by term.

    Each different name is rated once, however often it stands; the
    dictionary's size is checked before it is broadcast to the names. A null
    name has no ratio.
    """
    from tessella.plans.pairs import split_join
    from tessella.plans.runtime import broadcast_if_small

    pairs = names.select(name).distinct().join(broadcast_if_small(synonyms.select(F.col(term).alias("term"), F.col(synonym).alias("__s"))), F.lit(True))
    rated = pairs.withColumn("ratio", F.round(extract.edit_ratio_column(F.col(name), F.col("__s")), 6))
    best = rated.groupBy(name).agg(F.min_by(F.struct("term", "ratio"), F.struct(-F.col("ratio"), F.col("term"))).alias("x"))
    return split_join(names.select(key, name), best, name, "left").select(key, "x.term", "x.ratio")
