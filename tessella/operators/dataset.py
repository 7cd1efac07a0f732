"""Datasets: reshaping, splits, balancing, negatives, validation.

Every draw is by a hash of a key and a seed, so it doesn't depend on how rows
are laid out, and a lost task draws the same again.
"""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.plans.pairs import GROUP_BLOCK, split_join
from tessella.plans.runtime import broadcast_if_small, cut


def draw(key: Column | str, seed: int = 0) -> Column:
    """A draw as 32 hexadecimal digits."""
    return F.md5(F.concat((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit(f":{seed}")))


def uniform(key: Column | str, seed: int = 0) -> Column:
    """A draw in [0, 1)."""
    return F.conv(F.substring(draw(key, seed), 1, 8), 16, 10).cast("bigint") / F.lit(1 << 32)


def turn_columns(df: DataFrame, columns: Mapping[str, str], keep: Sequence[str], into: str = "target_text", prefix: str = "prefix") -> DataFrame:
    """Wide to long: each of the columns as rows under its prefix; nulls stay."""
    parts = [F.struct(F.lit(p).alias(prefix), F.col(c).cast("string").alias(into)) for c, p in columns.items()]
    return df.select(*keep, F.explode(F.array(*parts)).alias("__e")).select(*keep, f"__e.{prefix}", f"__e.{into}")


def turn_prefixes(df: DataFrame, prefixes: Mapping[str, str], keep: Sequence[str], value: str = "target_text", prefix: str = "prefix") -> DataFrame:
    """Long to wide: a column for each prefix; of several values the least."""
    return df.where(F.col(prefix).isin(list(prefixes))).groupBy(*keep).agg(*[F.min(F.when(F.col(prefix) == p, F.col(value))).alias(c) for p, c in prefixes.items()])


def pivot(df: DataFrame, index: Sequence[str], column: str, values: Sequence, aggregates: Mapping[str, Column]) -> DataFrame:
    """Pivot with named aggregates; columns are ``<value>_<name>``."""
    out = df.groupBy(*index).pivot(column, list(values)).agg(*[a.alias(n) for n, a in aggregates.items()])
    return out.withColumnRenamed(str(values[0]), f"{values[0]}_{next(iter(aggregates))}") if len(aggregates) == 1 and len(values) == 1 else out


def split_expand(df: DataFrame, column: str, delimiter: str, names: Sequence[str]) -> DataFrame:
    """A delimited column as several; the last takes the rest, missing ones are null."""
    parts = F.split(F.col(column), delimiter, len(names))
    return df.select("*", *[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)])


def random_split(df: DataFrame, key: str, share: float = 0.2, most: int = 8000, seed: int = 0) -> DataFrame:
    """``df`` with ``split``: eval for the min(most, share) rows of least draw, else train.

    The cut is found from counts of 4096 ranges of the draw; only the range at
    the cut is sorted.
    """
    marked = df.withColumn("__d", draw(key, seed)).withColumn("__r", F.conv(F.substring("__d", 1, 3), 16, 10).cast("int"))
    counts = marked.groupBy("__r").agg(F.count("*").alias("n"))
    w = Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, 0)
    total = Window.partitionBy()
    line = counts.withColumn("upto", F.sum("n").over(w)).withColumn("want", F.least(F.lit(most), F.floor(F.sum("n").over(total) * share)))
    inside = marked.join(F.broadcast(line.select("__r", "upto", "n", "want")), "__r")
    within = Window.partitionBy("__r").orderBy("__d", F.col(key).cast("string"))
    placed = inside.withColumn("__k", F.col("upto") - F.col("n") + F.row_number().over(within))
    return placed.withColumn("split", F.when(F.col("__k") <= F.col("want"), "eval").otherwise("train")).drop("__d", "__r", "__k", "upto", "n", "want")


def stratified_split(df: DataFrame, key: str, stratum: Sequence[str], share: float = 0.2, seed: int = 0) -> DataFrame:
    """``df`` with ``split``: of each stratum the rows whose draw is under the share are eval.

    A draw per row instead of a rank per stratum: a stratum of a third of all
    rows needs no sort, and the share holds up to chance.
    """
    return df.withColumn("split", F.when(uniform(F.concat_ws(":", F.col(key).cast("string"), *[F.col(s).cast("string") for s in stratum]), seed) < share, "eval").otherwise("train"))


def replicate(df: DataFrame, group: Sequence[str], key: str, targets: DataFrame, seed: int = 0) -> DataFrame:
    """Each group brought to its target size (column ``target``): whole copies of all rows, and the rest drawn; or drawn down.

    ``copy`` numbers the copies from 0. Ranks are needed only for the drawn
    rest, within 256 slices of a group, whose quotas follow from their counts.
    """
    marked = df.withColumn("__s", F.conv(F.substring(draw(key, seed), 1, 2), 16, 10).cast("int"))
    slices = marked.groupBy(*group, "__s").agg(F.count("*").alias("m"))
    by_slice = Window.partitionBy(*group).orderBy("__s").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*group)
    plan = slices.withColumn("n", F.sum("m").over(whole)).withColumn("upto", F.sum("m").over(by_slice)).join(targets, list(group))
    plan = plan.withColumn("copies", F.floor(F.col("target") / F.col("n")).cast("int")).withColumn("rest", F.col("target") % F.col("n"))
    rows = marked.join(plan, [*group, "__s"])
    ranked = rows.withColumn("k", F.col("upto") - F.col("m") + F.row_number().over(Window.partitionBy(*group, "__s").orderBy(draw(key, seed), F.col(key).cast("string"))))
    times = F.col("copies") + (F.col("k") <= F.col("rest")).cast("int")
    return ranked.where(times > 0).withColumn("copy", F.explode(F.sequence(F.lit(0), times - 1))).select(*df.columns, "copy")


def balance(df: DataFrame, label: str, key: str, most: int | None = None, how: str = "max", seed: int = 0) -> DataFrame:
    """Every label brought to one size: that of the largest, at most ``most``; ``geometric`` takes the mean of sizes, ``min`` the least."""
    sizes = df.groupBy(label).agg(F.count("*").alias("n"))
    w = Window.partitionBy()
    goal = {"max": F.max("n").over(w), "min": F.min("n").over(w), "geometric": F.round(F.exp(F.avg(F.ln("n")).over(w))).cast("bigint")}[how]
    targets = sizes.select(label, (F.least(goal, F.lit(most)) if most else goal).alias("target"))
    return replicate(df, [label], key, targets, seed)


def balance_two_levels(df: DataFrame, outer: str, flag: str, key: str, ratio: float = 5.0, seed: int = 0) -> DataFrame:
    """Within each outer group both sides of a flag brought to the larger size, or to their mean if that is ``ratio`` times the lesser or more."""
    sizes = df.groupBy(outer, flag).agg(F.count("*").alias("n"))
    w = Window.partitionBy(outer)
    large, small = F.max("n").over(w), F.min("n").over(w)
    targets = sizes.select(outer, flag, F.when(large < ratio * small, large).otherwise(F.round((large + small) / 2).cast("bigint")).alias("target"))
    return replicate(df, [outer, flag], key, targets, seed)


def tiered_sample(df: DataFrame, label: str, key: str, seed: int = 0) -> DataFrame:
    """Rows for evaluation: of a class of up to 20 rows one, up to 50 two, up to 100 four, else one in twenty.

    Those of least draw, ties by key. Ranks are sought within 256 slices of the
    draw, of which those beyond a class's quota fall out before any sort. Rows
    of a null class are a class of their own.
    """
    marked = df.withColumn("__l", F.coalesce(F.concat(F.lit("="), F.col(label).cast("string")), F.lit(""))).withColumn("__s", F.conv(F.substring(draw(key, seed), 1, 2), 16, 10).cast("int"))
    slices = marked.groupBy("__l", "__s").agg(F.count("*").alias("__m"))
    whole, upto = Window.partitionBy("__l"), Window.partitionBy("__l").orderBy("__s").rowsBetween(Window.unboundedPreceding, 0)
    n = F.sum("__m").over(whole)
    quota = F.when(n <= 20, 1).when(n <= 50, 2).when(n <= 100, 4).otherwise(F.floor(n * 0.05))
    plan = slices.select("__l", "__s", (F.sum("__m").over(upto) - F.col("__m")).alias("__before"), quota.alias("__q")).where("__before < __q")
    rows = marked.join(broadcast_if_small(plan), ["__l", "__s"])
    within = Window.partitionBy("__l", "__s").orderBy(draw(key, seed), F.col(key).cast("string"))
    return rows.withColumn("__k", F.col("__before") + F.row_number().over(within)).where(F.col("__k") <= F.col("__q")).select(*df.columns)


def negative_pairs(df: DataFrame, labels: DataFrame, key: str, label: str, n: int = 10, seed: int = 0) -> DataFrame:
    """``(key, label, labels)``: each row with its own label (1) and ``n`` other labels by draw (0). ``labels`` is a dimension."""
    names = labels.select(F.col(label).alias("other")).distinct().agg(F.sort_array(F.collect_set("other")).alias("__all"))
    own = df.join(F.broadcast(names), F.lit(True))
    ranked = F.transform(F.filter("__all", lambda x: x != F.col(label)), lambda x: F.struct(F.md5(F.concat(F.col(key).cast("string"), F.lit(":"), x.cast("string"), F.lit(f":{seed}"))).alias("d"), x.alias("l")))
    chosen = F.transform(F.slice(F.array_sort(ranked), 1, n), lambda s: F.struct(s["l"].alias("label"), F.lit(0).alias("labels")))
    return own.select(key, F.explode(F.concat(F.array(F.struct(F.col(label).alias("label"), F.lit(1).alias("labels"))), chosen)).alias("p")).select(key, F.col("p.label").alias(label), "p.labels")


def hard_negatives(hits: DataFrame, positives: DataFrame, query: str, item: str, n: int, where: str = "head", rank: str = "rank", seed: int = 0) -> DataFrame:
    """Retrieved candidates that are no positives: the best ``n``, or drawn from the ``head`` or ``tail`` half, or ``both``."""
    rest = hits.join(positives.select(query, item), [query, item], "left_anti")
    w = Window.partitionBy(query)
    placed = rest.withColumn("__c", F.count("*").over(w)).withColumn("__r", F.row_number().over(w.orderBy(rank)))
    head = F.col("__r") * 2 <= F.col("__c")
    side = {"head": F.col("__r"), "tail": -F.col("__r"), "both": F.when(head, F.col("__r")).otherwise(F.col("__c") - F.col("__r") + 1)}[where]
    return placed.withColumn("__k", F.row_number().over(w.orderBy(side, F.col(item).cast("string")))).where(F.col("__k") <= n).drop("__c", "__r", "__k")


def soft_labels(df: DataFrame, entity: str) -> DataFrame:
    """``df`` with ``label`` = 1 / number of rows of the entity; null for a null entity."""
    sizes = df.groupBy(entity).agg((1 / F.count("*")).alias("label"))
    return split_join(df, sizes, entity, "left")


def positive_pairs(names: DataFrame, entity: str, name: str) -> DataFrame:
    """``(entity, a, b)``: all pairs of different names of one entity, ascending; the pairs are the result asked for."""
    a, b = names.select(entity, F.col(name).alias("a")).distinct(), names.select(entity, F.col(name).alias("b")).distinct()
    return split_join(a, b, entity, block=GROUP_BLOCK).where("a < b").select(entity, "a", "b")


def self_pairs(df: DataFrame, text: str) -> DataFrame:
    """``(a, b, label)``: each different text that isn't empty paired with itself, label 1; a model's dropout tells the two apart."""
    said = df.where(F.col(text) != "").select(F.col(text).alias("a")).distinct()
    return said.select("a", F.col("a").alias("b"), F.lit(1).alias("label"))


def fake_pairs(queries: DataFrame, dictionary: DataFrame, positives: DataFrame, query: str, entry: str) -> DataFrame:
    """All query-entry pairs that are no positives; the dictionary's size is checked before it is broadcast."""

    pairs = queries.select(query).distinct().join(broadcast_if_small(dictionary.select(entry).distinct()), F.lit(True))
    return pairs.join(positives.select(query, entry), [query, entry], "left_anti")


def one_hot(values: Column, labels: Sequence) -> Column:
    """0 or 1 for each label in its order."""
    return F.transform(F.array(*map(F.lit, labels)), lambda x: F.coalesce(F.array_contains(values, x), F.lit(False)).cast("int"))


def label_map(df: DataFrame, label: str, by_frequency: bool = True) -> DataFrame:
    """``(label, number)`` from 0, by falling frequency then name, or by name."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    order = [F.desc("n"), F.asc(label)] if by_frequency else [F.asc(label)]
    # Sorted over tasks; a row's number is that of its task's first row and its place there.
    placed = cut(counts.orderBy(*order).select(label, F.spark_partition_id().alias("__p"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("__i")))
    sizes = placed.groupBy("__p").agg(F.count("*").alias("__n"))
    begin = sizes.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__b"))
    return placed.join(F.broadcast(begin), "__p").select(label, (F.col("__b") + F.col("__i")).cast("int").alias("number"))


def validate(df: DataFrame, texts: Sequence[str], labels: Sequence[str] = ()) -> DataFrame:
    """One row of faults: nulls and empty texts, labels that are no integers."""
    checks = [F.count_if(F.col(c).isNull()).alias(f"{c}_null") for c in (*texts, *labels)]
    checks += [F.count_if(F.trim(F.col(c)) == "").alias(f"{c}_empty") for c in texts]
    checks += [F.count_if(F.col(c).isNotNull() & F.col(c).cast("string").try_cast("bigint").isNull()).alias(f"{c}_no_int") for c in labels]
    return df.agg(F.count("*").alias("rows"), *checks)


def clean_claims(df: DataFrame, text: str = "claim_text", number: str = "claim_num", reference: str = "claim_ref_pre", kind: str = "claim_class_pre", keys: Sequence[str] = ("main_id", "claim_num")) -> DataFrame:
    """Claims fit for training: no repeated keys, a leading number in the text that agrees, a reference for each dependent one; the number in front of the text."""
    lead = F.regexp_extract(text, r"^(\d*)", 1)
    once = df.join(df.groupBy(*keys).agg(F.count("*").alias("__n")).where("__n = 1").drop("__n"), list(keys), "left_semi")
    sound = once.where(F.col(text).isNotNull() & ((lead == "") | (lead == F.col(number).cast("string")))).where((F.coalesce(F.col(kind) != "D", F.lit(True))) | (F.trim(F.coalesce(reference, F.lit(""))) != ""))
    return sound.withColumn(text, F.when(lead == "", F.concat(F.col(number).cast("string"), F.lit(". "), F.col(text))).otherwise(F.col(text)))


def parent_pairs(df: DataFrame, key: str, number: str, references: str) -> DataFrame:
    """``(key, number, parent, label)``: listed references 1; the other claims before it, and references that are none, 0."""
    before = F.when(F.col(number) > 1, F.sequence(F.lit(1), F.col(number) - 1)).otherwise(F.array().cast("array<int>"))
    listed = F.coalesce(F.col(references), F.array().cast("array<int>"))
    odd = F.array_union(F.array_except(before, listed), F.array_except(listed, before))
    pairs = F.concat(F.transform(F.array_distinct(listed), lambda x: F.struct(x.alias("parent"), F.lit(1).alias("label"))), F.transform(odd, lambda x: F.struct(x.alias("parent"), F.lit(0).alias("label"))))
    return df.select(key, number, F.explode(pairs).alias("p")).select(key, number, "p.parent", "p.label")


def triplets(pairs: DataFrame, edges: DataFrame, anchor: str, positive: str, names: DataFrame) -> DataFrame:
    """``(anchor, positive, negative)``: the negative is the name of the positive's first parent; without a parent no triplet."""
    first = edges.groupBy("child").agg(F.min("parent").alias("parent"))
    return pairs.join(first, pairs[positive] == first["child"]).join(names.select(F.col("term").alias("parent"), F.col("name").alias("negative")), "parent").select(anchor, positive, "negative").distinct()


def hierarchy_negatives(names: DataFrame, closed: DataFrame, aunt_rows: DataFrame) -> DataFrame:
    """``(term, name, label)``: own names 1; names of descendants and of siblings of ancestors 0."""
    own = names.select("term", "name", F.lit(1).alias("label"))
    low = closed.select(F.col("ancestor").alias("x"), F.col("descendant").alias("term")).join(names, "term").select(F.col("x").alias("term"), "name", F.lit(0).alias("label"))
    side = aunt_rows.select(F.col("node").alias("x"), F.col("aunt").alias("term")).join(names, "term").select(F.col("x").alias("term"), "name", F.lit(0).alias("label"))
    return own.unionByName(low).unionByName(side).groupBy("term", "name").agg(F.max("label").alias("label"))


def settle_contradictions(df: DataFrame, text: str, label: str) -> DataFrame:
    """Texts that carry different labels are labelled 1 throughout."""
    torn = df.groupBy(text).agg(F.min(label).alias("__lo"), F.max(label).alias("__hi")).where("__lo <> __hi").select(text, F.lit(True).alias("__torn"))
    out = split_join(df, torn, text, "left")
    return out.withColumn(label, F.when(F.col("__torn"), F.lit(1)).otherwise(F.col(label))).select(*df.columns)


def shuffle(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """``df`` in the order of its draws."""
    return df.orderBy(draw(key, seed), key)


def group_slice(df: DataFrame, group: str, first: int, count: int) -> DataFrame:
    """The rows of groups ``first`` … ``first + count - 1`` (from 0) in the order of the group's value: to go on where a run stopped."""
    kept = df.select(group).distinct().orderBy(group).offset(first).limit(count)
    return df.join(kept, group, "left_semi")


def append_version(old: DataFrame, new: DataFrame, keys: Sequence[str], label: str, mapping: Mapping[str, str] | None = None) -> DataFrame:
    """Old and new rows together, the new ones winning by key, labels mapped anew."""
    out = old.join(new.select(*keys), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)
    if not mapping:
        return out
    lookup = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return out.withColumn(label, F.coalesce(F.try_element_at(lookup, F.col(label)), F.col(label)))


def profile(df: DataFrame, prefix: str, text: str, target: str, nothing: str = "|") -> DataFrame:
    """Per prefix: rows, distinct texts, positives, negatives and rows of several values of a delimited target."""
    values = F.size(F.filter(F.split(F.coalesce(target, F.lit("")), r"\|"), lambda x: x != ""))
    negative = F.coalesce(F.col(target), F.lit(nothing)).isin(nothing, "")
    return df.groupBy(prefix).agg(F.count("*").alias("rows"), F.count_distinct(text).alias("texts"), F.count_if(~negative).alias("positive"), F.count_if(negative).alias("negative"), F.count_if(values > 1).alias("multiple"))


def multi_task(df: DataFrame, key: str, tasks: Mapping[str, Column], text: str, keep_null: bool = False) -> DataFrame:
    """One document to a row per task (prefix, input_text, target_text); tasks without a target fall out unless kept with ``''``."""
    rows = F.array(*[F.struct(F.lit(p).alias("prefix"), c.cast("string").alias("target_text")) for p, c in tasks.items()])
    out = df.select(key, F.col(text).alias("input_text"), F.explode(rows).alias("t")).select(key, "t.prefix", "input_text", "t.target_text")
    return out.fillna("", ["target_text"]) if keep_null else out.where("target_text is not null")


def union_datasets(frames: Sequence[DataFrame]) -> DataFrame:
    """Several datasets as one by column name, repeated rows once."""
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames).distinct()
