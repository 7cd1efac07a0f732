"""Joins, set operations, windows and reshaping beyond what a plain method call says."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.plans.query import order_columns

WEEK_MS = 7 * 24 * 3600 * 1000


def natural_join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Equi-join on all columns that both sides have."""
    shared = [c for c in left.columns if c in right.columns]
    if not shared:
        raise ValueError("no column in common")
    return left.join(right, shared, how)


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "full_outer") -> DataFrame:
    """Join in which missing keys meet each other; other columns must differ by name."""
    a, b = left.alias("a"), right.alias("b")
    condition = functools.reduce(lambda x, y: x & y, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    return a.join(b, condition, how).select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys], *[F.col(f"a.{c}") for c in left.columns if c not in keys], *[F.col(f"b.{c}") for c in right.columns if c not in keys])


def coalesce_update(left: DataFrame, checked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``left`` with the non-null values of ``checked`` put over its own, by key; keys of ``checked`` are unique."""
    updated = [c for c in left.columns if c in checked.columns and c not in keys]
    renamed = checked.select(*keys, *[F.col(c).alias(f"__{c}") for c in updated])
    joined = left.join(renamed, list(keys), "left")
    return joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in updated else F.col(c) for c in left.columns])


def outer_fold(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Full outer join of several frames on the same keys."""
    return functools.reduce(lambda a, b: a.join(b, list(keys), "full_outer"), frames)


def one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join; a key that repeats on either side is an error when the rows are read."""
    def single(df: DataFrame, side: str) -> DataFrame:
        counted = df.withColumn("__n", F.count("*").over(Window.partitionBy(*keys)))
        return counted.withColumn("__ok", F.when(F.col("__n") > 1, F.raise_error(F.lit(f"a key repeats on the {side} side"))).otherwise(F.lit(True))).where("__ok").drop("__n", "__ok")

    return single(left, "left").join(single(right, "right"), list(keys))


def label_cross(texts: DataFrame, labels: DataFrame, own: str, label: str = "label") -> DataFrame:
    """Each text with each label and whether it is among the text's own (1 or 0).

    ``labels`` is a dimension of label names; the product is the result asked
    for, and its small side travels by broadcast behind a check of its size.
    """
    from tessella.plans.runtime import broadcast_if_small

    return texts.join(broadcast_if_small(labels.select(label)), F.lit(True)).withColumn("labels", F.array_contains(own, F.col(label)).cast("int"))


def contains_join(texts: DataFrame, entries: DataFrame, text: str, entry: str) -> DataFrame:
    """Pairs of texts and dictionary entries that occur in them, with the columns of both.

    An automaton passes over each different text once per block of the
    dictionary, so no side is compared with all of the other. Null and empty
    texts and entries match nothing.
    """
    from tessella.operators.dictionary import occurrences
    from tessella.plans.pairs import split_join

    found = occurrences(texts.select(F.col(text).alias("__t")).distinct(), entries, "__t", "__t", entry).select("__t", F.col("entry").alias("__e")).distinct()
    met = split_join(texts.withColumn("__t", F.col(text)), found, "__t").drop("__t")
    return split_join(met, entries.withColumn("__e", F.col(entry)), "__e").drop("__e")


def within_window(events: DataFrame, others: DataFrame, on: Sequence[str], time: str, other_time: str, back: int = WEEK_MS, ahead: int = WEEK_MS) -> DataFrame:
    """Equi-join plus an open time window: ``other_time`` strictly within (time - back, time + ahead).

    A row without a time takes every candidate of its keys; a candidate
    without one falls out. Times are epoch milliseconds. Both sides are
    bucketed by the window's width, so that a hot key is cut by time.
    """
    width = back + ahead
    left = events.withColumn("__b", F.explode(F.when(F.col(time).isNotNull(), F.sequence(F.floor((F.col(time) - back) / width), F.floor((F.col(time) + ahead) / width))).otherwise(F.array(F.lit(None).cast("bigint")))))
    right = others.where(F.col(other_time).isNotNull()).withColumn("__b", F.floor(F.col(other_time) / width))
    timed = left.where("__b is not null").join(right, [*on, "__b"]).where((F.col(other_time) > F.col(time) - back) & (F.col(other_time) < F.col(time) + ahead))
    timeless = left.where("__b is null").drop("__b").join(right.drop("__b"), list(on))
    return timed.drop("__b").unionByName(timeless)


def as_of(left: DataFrame, right: DataFrame, on: Sequence[str], time: str, right_time: str, values: Sequence[str]) -> DataFrame:
    """For each left row the right row of the same keys that is latest at or before it; without one, nulls."""
    marked = left.withColumn("__side", F.lit(1)).select(*left.columns, "__side", *[F.lit(None).cast(right.schema[v].dataType).alias(f"__{v}") for v in values], F.col(time).alias("__t"))
    other = right.select(*on, F.lit(0).alias("__side"), *[F.col(v).alias(f"__{v}") for v in values], F.col(right_time).alias("__t"))
    both = marked.unionByName(other, allowMissingColumns=True)
    # One sort per key in time; the packed struct keeps a right row's nulls together with its values.
    w = Window.partitionBy(*on).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    packed = F.last(F.when(F.col("__side") == 0, F.struct(*[F.col(f"__{v}").alias(v) for v in values])), ignorenulls=True).over(w)
    return both.withColumn("__last", packed).where("__side = 1").select(*left.columns, *[F.col(f"__last.{v}").alias(v) for v in values])


def first_per_key(df: DataFrame, keys: Sequence[str], orders: Sequence, most: int = 1) -> DataFrame:
    """The first rows of each key by an explicit order, missing last."""
    w = Window.partitionBy(*keys).orderBy(*order_columns(orders))
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= most).drop("__r")


def islands(df: DataFrame, keys: Sequence[str], number: str) -> DataFrame:
    """``(keys, lo, hi)``: the runs of consecutive numbers of each key."""
    w = Window.partitionBy(*keys).orderBy(number)
    runs = df.select(*keys, number).distinct().withColumn("__i", F.col(number) - F.row_number().over(w))
    return runs.groupBy(*keys, "__i").agg(F.min(number).alias("lo"), F.max(number).alias("hi")).drop("__i")


def overlap_counts(members: DataFrame, key: str, group: str) -> DataFrame:
    """``(groups, n)``: how many keys are in exactly each set of groups."""
    sets = members.select(key, group).distinct().groupBy(key).agg(F.array_join(F.sort_array(F.collect_set(group)), "&").alias("groups"))
    return sets.groupBy("groups").agg(F.count("*").alias("n"))


def drop_contained(array: Column) -> Column:
    """The members of a string array that are in no other, different member."""
    return F.filter(array, lambda x: ~F.exists(array, lambda y: (y != x) & F.contains(y, x)))


def drop_token_subsets(array: Column) -> Column:
    """The members whose tokens (by blanks) aren't all among another, different member's tokens."""
    split = lambda x: F.split(x, " ")
    return F.filter(array, lambda x: ~F.exists(array, lambda y: (y != x) & (F.size(F.array_except(split(x), split(y))) == 0) & ((F.size(split(y)) > F.size(split(x))) | (y < x))))


def union_all(*frames: DataFrame) -> DataFrame:
    """All rows, by column name; columns that a frame lacks are null."""
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def resolve_ids(df: DataFrame, column: str, dimension: DataFrame, id_column: str, name_column: str) -> DataFrame:
    """``column`` with an id replaced by its name; what is no id stays, null stays null."""
    from tessella.plans.runtime import broadcast_if_small

    names = dimension.select(F.col(id_column).alias("__id"), F.col(name_column).alias("__name"))
    return df.join(broadcast_if_small(names), F.col(column) == F.col("__id"), "left").withColumn(column, F.coalesce("__name", column)).drop("__id", "__name")


def first_source(keys: DataFrame, key: str, sources: Sequence[DataFrame], value: str) -> DataFrame:
    """``(key, value)``: the first non-null value of the sources in their order; keys of a source are unique."""
    out = keys.select(key).distinct()
    for i, s in enumerate(sources):
        out = out.join(s.select(key, F.col(value).alias(f"__{i}")), key, "left")
    return out.select(key, F.coalesce(*[F.col(f"__{i}") for i in range(len(sources))]).alias(value))
