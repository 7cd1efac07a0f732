"""Metric and bucket aggregations of the document store as groupBy plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.plans.query import Query, order_columns


def metric(kind: str, name: str, other: str | None = None, *, array: bool = False, percentiles: Sequence[float] = (25, 50, 75), approximate: bool = False) -> Column:
    """One metric over a field: avg, max, min, sum, value_count, count_distinct, percentiles, median, max_other, min_other.

    ``value_count`` counts values, so an array field counts its elements.
    ``max_other`` is the value of ``other`` where ``name`` is greatest, among
    rows that have one; of ties the least.
    """
    c = F.col(name)
    match kind:
        case "avg" | "max" | "min" | "sum":
            return getattr(F, kind)(c)
        case "value_count":
            return F.coalesce(F.sum(F.size(c)), F.lit(0)) if array else F.count(c)
        case "count_distinct":
            return F.approx_count_distinct(c) if approximate else F.count_distinct(c)
        case "median":
            return F.percentile_approx(c, 0.5) if approximate else F.median(c)
        case "percentiles":
            shares = [p / 100 for p in percentiles]
            return F.percentile_approx(c, shares) if approximate else F.percentile(c, F.array(*map(F.lit, shares)))
        case "max_other":
            # Of equal extremes the least other value: a struct's order would take the greatest.
            return F.min_by(other, F.when(F.col(other).isNotNull() & c.isNotNull(), F.struct(-c, F.col(other))))
        case "min_other":
            return F.min_by(other, F.when(F.col(other).isNotNull() & c.isNotNull(), F.struct(c, F.col(other))))
    raise ValueError(f"unknown metric {kind}")


def bucket_filter(name: str, include: Sequence | str | None = None, exclude: Sequence | str | None = None, partition: tuple[int, int] | None = None) -> Column:
    """Which buckets count: by list or regex, or by a partition (number, of) of the hash of the key."""
    out, c = F.lit(True), F.col(name)
    if include is not None:
        out = out & (c.rlike(f"^(?:{include})$") if isinstance(include, str) else c.isin(list(include)))
    if exclude is not None:
        out = out & ~(c.rlike(f"^(?:{exclude})$") if isinstance(exclude, str) else c.isin(list(exclude)))
    if partition:
        out = out & (F.pmod(F.xxhash64(c), F.lit(partition[1])) == partition[0])
    return out


def terms(df: DataFrame, name: str, metrics: Sequence[Column] = (), *, size: int | None = None, order: Sequence = (("doc_count", "desc"),), include: Sequence | str | None = None, exclude: Sequence | str | None = None, missing: object = None, query: Query | None = None) -> DataFrame:
    """Buckets of one field with ``doc_count`` and metrics; nulls fall out unless ``missing`` names their bucket. Ties by key."""
    rows = df.where(query.column()) if query else df
    if missing is not None:
        rows = rows.withColumn(name, F.coalesce(F.col(name), F.lit(missing)))
    rows = rows.where(F.col(name).isNotNull() & bucket_filter(name, include, exclude))
    out = rows.groupBy(name).agg(F.count("*").alias("doc_count"), *metrics)
    if size is None:
        return out
    return out.orderBy(*order_columns(order), F.asc(name)).limit(size)


def composite(df: DataFrame, names: Sequence[str], metrics: Sequence[Column] = (), *, after: Sequence | None = None, size: int | None = None, query: Query | None = None) -> DataFrame:
    """Buckets of several fields in the order of their keys, null keys dropped; a page after given key values."""
    rows = df.where(query.column()) if query else df
    out = rows.na.drop(subset=list(names)).groupBy(*names).agg(F.count("*").alias("doc_count"), *metrics)
    if after is not None:
        later = F.lit(False)
        for i, name in enumerate(names):
            same = F.lit(True)
            for k, v in zip(names[:i], after):
                same = same & (F.col(k) == F.lit(v))
            later = later | (same & (F.col(name) > F.lit(after[i])))
        out = out.where(later)
    return out.orderBy(*names).limit(size) if size is not None else out


def nested_terms(df: DataFrame, levels: Sequence[tuple[str, int]]) -> DataFrame:
    """Buckets in buckets: the ``size`` largest of each level (count, then key) within the kept bucket above."""
    names = [n for n, _ in levels]
    out = df.na.drop(subset=names).groupBy(*names).agg(F.count("*").alias("doc_count"))
    for i, (name, size) in enumerate(levels):
        above = names[:i]
        level = out.groupBy(*above, name).agg(F.sum("doc_count").alias("level_count"))
        order = [F.desc("level_count"), F.asc(name)]
        if above:
            kept = level.withColumn("r", F.row_number().over(Window.partitionBy(*above).orderBy(*order))).where(F.col("r") <= size).select(*above, name)
        else:
            kept = level.orderBy(*order).limit(size).select(name)
        out = out.join(kept, [*above, name], "left_semi")
    return out


def date_histogram(df: DataFrame, name: str, unit: str, metrics: Sequence[Column] = ()) -> DataFrame:
    """Buckets of a time field by calendar unit (column ``bucket``); null times fall out."""
    return df.where(F.col(name).isNotNull()).groupBy(F.date_trunc(unit, name).alias("bucket")).agg(F.count("*").alias("doc_count"), *metrics)


def filters(df: DataFrame, named: dict[str, Query]) -> DataFrame:
    """One row: for each named query the number of rows that match."""
    return df.agg(*[F.count_if(q.column()).alias(n) for n, q in named.items()])


def nested(df: DataFrame, array: str, keys: Sequence[str] = ()) -> DataFrame:
    """The elements of a nested array as rows, with the keys of their document (to go back to it)."""
    return df.select(*keys, F.explode(array).alias("e")).select(*keys, "e.*")


def paged(buckets: DataFrame, order: Sequence, skip: int = 0, limit: int | None = None) -> DataFrame:
    """A page of buckets in an order by counts, keys or metrics."""
    out = buckets.orderBy(*order_columns(order)).offset(skip)
    return out if limit is None else out.limit(limit)


def value_counts(df: DataFrame, name: str) -> DataFrame:
    """``(name, count, percent)`` of each value, null among them; percent of all rows."""
    counts = df.groupBy(name).agg(F.count("*").alias("count"))
    total = df.agg(F.count("*").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(name, "count", F.round(100 * F.col("count") / F.col("total"), 4).alias("percent"))


def geometric_mean(value: Column) -> Column:
    """The geometric mean of positive values."""
    return F.exp(F.avg(F.ln(value)))


def contradictory(df: DataFrame, text: str, label: str) -> DataFrame:
    """The rows whose text carries more than one label."""
    bad = df.groupBy(text).agg(F.count_distinct(label).alias("n")).where("n > 1").select(text)
    return df.join(bad, text, "left_semi")


def sound_groups(df: DataFrame, group: str, number: str) -> DataFrame:
    """The rows of groups in which no number repeats; a group with a repeated one falls out whole."""
    counts = df.groupBy(group, number).agg(F.count("*").alias("n")).groupBy(group).agg(F.max("n").alias("n")).where("n = 1").select(group)
    return df.join(counts, group, "left_semi")


def all_in_group(df: DataFrame, group: str, predicate: Column) -> DataFrame:
    """``(group, holds)``: whether the predicate holds on every row of a group."""
    return df.groupBy(group).agg(F.bool_and(F.coalesce(predicate, F.lit(False))).alias("holds"))


def ordered_concat(df: DataFrame, group: Sequence[str], value: str, position: Sequence[str], separator: str = "|", into: str = "joined") -> DataFrame:
    """The values of a group in one string, by explicit positions; null values are left out."""
    packed = F.sort_array(F.collect_list(F.struct(*position, value)))
    return df.groupBy(*group).agg(F.array_join(F.transform(packed, lambda x: x[value].cast("string")), separator).alias(into))
