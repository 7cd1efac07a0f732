"""Hierarchies of terms with several parents: closure, pruning, inference.

Edges are rows (child, parent). Loops of edges are tolerated everywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.dictionary import containing_groups
from tessella.plans.runtime import cut


def closure(edges: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """``(descendant, ancestor, depth)`` with the least depth; nothing is its own ancestor.

    Paths double in length each round, so a chain of n needs log n rounds; a
    circle ends when no new pair appears. Null ends are no edges.
    """
    step = edges.where(F.col(child).isNotNull() & F.col(parent).isNotNull() & (F.col(child) != F.col(parent)))
    known = cut(step.select(F.col(child).alias("d"), F.col(parent).alias("a"), F.lit(1).alias("depth")).distinct())
    total = known.count()
    while total:
        longer = known.select("d", F.col("a").alias("m"), F.col("depth").alias("x")).join(known.select(F.col("d").alias("m"), "a", F.col("depth").alias("y")), "m").where("d <> a").select("d", "a", (F.col("x") + F.col("y")).alias("depth"))
        grown = cut(known.unionByName(longer).groupBy("d", "a").agg(F.min("depth").alias("depth")))
        now = grown.agg(F.count("*"), F.sum("depth")).first()
        before = known.agg(F.count("*"), F.sum("depth")).first()
        known = grown
        if tuple(now) == tuple(before):
            break
        total = now[0]
    return known.select(F.col("d").alias("descendant"), F.col("a").alias("ancestor"), "depth")


def drop_ancestors(tags: DataFrame, closed: DataFrame, key: str, term: str) -> DataFrame:
    """``tags`` (key, term) without terms of which the same key has a descendant. On a circle both stay."""
    below = tags.select(key, F.col(term).alias("descendant"))
    circle = closed.select(F.col("descendant").alias("x"), F.col("ancestor").alias("y"))
    strict = closed.join(circle, (F.col("descendant") == F.col("y")) & (F.col("ancestor") == F.col("x")), "left_anti")
    covered = below.join(strict, "descendant").select(key, F.col("ancestor").alias(term)).distinct()
    return tags.join(covered, [key, term], "left_anti")


def drop_included(tags: DataFrame, names: DataFrame, key: str, term: str, name: str = "name") -> DataFrame:
    """``tags`` without terms one of whose names is part of a name of another term of the same key."""
    pairs = containing_groups(names.select(F.col(name).alias("entry")))
    of = names.select(F.col(term).alias("t"), F.col(name).alias("n"))
    inside = pairs.join(of.select(F.col("t").alias("inner_t"), F.col("n").alias("inner")), "inner").join(of.select(F.col("t").alias("outer_t"), F.col("n").alias("outer")), "outer").where("inner_t <> outer_t").select("inner_t", "outer_t").distinct()
    covered = tags.select(key, F.col(term).alias("outer_t")).join(inside, "outer_t").select(key, F.col("inner_t").alias(term)).distinct()
    return tags.join(covered, [key, term], "left_anti")


def roots(edges: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """``(node)``: parents that are no child."""
    return edges.select(F.col(parent).alias("node")).where("node is not null").distinct().join(edges.where(F.col(parent).isNotNull()).select(F.col(child).alias("node")).distinct(), "node", "left_anti")


def siblings(edges: DataFrame, child: str = "child", parent: str = "parent", of: DataFrame | None = None) -> DataFrame:
    """``(node, sibling)``: different children of a common parent, of all nodes or those ``of`` (node). What is asked for is the pairs themselves."""
    a, b = edges.select(F.col(child).alias("node"), F.col(parent).alias("p")), edges.select(F.col(child).alias("sibling"), F.col(parent).alias("p"))
    a = a if of is None else a.join(of, "node", "left_semi")
    return a.join(b, "p").where("node <> sibling").select("node", "sibling").distinct()


def aunts(edges: DataFrame, closed: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """``(node, aunt)``: siblings of ancestors that are no ancestors themselves. Nodes without descendants, mostly the many, are paired with nobody."""
    s = siblings(edges, child, parent, closed.select(F.col("ancestor").alias("node")).distinct()).select(F.col("node").alias("ancestor"), F.col("sibling").alias("aunt"))
    found = closed.select(F.col("descendant").alias("node"), "ancestor").join(s, "ancestor").select("node", "aunt").distinct()
    return found.join(closed.select(F.col("descendant").alias("node"), F.col("ancestor").alias("aunt")), ["node", "aunt"], "left_anti").where("node <> aunt")


def edge_table(nodes: DataFrame, key: str = "id", parents: str = "parent_indication") -> DataFrame:
    """``(child, parent)`` of nodes with an array of parents."""
    return nodes.select(F.col(key).alias("child"), F.explode(parents).alias("parent")).distinct()


def name_table(nodes: DataFrame, key: str = "id", names: tuple[str, ...] = ("name", "name_en", "name_short"), synonyms: str | None = "name_synonyms") -> DataFrame:
    """``(term, name)``: all names of each node, none empty."""
    lists = [F.array(*names)] + ([F.coalesce(F.col(synonyms), F.array().cast("array<string>"))] if synonyms else [])
    return nodes.select(F.col(key).alias("term"), F.explode(F.concat(*lists)).alias("name")).where("name <> ''").distinct()


def infer_area(df: DataFrame, areas: DataFrame, province: str = "province", city: str = "city", district: str = "district") -> DataFrame:
    """Missing province and city filled in from the district or city where the area table leaves no doubt."""
    from tessella.plans.runtime import broadcast_if_small

    by_district = areas.where(F.col(district).isNotNull()).groupBy(district).agg(F.min(city).alias("__c"), F.count_distinct(province, city).alias("__n")).where("__n = 1").drop("__n")
    by_city = areas.where(F.col(city).isNotNull()).groupBy(city).agg(F.min(province).alias("__p"), F.count_distinct(province).alias("__n")).where("__n = 1").drop("__n")
    out = df.join(broadcast_if_small(by_district), district, "left").withColumn(city, F.coalesce(city, "__c")).drop("__c")
    out = out.join(broadcast_if_small(by_city), city, "left").withColumn(province, F.coalesce(province, "__p")).drop("__p")
    return out.select(*df.columns)


def area_filter(requests: DataFrame, candidates: DataFrame, key: str, k: int, rank: str = "rank") -> DataFrame:
    """The k best candidates of each request whose areas don't contradict: a level differs only if both know it."""
    both = requests.join(candidates, key)
    agree = F.lit(True)
    for level in ("province", "city", "district"):
        agree = agree & F.coalesce(F.col(level) == F.col(f"c_{level}"), F.lit(True))
    from tessella.operators.relational import first_per_key

    return first_per_key(both.where(agree), [key], [rank], k)
