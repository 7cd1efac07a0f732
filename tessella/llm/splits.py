"""Train, validation and test splits that keep related records together (problem 2).

Method: random-mate contraction gives the components of records tied by a code
or an id (``tessella.operators.components``); components are laid out in one
line by weight and cut at the wanted shares.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.components import components
from tessella.plans.pairs import pairs_within, split_join

#: The splits with their shares, in order.
SHARES = (("train", 0.8), ("validation", 0.1), ("test", 0.1))
#: Pieces of the line whose weights are added up by one task.
PIECES = 4096
#: A component over this share of all rows is laid out first, so that it can't straddle the last cut.
LARGE = 0.01


def comparable_code(code: str) -> Column:
    """A patent code for comparison: upper case without blanks and hyphens; a blank one is null."""
    return F.nullif(F.upper(F.regexp_replace(F.col(code), r"[\s 　\-‐-―]", "")), F.lit(""))


def comparable_esid(esid: str) -> Column:
    """An esid for comparison: lower case without hyphens and blanks; a blank one is null."""
    return F.nullif(F.lower(F.regexp_replace(F.col(esid), r"[\s 　\-‐-―]", "")), F.lit(""))


def _codes(records: DataFrame, code: str, esid: str) -> DataFrame:
    """``(code, component)`` of every code that shares an esid with another one."""
    ties = records.select(comparable_code(code).alias("c"), comparable_esid(esid).alias("e")).where("c is not null and e is not null").distinct()
    # An esid of one code ties nothing; of several, each code is tied to the least: a star, not all pairs.
    least = ties.groupBy("e").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("e", "lo")
    edges = ties.join(least, "e").where("c <> lo").select(F.col("lo").alias("a"), F.col("c").alias("b")).distinct()
    return components(edges).select(F.col("vertex").alias("code"), "component")


def tied_codes(records: DataFrame, code: str = "patent_code", esid: str = "esid") -> DataFrame:
    """``(code_a, code_b)``: different comparable codes that must share a split. Null codes and esids tie nothing."""
    return pairs_within(_codes(records, code, esid), "component", "code", "code_a", "code_b")


def tied_groups(records: DataFrame, code: str = "patent_code", esid: str = "esid") -> DataFrame:
    """``(code, class_id, links)`` of each comparable code that is tied to another one: its component, and with how many others it must share a split."""
    codes = _codes(records, code, esid)
    sizes = codes.groupBy("component").agg((F.count("*") - 1).alias("links"))
    return split_join(codes, sizes, "component").select("code", F.col("component").alias("class_id"), "links")


def assign_splits(records: DataFrame, key: str = "claim_id", code: str = "patent_code", esid: str = "esid", shares: tuple = SHARES) -> DataFrame:
    """``(key, split)`` of every row; rows tied by code or esid, directly or through others, share a split.

    A row's group is its code's component; without a code its esid's; with
    neither the row itself. Groups are laid out in hash order (large ones
    first) and cut by their cumulative weight in rows, each group going to the
    split in which its middle falls. Cumulation is by pieces of the line, so no
    task sorts all groups. A null key is kept as it is.
    """
    codes = _codes(records, code, esid)
    rows = records.select(F.col(key), comparable_code(code).alias("c"), comparable_esid(esid).alias("e"))
    # Hot codes, and rows without a code or an esid, are dealt over tasks.
    rows = split_join(rows, codes.withColumnRenamed("code", "c"), "c", "left").withColumn("g", F.coalesce("component", "c"))
    by_esid = rows.where("g is not null and e is not null").groupBy("e").agg(F.min("g").alias("eg"))
    rows = split_join(rows.withColumn("e", F.when(F.col("g").isNull(), F.col("e"))), by_esid, "e", "left")
    own = F.concat(F.lit("#row "), F.coalesce(F.col(key).cast("string"), F.lit("")))
    rows = rows.select(key, F.coalesce(F.col("g"), F.col("eg"), F.concat(F.lit("#e "), F.col("e")), own).alias("g"))
    groups = rows.groupBy("g").agg(F.count("*").alias("w"))
    total = groups.agg(F.sum("w").alias("total"))
    line = groups.crossJoin(F.broadcast(total)).withColumn("piece", F.when(F.col("w") > LARGE * F.col("total"), -1).otherwise(F.pmod(F.xxhash64("g"), F.lit(PIECES)).cast("int")))
    pieces = line.groupBy("piece").agg(F.sum("w").alias("pw"))
    before = pieces.select("piece", (F.sum("pw").over(Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, 0)) - F.col("pw")).alias("offset"))
    inside = Window.partitionBy("piece").orderBy(F.desc("w"), F.xxhash64("g", F.lit(1)), "g").rowsBetween(Window.unboundedPreceding, 0)
    placed = line.withColumn("upto", F.sum("w").over(inside)).join(F.broadcast(before), "piece").withColumn("middle", (F.col("offset") + F.col("upto") - F.col("w") / 2) / F.col("total"))
    split, passed = F.lit(shares[-1][0]), sum(s for _, s in shares)
    for name, share in reversed(shares[:-1]):
        passed -= shares[[n for n, _ in shares].index(name) + 1][1]
        split = F.when(F.col("middle") < passed, name).otherwise(split)
    return rows.join(placed.select("g", split.alias("split")), "g").select(key, "split")
