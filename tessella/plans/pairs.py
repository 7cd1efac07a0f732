"""Equi-joins whose hot keys are dealt over tasks: of two tables, and of the members of a group with each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.plans.runtime import broadcast_if_small, bytes_of

#: Estimated bytes of a right side that travels whole: then nothing is shuffled, and no key is hot.
SMALL = 8 << 20
#: Rows of one key that one task of ``split_join`` takes on its left side.
KEY_BLOCK = 20_000
#: Members of one group that one task takes on its left side.
GROUP_BLOCK = 2000


def pairs_within(members: DataFrame, group: str, key: str, as_a: str, as_b: str) -> DataFrame:
    """``(as_a, as_b)`` with ``as_a < as_b`` for all different keys that share a group; groups of one fall out before the join."""
    rows = members.where(F.col(group).isNotNull() & F.col(key).isNotNull()).select(F.col(group).alias("g"), F.col(key).alias("k")).distinct()
    sizes = rows.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g", F.ceil(F.col("n") / GROUP_BLOCK).cast("int").alias("blocks"))
    kept = rows.join(sizes, "g")
    left = kept.select("g", F.col("k").alias("a"), F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int").alias("block"))
    right = kept.select("g", F.col("k").alias("b"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    return left.join(right, ["g", "block"]).where("a < b").select(F.col("a").alias(as_a), F.col("b").alias(as_b)).distinct()


def split_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", block: int = KEY_BLOCK) -> DataFrame:
    """``left`` joined with ``right`` on ``key``, inner or left; a key with over ``block`` left rows is dealt over tasks, its right rows going to each.

    A small right side is broadcast instead, behind a check of its size. Else only the hot keys are gathered beside: at most one for each ``block`` rows.
    A null key meets nothing, and doesn't gather its rows in one task.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"split_join does not do {how}")
    if bytes_of(right) <= SMALL:
        return left.join(F.broadcast(right), key, how)
    sizes = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > block)
    hot = sizes.select(key, F.ceil(F.col("n") / block).cast("int").alias("__blocks"))
    row = F.xxhash64(*[F.col(c) for c in left.columns if not left.schema[c].dataType.simpleString().startswith("map")])
    dealt = left.join(broadcast_if_small(hot), key, "left").withColumn("__block", F.pmod(row, F.when(F.col(key).isNull(), 1 << 20).otherwise(F.coalesce("__blocks", F.lit(1)))).cast("int")).drop("__blocks")
    copied = right.where(F.col(key).isNotNull()).join(broadcast_if_small(hot), key, "left").withColumn("__block", F.explode(F.sequence(F.lit(0), F.coalesce("__blocks", F.lit(1)) - 1))).drop("__blocks")
    return dealt.join(copied, [key, "__block"], how).drop("__block")
