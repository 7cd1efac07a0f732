"""Connected components by random-mate contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.plans.runtime import cut, read_cut, write_cut

#: Rounds after which something must be wrong: each halves the edges' ends by a quarter in expectation.
MOST_ROUNDS = 400


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(vertex, component)`` for each end of an edge; ``component`` is one of the component's vertices.

    Random mate: each round every vertex tosses a coin (a hash of vertex and
    round, so that a recomputed task tosses the same); a vertex with tails
    that has neighbours with heads contracts into the least of them. Edges are
    relabelled until none is left, then the labels are unwound by jumping over
    pointers. A star contracts in one aggregation with map-side combining, so
    a hub is no hot task of its own. Null ends and loops tie nothing, but a
    loop's vertex is returned as its own component.
    """
    # Written first: the edges are read twice, and may be costly to make.
    ends = cut(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("u"), F.col(b).alias("v")))
    vertices = ends.select(F.explode(F.array("u", "v")).alias("vertex")).distinct()
    left = cut(ends.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    spark, paths = edges.sparkSession, []
    for round_ in range(MOST_ROUNDS):
        if left.isEmpty():
            break
        heads = lambda x: (F.xxhash64(F.col(x), F.lit(round_)).bitwiseAND(1 << 20)) != 0  # noqa: E731, B023
        ways = left.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        mates = ways.where(~heads("u") & heads("v")).groupBy(F.col("u").alias("vertex")).agg(F.min("v").alias("into"))
        paths.append(write_cut(mates))
        mates = read_cut(spark, paths[-1:], mates)
        for side in ("u", "v"):
            left = left.join(mates.withColumnRenamed("vertex", side), side, "left").withColumn(side, F.coalesce("into", side)).drop("into")
        left = cut(left.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    else:
        raise RuntimeError(f"edges are left after {MOST_ROUNDS} rounds")
    if not paths:
        return vertices.select("vertex", F.col("vertex").alias("component"))
    # Unwind: every vertex was contracted once at most, into one that went later; pointers jump until they rest.
    pointers = read_cut(spark, paths, mates)
    while True:
        ahead = pointers.select(F.col("vertex").alias("into"), F.col("into").alias("further"))
        jumped = cut(pointers.join(ahead, "into", "left").select("vertex", F.coalesce("further", "into").alias("into"), F.col("further").isNotNull().alias("moved")))
        moved = not jumped.where("moved").isEmpty()
        pointers = jumped.drop("moved")
        if not moved:
            break
    return vertices.join(pointers, "vertex", "left").select("vertex", F.coalesce("into", "vertex").alias("component"))
