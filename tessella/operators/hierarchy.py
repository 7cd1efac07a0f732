"""Parent-child rows to full hierarchies (problem 6).

Method: level-wise frontier joins from the roots extend paths and depths;
ancestor pairs taken from the paths count descendants; nodes that no frontier
reaches lie on a circle or below one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.packed import first_number
from tessella.plans.runtime import cut, read_cut, write_cut

#: A frontier of at most so many rows is broadcast to the nodes that remain; a larger one is shuffled.
FRONTIER_ROWS = 20_000


def hierarchy(nodes: DataFrame, scope: str = "scope", node: str = "node", parent: str = "parent") -> DataFrame:
    """``(scope, node, root, depth, path, n_desc)`` of each distinct node of a scope.

    ``nodes`` has one row per (scope, node), both non-null; a null parent, or
    one absent from the scope, makes a root. On a circle or below one, root is
    null, depth and n_desc -1 and path ''.
    """
    rows = cut(nodes.select(F.col(scope).alias("s"), F.col(node).alias("n"), F.col(parent).alias("p")))
    present = rows.select("s", F.col("n").alias("p"), F.lit(True).alias("there"))
    linked = rows.where("p is not null").join(present, ["s", "p"], "left")
    roots = rows.where("p is null").select("s", "n").unionByName(linked.where("there is null").select("s", "n"))
    below = cut(linked.where("there").select("s", "n", "p"))
    spark = nodes.sparkSession
    frontier = roots.select("s", "n", F.col("n").alias("root"), F.lit(0).alias("depth"), F.col("n").cast("string").alias("path"))
    paths = [write_cut(frontier)]
    frontier = read_cut(spark, paths, frontier)
    remaining, fresh, gone = below.count(), 0, 1
    left = below
    while (many := frontier.count()) > 0:
        fresh += many if len(paths) > 1 else 0
        if 2 * fresh > remaining:
            # Half of what the frontiers are joined with has been reached: it is written anew without that.
            left = cut(left.join(read_cut(spark, paths[gone:], frontier).select("s", "n"), ["s", "n"], "left_anti"))
            remaining, fresh, gone = remaining - fresh, 0, len(paths)
        if remaining == 0:
            break
        ahead = frontier.select("s", F.col("n").alias("p"), "root", "depth", "path")
        step = left.join(F.broadcast(ahead) if many <= FRONTIER_ROWS else ahead, ["s", "p"])
        step = step.select("s", "n", "root", (F.col("depth") + 1).alias("depth"), F.concat_ws("/", "path", F.col("n").cast("string")).alias("path"))
        paths.append(write_cut(step))
        frontier = read_cut(spark, paths[-1:], frontier)
    levels = read_cut(spark, paths, frontier)
    kind = nodes.schema[node].dataType
    above = F.slice(F.split("path", "/"), F.lit(1), F.col("depth"))
    counts = levels.where("depth > 0").select("s", F.explode(F.transform(above, lambda x: x.cast(kind))).alias("n")).groupBy("s", "n").agg(F.count("*").alias("n_desc"))
    reached = levels.join(counts, ["s", "n"], "left").select("s", "n", "root", "depth", "path", F.coalesce("n_desc", F.lit(0)).alias("n_desc"))
    # What has a parent but was not reached; roots always are.
    circling = left.join(levels.where("depth > 0").select("s", "n"), ["s", "n"], "left_anti").select("s", "n", F.lit(None).cast(kind).alias("root"), F.lit(-1).alias("depth"), F.lit("").alias("path"), F.lit(-1).cast("bigint").alias("n_desc"))
    out = reached.unionByName(circling)
    return out.select(F.col("s").alias(scope), F.col("n").alias(node), "root", "depth", "path", "n_desc")


def claim_trees(claims: DataFrame) -> DataFrame:
    """``(code, claim_num, root_num, depth, path, n_desc)`` of the claims of each patent.

    Rows with a null code or number are left out. Of repeated rows of one claim
    the one of least claim_id gives the parent.
    """
    code = F.nullif(F.upper(F.regexp_replace("patent_code", r"[\s 　\-‐-―]", "")), F.lit(""))
    rows = claims.select("claim_id", code.alias("scope"), F.col("claim_num").alias("node"), first_number(F.col("claim_ref_pre")).alias("parent")).where("scope is not null and node is not null")
    one = rows.groupBy("scope", "node").agg(F.min_by("parent", "claim_id").try_cast("int").alias("parent"))
    out = hierarchy(one)
    return out.select(F.col("scope").alias("code"), F.col("node").alias("claim_num"), F.coalesce("root", F.lit(-1)).alias("root_num"), "depth", "path", F.col("n_desc").cast("int").alias("n_desc"))
