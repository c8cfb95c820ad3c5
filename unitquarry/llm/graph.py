"""Connected components of a large graph by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from unitquarry.runtime import cut


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (u, v): root is the component's smallest node.

    Nodes are longs; self-loops and repeated edges are harmless; no edges give
    no rows.  Each round is two shuffles of the remaining edges and ends in a
    reliable checkpoint; the number of rounds grows with the logarithm of the
    longest path.
    """
    now = cut(edges.select("u", "v").filter(F.col("u") != F.col("v")).distinct())
    mark = None
    while True:
        row = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (row["n"], row["s"]) == mark or not row["n"]:
            break
        mark = row["n"], row["s"]
        starred = _large_star(now).distinct()
        now = cut(_small_star(starred).filter(F.col("u") != F.col("v")).distinct())
    flat = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    roots = flat.select(F.col("root").alias("node"), "root").distinct()
    return flat.unionByName(roots)
