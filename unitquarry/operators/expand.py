"""Widen ranked matches along the call graph, both ways, to a set depth.

Discovery is breadth-first: nodes of a level come in the order of their
parents, and under one parent first what it calls, then what calls it, each by
id.  Parent position and direction fit one number, so "first discovery wins"
is a plain minimum with map-side combine: a hub reached from many nodes shrinks
before it is shuffled, and the answer does not depend on the partitioning.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import ExitStack, contextmanager

from pyspark.sql import DataFrame, functions as F

from .. import runtime

CALLS, CALLED_BY = 0, 1

EXPANDED = ("query_id", "pos", "id", "score", "relationship", "expansion_depth")


def check_depth(depth: int) -> int:
    """Depth below one counts as one; anything but a number is an error."""
    if isinstance(depth, bool) or not isinstance(depth, (int, float)) or depth != depth:
        raise ValueError(f"depth must be a number, got {depth!r}")
    return max(1, int(depth // 1))


def adjacency(edges: DataFrame) -> DataFrame:
    """``src, dst, direction`` for both directions of every edge."""
    calls = edges.select(
        F.col("caller_id").alias("src"), F.col("callee_id").alias("dst"), F.lit(CALLS).alias("direction"))
    called_by = edges.select(
        F.col("callee_id").alias("src"), F.col("caller_id").alias("dst"), F.lit(CALLED_BY).alias("direction"))
    return calls.unionByName(called_by)


@contextmanager
def stored_links(links: DataFrame) -> Iterator[DataFrame]:
    """``links`` written once, in buckets of ``src``: joins on it leave them where they are.

    The files lie in the checkpoint folder; the table's name is gone afterwards.
    """
    spark = links.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"unitquarry_links_{uuid.uuid4().hex}"
    try:
        # One task, and so one file, per bucket.
        links.repartition(buckets, "src").write.bucketBy(buckets, "src").sortBy("src").option(
            "path", f"{runtime.checkpoint_folder(spark)}/{name}").saveAsTable(name)
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def meet(links: DataFrame, frontier: DataFrame, hot: list[int]) -> DataFrame:
    """Join of stored links and a large frontier on ``src``: only the frontier, and links of hot nodes, are moved."""
    buckets = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if not hot:
        return links.join(frontier.repartition(buckets, "src"), "src")
    is_hot = F.xxhash64("src").isin(*hot)
    cold = links.filter(~is_hot).join(frontier.filter(~is_hot).repartition(buckets, "src"), "src")
    return cold.unionByName(runtime.skew_join(links.filter(is_hot), frontier.filter(is_hot), ["src"], "inner", F.col("dst"), hot))


def expand(results: DataFrame, edges: DataFrame, units: DataFrame, depth: int = 1) -> DataFrame:
    """Matches first, then everything within ``depth`` calls of them.

    ``results`` has ``query_id, pos, id, score``.  Returns those columns and
    ``relationship, expansion_depth``, both NULL for the matches.  Found units
    have score 0 and the relationship to the unit they were found from.  An
    edge to a unit that is not in ``units`` leads nowhere.
    """
    depth = check_depth(depth)
    with ExitStack() as stack:
        return _expand(results, adjacency(edges), units, depth, lambda links: stack.enter_context(stored_links(links)))


def _expand(results: DataFrame, links: DataFrame, units: DataFrame, depth: int, store: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``expand`` over both directions of the edges; ``store`` gives them in buckets.  What is returned reads written tables only."""
    stored = None
    ids = units.select("id")
    # The ranking is used several times below; write it once.
    level = runtime.cut(results.select("query_id", F.col("pos").cast("bigint").alias("pos"), "id", "score"))
    seen = level.withColumns({
        "relationship": F.lit(None).cast("string"), "expansion_depth": F.lit(None).cast("int")})
    for step in range(1, depth + 1):
        frontier = level.select("query_id", F.col("id").alias("src"), "pos")
        # Only the edges of the frontier are needed.  A frontier of checked size
        # goes to the edges, which then stay where they are.  For a larger one
        # they are dealt once by node, if more rounds may need that again.
        if runtime.is_small(frontier):
            met = links.join(F.broadcast(frontier), "src")
        else:
            if stored is None and step < depth:
                stored = store(links)
                [hot] = runtime.hot_keys(stored, ["src"])
            if stored is not None:
                met = meet(stored, frontier, hot)
            else:
                met = runtime.skew_join(links, frontier, ["src"], "inner", F.col("dst"), runtime.hot_keys(links, ["src"])[0])
        code = F.col("pos") * 2 + F.col("direction")
        found = (
            met.select("query_id", F.col("dst").alias("id"), code.alias("code"))
            .groupBy("query_id", "id").agg(F.min("code").alias("code"))
            .join(seen.select("query_id", "id"), ["query_id", "id"], "left_anti"))
        found = runtime.cut(found)
        # A hub may be found for a large share of all queries.
        rows, [hubs] = runtime.key_profile(found, ["id"])
        if rows == 0:
            break
        found = runtime.skew_join(found, ids, ["id"], "left_semi", F.col("query_id"), hubs)
        before = seen.groupBy("query_id").agg(F.max("pos").alias("before"))
        ranked = runtime.number_rows(found, "query_id", ["code", "id"], rows, into="rank")
        # Settled before it is used twice, so no later step ranks it again.
        level = runtime.cut(runtime.lookup_join(ranked, before, ["query_id"], "inner", F.col("id")).select(
            "query_id", (F.col("before") + F.col("rank")).alias("pos"), "id", "code"))
        seen = seen.unionByName(level.select(
            "query_id", "pos", "id", F.lit(0.0).alias("score"),
            F.when(F.col("code") % 2 == CALLS, "calls").otherwise("called-by").alias("relationship"),
            F.lit(step).alias("expansion_depth")))
    return seen.select(*EXPANDED)
