"""Prefix trie of conversations by the Euler-tour technique.

Every different sequence of first turns is a node.  A node is named by the
smallest conversation that starts with it and by its depth, which no other
node shares.  The tour has an enter and an exit arc per node; each arc knows
the next one from a lookup: the first child, the next sibling or the parent.
The list of arcs is ranked by repeated contraction, and the sums of a subtree
are the difference of the prefix sums at its two arcs.

Only hashes, ids and lengths are shuffled, never texts.  Turns of one
conversation, children of one node and copies of one conversation may each be
a large share of all rows: positions and prefixes are numbered by range parts
(``running``), children are chained in groups of about ``SIBLINGS``, and the
list has one successor per arc, so ranking it has no hot key.

A null role or text counts as empty.  Rows without ``conv_id`` belong to no
conversation and are left out.  Turns with equal numbers are ordered by a hash
of role and text; repeated rows are turns of their own.  Long texts are only
hashed and measured.  An empty table has no nodes.  Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from unitquarry import runtime
from unitquarry.llm.common import written
from unitquarry.runtime import cut

# Children of a node that are chained in one group.
SIBLINGS = 10_000

# Arcs that one task may rank; longer lists are contracted first.
LIST_ARCS = 20_000

# Bytes of ids that are joined before they are hashed.
CHUNK = 1 << 16

# Weights of an arc that are summed along the tour.
SUMS = ("leaves", "saved")


def running(df: DataFrame, group: Sequence[str], order: Sequence[str], made: dict[str, tuple]) -> DataFrame:
    """Running aggregates over every group in the given order, the own row included.

    ``made`` has for each new column an aggregate of the rows (a function of a
    column name) and the column that it reads.  The aggregate must combine its
    own results.  Rows are range-partitioned, and each part adds the total of
    the parts before it, so no task ever holds a whole group.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(df.repartitionByRange(parts, *group, *order).withColumn("_part", F.spark_partition_id()))
    totals = placed.groupBy(*group, "_part").agg(*[f(c).alias(f"_total_{n}") for n, (f, c, _) in made.items()])
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*group, "_part", *[f(f"_total_{n}").over(before).alias(f"_before_{n}") for n, (f, _, _) in made.items()])
    inside = Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = placed.select("*", *[f(c).over(inside).alias(f"_local_{n}") for n, (f, c, _) in made.items()])
    joined = local.join(totals, [*group, "_part"])
    return joined.select(*df.columns, *[
        F.when(F.col(f"_before_{n}").isNull(), F.col(f"_local_{n}")).otherwise(plus(F.col(f"_before_{n}"), F.col(f"_local_{n}"))).alias(n)
        for n, (_, _, plus) in made.items()])


def _add(a: Column, b: Column) -> Column:
    return a + b


def _xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations: their turns ``c, d, a, b, bytes``, and ``c, length`` of all, turnless ones too.

    Conversation ``c`` takes the first ``h`` turns of ``c - c % 5`` (all if
    fewer, none if there is no such conversation), then its own turns after
    its first ``h``; ``h`` is the unsigned crc32 of ``c`` in decimal modulo 9.
    ``a`` and ``b`` are two hashes of role and text.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    sha = F.sha2(F.concat_ws(":", F.octet_length(role).cast("string"), role, text), 256)
    rows = turns.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("c"), F.col("turn").cast("bigint").alias("turn"), sha.alias("sha"),
        F.octet_length(text).cast("bigint").alias("bytes")).select(
        "c", "turn", F.conv(F.substring("sha", 1, 16), 16, -10).cast("bigint").alias("a"),
        F.conv(F.substring("sha", 17, 16), 16, -10).cast("bigint").alias("b"), "bytes", F.lit(1).cast("bigint").alias("one"))
    placed = written(running(rows, ["c"], ["turn", "a", "b"], {"at": (F.sum, "one", _add)}).drop("one", "turn"))
    own = placed.groupBy("c").agg(F.max("at").alias("n_own"))
    h = F.pmod(F.crc32(F.col("c").cast("string").cast("binary")), F.lit(9)).cast("bigint")
    convs = own.select("c", "n_own", h.alias("h"), (F.col("c") - F.col("c") % 5).alias("base"))
    counts = own.select(F.col("c").alias("base"), F.col("n_own").alias("n_base"))
    convs = convs.join(counts, "base", "left").withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0))))
    convs = written(convs.select(
        "c", "h", "base", "taken", (F.col("taken") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))).alias("length")))
    # At most eight turns of a base go to its five conversations at either side of 0.
    heads = placed.filter(F.col("at") <= 8).withColumnRenamed("c", "base")
    copied = convs.filter(F.col("taken") > 0).select("c", "base", "taken").join(heads, "base").filter(F.col("at") <= F.col("taken"))
    copied = copied.select("c", F.col("at").alias("d"), "a", "b", "bytes")
    [hot] = runtime.hot_keys(placed, ["c"])
    kept = runtime.skew_join(placed, convs.select("c", "h", "taken"), ["c"], "inner", F.col("at"), hot).filter(F.col("at") > F.col("h"))
    kept = kept.select("c", (F.col("at") - F.col("h") + F.col("taken")).alias("d"), "a", "b", "bytes")
    return copied.unionByName(kept), convs.select("c", "length")


def _member_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in (node, c) order to rows of the ids of a stretch, joined."""
    key, first, ids, size, out = None, 0, [], 0, []

    def flush() -> None:
        if ids:
            out.append((*key, first, ",".join(ids)))

    for batch in batches:
        for c, d, x, y in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if (d, x, y) != key or size > CHUNK:
                flush()
                key, first, ids, size = (d, x, y), c, [], 0
            ids.append(str(c))
            size += len(ids[-1]) + 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in zip(*out)], ["d", "x", "y", "first", "ids"])
            out = []
    flush()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in zip(*out)], ["d", "x", "y", "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of ids in (node, first) order to one digest per node, holding one stretch at a time."""
    key, state, out = None, None, []
    for batch in batches:
        for d, x, y, ids in zip(*(batch.column(n).to_pylist() for n in ("d", "x", "y", "ids"))):
            if (d, x, y) != key:
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = (d, x, y), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in zip(*out)], ["d", "x", "y", "ends"])
            out = []
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*key, state.hexdigest())], ["d", "x", "y", "ends"])


def end_digests(ends: DataFrame) -> DataFrame:
    """``d, x, y, ends``: SHA-256 of the ascending ids ``c`` of every node, joined by commas.

    The ids are sorted and joined into stretches by range parts.  The digest
    of a node is sequential by its definition: one task reads the node's
    stretches in order and holds one at a time.
    """
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    node = ["d", "x", "y"]
    rows = ends.select("c", *node).repartitionByRange(parts, *node, "c").sortWithinPartitions(*node, "c")
    stretches = rows.mapInArrow(_member_chunks, "d bigint, x bigint, y bigint, first bigint, ids string")
    return stretches.repartition(*node).sortWithinPartitions(*node, "first").mapInArrow(
        _digests, "d bigint, x bigint, y bigint, ends string")


def nodes_of(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """All nodes: ``d, x, y`` (depth and prefix hash), ``px, py`` (the parent's), conv_id, n_convs, bytes, ends.

    A prefix is known by two 64-bit sums without carry of hashes that hold the
    position of their turn, so prefixes need no walk along a conversation.
    """
    marked = turns.select(
        "c", "d", "bytes", F.xxhash64(F.lit(1), "d", "a", "b").alias("ex"), F.xxhash64(F.lit(2), "b", "d", "a").alias("ey"))
    steps = running(marked, ["c"], ["d"], {"x": (F.bit_xor, "ex", _xor), "y": (F.bit_xor, "ey", _xor)})
    zero = F.lit(0).cast("bigint")
    roots = convs.select("c", *[zero.alias(n) for n in ("d", "bytes", "ex", "ey", "x", "y")])
    every = written(steps.unionByName(roots))
    nodes = every.groupBy("d", "x", "y").agg(
        F.min("c").alias("conv_id"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"), F.max("ex").alias("ex"), F.max("ey").alias("ey"))
    # A conversation ends in one node: hot conversations have one row here.
    lengths = convs.select("c", F.col("length").alias("d"))
    [hot] = runtime.hot_keys(every, ["c"])
    ends = runtime.skew_join(every, lengths.withColumnRenamed("d", "last"), ["c"], "inner", F.col("d"), hot).filter(F.col("d") == F.col("last"))
    return nodes.join(end_digests(ends), ["d", "x", "y"], "left").select(
        "d", "x", "y", F.col("x").bitwiseXOR(F.col("ex")).alias("px"), F.col("y").bitwiseXOR(F.col("ey")).alias("py"), "conv_id", "n_convs",
        "bytes", F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends"))


def with_parents(nodes: DataFrame) -> DataFrame:
    """``nodes`` with parent_conv_id, n_children, first_child, and the parent's number of children as ``siblings``."""
    children = nodes.filter(F.col("d") > 0).groupBy((F.col("d") - 1).alias("d"), F.col("px").alias("x"), F.col("py").alias("y")).agg(
        F.count("*").alias("n_children"), F.min("conv_id").alias("first_child"))
    known = written(nodes.join(children, ["d", "x", "y"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    parents = known.filter(F.col("n_children") > 0).select(
        (F.col("d") + 1).alias("d"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv_id").alias("parent_conv_id"),
        F.col("n_children").alias("siblings"))
    [hot] = runtime.hot_keys(known, ["d", "px", "py"])
    return runtime.skew_join(known, parents, ["d", "px", "py"], "left", F.col("conv_id"), hot)


def next_siblings(nodes: DataFrame, siblings: int = SIBLINGS) -> tuple[DataFrame, DataFrame]:
    """``nodes`` with the next sibling's conv_id as ``sibling``; and the first child of nodes with several groups of children.

    Any order of children gives a tour: large families are dealt into groups
    by hash, each group is a chain, and the groups are chained by number.
    """
    groups = F.ceil(F.coalesce("siblings", F.lit(1)) / F.lit(siblings)).cast("bigint")
    family = ["d", "parent_conv_id"]
    dealt = nodes.withColumn("_groups", groups).withColumn("_group", F.pmod(F.xxhash64("conv_id"), F.col("_groups")))
    chained = dealt.withColumn("_next", F.lead("conv_id").over(Window.partitionBy(*family, "_group").orderBy("conv_id")))
    ends = dealt.filter(F.col("_groups") > 1).groupBy(*family, "_group").agg(F.min("conv_id").alias("_first"))
    in_turn = Window.partitionBy(*family).orderBy("_group")
    links = ends.select(*family, "_group", F.lead("_first").over(in_turn).alias("_jump"), F.first("_first").over(in_turn).alias("_start"))
    starts = links.groupBy((F.col("d") - 1).alias("d"), F.col("parent_conv_id").alias("conv_id")).agg(F.min("_start").alias("start"))
    jumps = links.filter(F.col("_jump").isNotNull()).select(*family, "_group", "_jump")
    # A large family has several groups: one row each.
    joined = runtime.lookup_join(chained, jumps, [*family, "_group"], "left", F.col("conv_id"))
    return joined.withColumn("sibling", F.coalesce("_next", "_jump")).drop("_next", "_jump", "_group", "_groups"), starts


def tour(nodes: DataFrame, siblings: int = SIBLINGS) -> DataFrame:
    """The list of arcs: ``c, at`` (twice the depth, one more on leaving), ``to_c, to_at`` of the next one, and the weights."""
    chained, starts = next_siblings(nodes, siblings)
    chained = chained.join(starts.select("d", "conv_id", "start"), ["d", "conv_id"], "left")
    enter, leave = F.col("d") * 2, F.col("d") * 2 + 1
    leaf = F.col("n_children") == 0
    first = F.coalesce("start", "first_child")
    last = F.col("sibling").isNull()
    arcs = F.array(
        F.struct(
            enter.alias("at"), F.when(leaf, F.col("conv_id")).otherwise(first).alias("to_c"), F.when(leaf, leave).otherwise(enter + 2).alias("to_at"),
            leaf.cast("bigint").alias("leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved")),
        F.struct(
            leave.alias("at"), F.when(last, F.col("parent_conv_id")).otherwise(F.col("sibling")).alias("to_c"),
            F.when(last, leave - 2).otherwise(enter).alias("to_at"), F.lit(0).cast("bigint").alias("leaves"), F.lit(0).cast("bigint").alias("saved")))
    return chained.select(F.col("conv_id").alias("c"), F.inline(arcs))


def _coin(c: str, at: str, turn: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(turn), c, at), F.lit(2)) == 1


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Prefix sums in front of every arc of a short list."""
    held = list(batches)
    if not held:
        return
    rows = pa.Table.from_batches(held)
    columns = [rows.column(n).to_pylist() for n in ("c", "at", "to_c", "to_at", *SUMS)]
    step = {(c, at): (to, weights) for c, at, to, weights in zip(columns[0], columns[1], zip(columns[2], columns[3]), zip(*columns[4:]))}
    heads = step.keys() - {to for to, _ in step.values()}
    out = []
    for now in heads:
        sums = (0,) * len(SUMS)
        while now in step:
            out.append((*now, *sums))
            now, weights = step[now]
            sums = tuple(a + b for a, b in zip(sums, weights))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*out)], ["c", "at", *SUMS])


def ranked(arcs: DataFrame, most: int = LIST_ARCS) -> DataFrame:
    """``c, at`` and the sums of all weights in front of every arc, by list ranking.

    Each round tosses a repeatable coin for every arc: an arc with tails whose
    successor has heads takes that successor over, with its weights.  A round
    joins arcs to their only successor and removes a quarter of the list in
    expectation, so all rounds together move a few times the list.  What is
    left, ``most`` arcs at the most, is walked by one task; the removed arcs
    then get their sums from the arc that took them, round by round.
    """
    arcs = written(arcs.select("c", "at", "to_c", "to_at", *SUMS))
    removed, left, turn = [], arcs.count(), 0
    key, to = ["c", "at"], ["to_c", "to_at"]
    while left > most:
        takes = ~_coin("c", "at", turn) & F.coalesce(_coin("to_c", "to_at", turn) & F.col("to_c").isNotNull(), F.lit(False))
        takers = arcs.filter(takes).select(*[F.col(c).alias(f"_{c}") for c in key], *[F.col(c).alias(k) for c, k in zip(to, key)],
                                           *[F.col(t).alias(f"_{t}") for t in SUMS])
        # Takers have tails and taken arcs heads: no arc is both.
        others = arcs.filter(~takes)
        met = written(others.join(takers, key, "left"))
        taken = met.filter(F.col("_c").isNotNull())
        merged = taken.select(F.col("_c").alias("c"), F.col("_at").alias("at"), *to, *[(F.col(t) + F.col(f"_{t}")).alias(t) for t in SUMS])
        arcs = met.filter(F.col("_c").isNull()).select(arcs.columns).unionByName(merged)
        removed.append(taken.select(*key, "_c", "_at", *[F.col(f"_{t}") for t in SUMS]))
        left -= taken.count()
        turn += 1
    schema = "c bigint, at bigint, " + ", ".join(f"{t} bigint" for t in SUMS)
    sums = written(arcs.coalesce(1).mapInArrow(_walked, schema))
    for gone in reversed(removed):
        before = sums.select(F.col("c").alias("_c"), F.col("at").alias("_at"), *[F.col(t).alias(f"_sum_{t}") for t in SUMS])
        back = gone.join(before, ["_c", "_at"]).select(*key, *[(F.col(f"_sum_{t}") + F.col(f"_{t}")).alias(t) for t in SUMS])
        sums = written(sums.unionByName(back))
    return sums


def prefix_trie(turns: DataFrame, siblings: int = SIBLINGS, most: int = LIST_ARCS) -> DataFrame:
    """All nodes of the rebuilt conversations of ``turns`` (conv_id, turn, role, text).

    ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256`` as the contract of the query names them; the
    root's ``parent_conv_id`` is null.
    """
    nodes = written(with_parents(nodes_of(*rebuilt_turns(turns))))
    sums = ranked(tour(nodes, siblings), most)
    at = lambda leave, c: F.max(F.when(F.col("at") % 2 == leave, F.col(c)))
    inside = sums.groupBy(F.col("c").alias("conv_id"), F.floor(F.col("at") / 2).cast("bigint").alias("d")).agg(
        (at(1, "leaves") - at(0, "leaves")).alias("n_leaves"), (at(1, "saved") - at(0, "saved")).alias("saved_tokens"))
    return nodes.join(inside, ["conv_id", "d"]).select(
        "conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.col("ends").alias("ends_sha256"))
