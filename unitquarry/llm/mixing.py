"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source has the same expected number of copies, the
source's target over its size.  The whole part is certain.  The fractional
parts are settled by pivotal rounding: two documents meet, mass moves from one
to the other at the rate of their sizes until one of them is at 0 or 1, in a
random direction that keeps both expectations.  The words taken from the pair
do not change by it, so a source ends within one document of its target.
Documents meet in groups of bounded size; what a group leaves undecided, one
document, goes up a reduction tree whose every level is one shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from unitquarry.llm.common import attach, unit, words
from unitquarry.runtime import cut

FAN_IN = 512

# One step of the fold: `acc.held` meets `x`.  `up` is the mass the held one can gain, `down` what it can lose.
_MEET = """
transform(array(named_struct(
    'up', least(1 - acc.held.p, x.p * x.mass / acc.held.mass),
    'down', least(acc.held.p, (1 - x.p) * x.mass / acc.held.mass),
    'rate', acc.held.mass / x.mass,
    'u', {draw})),
  m -> if(m.u * (m.up + m.down) < m.down,
    if(1 - acc.held.p <= x.p * x.mass / acc.held.mass,
       named_struct('a', 1D, 'b', greatest(0D, x.p - m.up * m.rate), 'first', true),
       named_struct('a', least(1D, acc.held.p + m.up), 'b', 0D, 'first', false)),
    if(acc.held.p <= (1 - x.p) * x.mass / acc.held.mass,
       named_struct('a', 0D, 'b', least(1D, x.p + m.down * m.rate), 'first', true),
       named_struct('a', greatest(0D, acc.held.p - m.down), 'b', 1D, 'first', false))))[0]
"""


# What names a unit: rows that agree in it can stand for each other.
UNIT = ("doc_id", "source", "size", "digest")
# Rows written for one element of an array when the rows of a unit are listed.
REPEATS = 1024


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """Source, its size, number of units and target; ``sizes`` has source, size, rows.

    Targets share ``share`` of all sizes by weight.  A source stops at ``cap``
    times its size and the excess goes to the others by weight until none is
    above: with the sources ordered by cap over weight, that level is the
    largest of ``(all - caps before) / weights not yet stopped``.
    """
    totals = sizes.groupBy("source").agg(
        F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count("*").alias("units"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    ranked = totals.withColumn("source_no", F.row_number().over(by_name)).withColumn(
        "_weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    capped = ranked.withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("_cap") / F.col("_weight"), "source_no").rowsBetween(Window.unboundedPreceding, -1)
    level = (
        (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        / (F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0))))
    return (
        capped.withColumn("_level", level).withColumn("_level", F.max("_level").over(everything))
        .select("source", "source_no", "source_size", "units",
                F.least(F.col("_cap"), F.col("_level") * F.col("_weight")).alias("target")))


def _level(open_units: DataFrame, groups: Column, level: int, seed: int) -> DataFrame:
    """One level of the tree: rows with the undecided unit of each group and all others decided."""
    draw = (f"shiftrightunsigned(xxhash64({seed}, {level}, acc.held.h, x.h, acc.held.doc_id, x.doc_id), 11)"
            " * CAST(1.1102230246251565E-16 AS DOUBLE)")
    meet = _MEET.format(draw=draw)
    step = f"""
      if(acc.held is null, named_struct('held', x, 'done', acc.done),
        transform(array({meet}), r -> named_struct(
          'held', if(r.first, named_struct('h', x.h, 'doc_id', x.doc_id, 'size', x.size, 'digest', x.digest, 'mass', x.mass, 'p', r.b),
            named_struct('h', acc.held.h, 'doc_id', acc.held.doc_id, 'size', acc.held.size, 'digest', acc.held.digest, 'mass', acc.held.mass, 'p', r.a)),
          'done', concat(acc.done, array(
            if(r.first, named_struct('h', acc.held.h, 'doc_id', acc.held.doc_id, 'size', acc.held.size, 'digest', acc.held.digest, 'mass', acc.held.mass, 'p', r.a),
              named_struct('h', x.h, 'doc_id', x.doc_id, 'size', x.size, 'digest', x.digest, 'mass', x.mass, 'p', r.b))))))[0])
    """
    fold = f"aggregate(all, named_struct('held', CAST(NULL AS {{kind}}), 'done', CAST(array() AS array<{{kind}}>)), (acc, x) -> {step})"
    salt = F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "h", "doc_id"), groups)
    grouped = open_units.withColumn("_salt", salt).groupBy("source_no", "_salt").agg(
        F.array_sort(F.collect_list(F.struct("h", "doc_id", "size", "digest", "mass", "p"))).alias("all"))
    kind = grouped.schema["all"].dataType.elementType.simpleString()
    folded = grouped.select("source_no", F.expr(fold.format(kind=kind)).alias("f"))
    tagged = F.expr("concat(transform(f.done, d -> named_struct('d', d, 'open', false)), array(named_struct('d', f.held, 'open', true)))")
    return folded.select("source_no", F.explode(tagged).alias("e")).select("source_no", "e.d.*", "e.open")


def mixing_plan(
    docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 42
) -> DataFrame:
    """Copies of every distinct (doc_id, source, size, digest).

    ``docs`` has ``doc_id``, ``source``, ``size`` (0 or more), ``digest`` (a
    hash of the text; further columns are ignored).  Returns these, rows,
    source_size, target, copies: one row per distinct unit, with the number of
    its rows and of the copies that all of them get together.  Copies of
    repeated rows are counted out: only the fraction of one copy is drawn, so
    a unit of any number of rows puts one document at stake.  A null source is
    a source of its own, last in order; null ids are ids like any other;
    documents without words are taken 0 times; an empty table gives no rows.
    The same input gives the same copies whatever its partitioning.
    """
    units = cut(docs.select("doc_id", "source", F.coalesce("size", F.lit(0)).cast("bigint").alias("size"), "digest").groupBy(*UNIT).agg(
        F.count("*").alias("rows")))
    sources = cut(source_targets(units, weights, share, cap))
    placed = attach(units, sources, ["source"], "inner", "source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    placed = placed.withColumn("_want", F.when(F.col("size") > 0, rate * F.col("rows")).otherwise(F.lit(0.0)))
    open_units = placed.filter(F.col("_want") > F.floor("_want")).select(
        "source_no", "units", F.xxhash64(F.lit(seed), "doc_id", "size", "digest").alias("h"), "doc_id", "size", "digest",
        F.col("size").cast("double").alias("mass"), (F.col("_want") - F.floor("_want")).alias("p"))
    most = sources.agg(F.max("units")).first()[0] or 0
    settled, level, per = [], 0, FAN_IN
    sizes = sources.select("source_no", "units")
    while True:
        # A source's units meet in ceil(units / FAN_IN^level) groups; at the last level in one.
        groups = F.ceil(F.col("units") / F.lit(float(per)))
        folded = cut(_level(open_units, groups, level, seed))
        settled.append(folded.filter(~F.col("open")))
        last = folded.filter("open")
        if most <= per:
            break
        open_units = attach(last.drop("open"), sizes, ["source_no"], "inner")
        level, per = level + 1, per * (FAN_IN // 2)
    rounded = last.withColumn("p", F.when(unit(F.lit(seed), F.lit(-1), "h", "doc_id") < F.col("p"), 1.0).otherwise(0.0))
    for part in settled:
        rounded = rounded.unionByName(part)
    keys = ["source_no", "doc_id", "size", "digest"]
    extra = rounded.filter(F.col("p") >= 0.5).select(*[F.col(c).alias(f"_k_{c}") for c in keys], F.lit(1).alias("_extra"))
    full = placed.join(extra, [placed[c].eqNullSafe(extra[f"_k_{c}"]) for c in keys], "left")
    copies = (F.floor("_want") + F.coalesce("_extra", F.lit(0))).cast("bigint")
    return full.select(*UNIT, "rows", "source_size", "target", copies.alias("copies"))


def sized(docs: DataFrame) -> DataFrame:
    """Document id, source, number of words and hash of the text, written once so that texts are read once."""
    return cut(docs.select("doc_id", "source", words(F.col("text")).alias("size"), F.xxhash64("text").alias("digest")))


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with _mix_at, their 0-based number within a unit.

    A unit may hold any share of the rows: they are numbered within the parts
    they were written in, from the counts of the parts before.
    """
    unit_of = [f"_mix_{c}" for c in UNIT]
    placed = cut(rows.withColumn("_mix_part", F.spark_partition_id()))
    before = Window.partitionBy(*unit_of).orderBy("_mix_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(*unit_of, "_mix_part").agg(F.count("*").alias("_mix_n")).select(
        *[F.col(c).alias(f"_before{c}") for c in (*unit_of, "_mix_part")], F.coalesce(F.sum("_mix_n").over(before), F.lit(0)).alias("_mix_before"))
    local = F.row_number().over(Window.partitionBy(*unit_of, "_mix_part").orderBy(F.lit(0))) - 1
    same = [F.col(c).eqNullSafe(F.col(f"_before{c}")) for c in (*unit_of, "_mix_part")]
    return placed.withColumn("_mix_local", local).join(counts, same).withColumn("_mix_at", F.col("_mix_before") + F.col("_mix_local"))


def mix(docs: DataFrame, **plan) -> DataFrame:
    """Rows of ``docs`` (doc_id, source, text, ...) repeated as often as the mix takes them.

    Columns are those of ``docs``.  Rows of one unit share its copies evenly,
    those that come first get one more where they do not divide.  Very long
    texts are counted whole.  For nulls, repeats and empty texts see
    ``mixing_plan``.
    """
    settled = cut(mixing_plan(sized(docs), **plan).filter(F.col("copies") > 0).select(
        *[F.col(c).alias(f"_mix_{c}") for c in UNIT], F.col("rows").alias("_mix_rows"), F.col("copies").alias("_mix_copies")))
    uneven = F.col("_mix_copies") % F.col("_mix_rows") != 0
    same = (docs["doc_id"].eqNullSafe(F.col("_mix_doc_id")) & docs["source"].eqNullSafe(F.col("_mix_source"))
            & (words(docs["text"]) == F.col("_mix_size")) & (F.xxhash64(docs["text"]) == F.col("_mix_digest")))
    each = F.floor(F.col("_mix_copies") / F.col("_mix_rows")).cast("int")

    def repeated(taken: DataFrame, times: Column) -> DataFrame:
        # Named by position: a column of ``docs`` may be called anything.
        return taken.select("_mix_row.*", F.explode(F.array_repeat(F.lit(1), times)).alias("_mix_one")).drop("_mix_one")

    whole = F.struct(*[docs[c] for c in docs.columns]).alias("_mix_row")
    kept = [f"_mix_{c}" for c in (*UNIT, "rows", "copies")]
    out = repeated(docs.join(settled.filter(~uneven), same).select(whole, *kept), each)
    shared = settled.filter(uneven)
    if shared.isEmpty():
        return out
    numbered = _numbered(docs.join(shared, same).select(whole, *kept))
    more = F.when(F.col("_mix_at") < F.col("_mix_copies") % F.col("_mix_rows"), 1).otherwise(0)
    return out.unionByName(repeated(numbered, each + more))


def mixed_words(docs: DataFrame, **plan) -> DataFrame:
    """doc_id, size, source_size, target and the words the mix takes, one row per row of ``docs``.

    The rows of a unit are alike in these columns, so they are listed from its
    counts: first those with one copy more, then the others.
    """
    units = mixing_plan(sized(docs), **plan)
    blocks = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("rows") - 1) / REPEATS)))
    inside = F.explode(F.sequence(F.lit(0).cast("bigint"), F.least(F.lit(REPEATS - 1), F.col("rows") - 1 - F.col("_block") * REPEATS)))
    listed = units.withColumn("_block", blocks).withColumn("_in", inside)
    more = F.when(F.col("_block") * REPEATS + F.col("_in") < F.col("copies") % F.col("rows"), 1).otherwise(0)
    each = F.floor(F.col("copies") / F.col("rows")) + more
    return listed.select("doc_id", "size", "source_size", "target", (each * F.col("size")).cast("bigint").alias("taken"))
