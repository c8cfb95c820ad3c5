"""Resolve call references to units and keep the result as a distinct edge table.

``calls`` has ``caller_id, name, receiver``; ``units`` has ``id, name,
class_name, file_path``.  A call is answered by the first rule that applies:

1. a receiver other than ``this``: the one unit of that name in a class of the
   receiver's name, if it is the only one anywhere;
2. the first unit of that name in the caller's file and class (no class
   matches no class) - this also answers ``this.name()``;
3. the first unit of that name in the caller's file;
4. the unit of that name, if it is the only one in the index.

"First" is by ``id``.  Every rule looks up a table with one row per key, so a
name with many definitions adds no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import runtime


def _only(units: DataFrame, keys: list[str], into: str) -> DataFrame:
    """The unit of every key that has exactly one."""
    single = units.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("id").alias(into))
    return single.filter(F.col("_n") == 1).drop("_n")


def _first(units: DataFrame, keys: list[str], into: str) -> DataFrame:
    return units.groupBy(*keys).agg(F.min("id").alias(into))


def _placed(units: DataFrame) -> DataFrame:
    units = units.select("id", "name", "file_path", F.col("class_name").alias("owner"))
    # No class must compare equal to no class, and apart from an empty name.
    return units.withColumn("class_key", F.coalesce(F.concat(F.lit("="), F.col("owner")), F.lit("")))


def resolve_calls(units: DataFrame, calls: DataFrame, calling: DataFrame | None = None) -> DataFrame:
    """``caller_id, name, receiver, callee_id, rule`` for every call; no callee is NULL.

    ``rule`` is 1 to 4 as above, NULL when nothing answered.  ``calling`` are
    the units that call, if ``units`` does not hold them.
    """
    units, calling = _placed(units), _placed(units if calling is None else calling)
    callers = calling.select(F.col("id").alias("caller_id"), "file_path", "class_key")
    asked = calls.select("caller_id", "name", "receiver").join(callers, "caller_id")
    # `this` and an empty receiver never name a class.
    asked = asked.withColumn(
        "owner", F.when((F.col("receiver") != "this") & (F.col("receiver") != ""), F.col("receiver")))

    by_file_class = _first(units, ["file_path", "class_key", "name"], "in_class")
    by_file = _first(units, ["file_path", "name"], "in_file")
    by_owner = _only(units.filter(F.col("owner").isNotNull()), ["owner", "name"], "by_owner")
    by_name = _only(units, ["name"], "by_name")

    # One name, or one name of one file, may be a large share of all calls.
    lookups = (
        (by_file_class, ["file_path", "class_key", "name"]), (by_file, ["file_path", "name"]),
        (by_owner, ["owner", "name"]), (by_name, ["name"]))
    found = asked
    rows, hots = runtime.key_profile(asked, *[keys for _, keys in lookups])
    for (lookup, keys), hot in zip(lookups, hots):
        found = runtime.skew_join(found, lookup, keys, "left", F.col("caller_id"), hot, rows)
    return found.select(
        "caller_id", "name", "receiver",
        F.coalesce("by_owner", "in_class", "in_file", "by_name").alias("callee_id"),
        F.when(F.col("by_owner").isNotNull(), 1).when(F.col("in_class").isNotNull(), 2)
        .when(F.col("in_file").isNotNull(), 3).when(F.col("by_name").isNotNull(), 4).alias("rule"))


def named_edges(resolved: DataFrame) -> DataFrame:
    """Distinct ``caller_id, callee_id, name``; ``name`` is the callee's, which is the call's."""
    return (
        resolved.filter(F.col("callee_id").isNotNull() & (F.col("caller_id") != F.col("callee_id")))
        .select("caller_id", "callee_id", "name").distinct())


def call_edges(resolved: DataFrame) -> DataFrame:
    """Distinct ``caller_id, callee_id``; a call that resolved to its own unit gives none."""
    return named_edges(resolved).select("caller_id", "callee_id")


def build_call_graph(units: DataFrame, calls: DataFrame) -> DataFrame:
    return call_edges(resolve_calls(units, calls))


def changed_names(gone: DataFrame, fresh: DataFrame) -> DataFrame:
    """Names that lost or gained a definition.  A call's answer depends on the units of its name alone."""
    return gone.select("name").unionByName(fresh.select("name")).distinct()


def edges_again(units: DataFrame, calls: DataFrame, fresh_calls: DataFrame, names: DataFrame) -> DataFrame:
    """``named_edges`` of the calls that changed units may answer in another way.

    ``units`` are all units now, ``calls`` the calls of units that stayed,
    ``fresh_calls`` those of new units, ``names`` from ``changed_names``.  Old
    edges whose name is in ``names`` are void, all others stay right.  Units
    of names that none of these calls asks for are left out before anything
    is grouped.
    """
    # One name may be a large share of all calls.
    touched = runtime.lookup_join(calls, names, ["name"], "left_semi", F.col("caller_id"), "name")
    asked = runtime.cut(touched.select("caller_id", "name", "receiver").unionByName(fresh_calls.select("caller_id", "name", "receiver")))
    wanted = asked.select("name").distinct()
    callers = asked.select(F.col("caller_id").alias("id")).distinct()
    keep = [c for c in ("id", "name", "class_name", "file_path") if c in units.columns]
    narrow = units.select(keep)
    known = runtime.lookup_join(narrow, wanted, ["name"], "left_semi", F.col("id"), "name")
    calling = runtime.lookup_join(narrow, callers, ["id"], "left_semi", F.col("id"))
    return named_edges(resolve_calls(known, asked, calling))


def merge_edges(edges: DataFrame, again: DataFrame, names: DataFrame, gone: DataFrame) -> DataFrame:
    """``named_edges`` after a change: those that stayed right, and those resolved again."""
    kept = runtime.lookup_join(edges, names, ["name"], "left_anti", F.col("caller_id"), "name")
    kept = runtime.lookup_join(kept, gone.select(F.col("id").alias("caller_id")), ["caller_id"], "left_anti", F.col("callee_id"))
    columns = ["caller_id", "callee_id", "name"]
    return kept.select(columns).unionByName(again.select(columns))
