"""What changed since the last index, and the replacement of exactly those rows.

``files`` tables have ``path, mtime_ms, size``; ``units`` has ``id, file_path,
start_offset, end_offset`` among others; ``edges`` has ``caller_id, callee_id``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import runtime


def missing_ranges(units: DataFrame) -> DataFrame:
    """One row ``stale``: does any unit lack its source range?"""
    lacking = F.col("start_offset").isNull() | F.col("end_offset").isNull()
    return units.filter(lacking).limit(1).agg((F.count("*") > 0).alias("stale"))


def file_status(
    current: DataFrame, stored: DataFrame, stored_units: DataFrame | None = None, force: bool = False
) -> DataFrame:
    """``path, mtime_ms, size, status, reindex`` of every current file.

    A file is unchanged if its time and size both match what is stored; same
    time and size with other content goes unnoticed.  All files are reindexed
    when forced, or when any stored unit lacks its source range.
    """
    before = stored.select("path", F.col("mtime_ms").alias("old_mtime"), F.col("size").alias("old_size"))
    status = (
        F.when(F.col("old_mtime").isNull(), "new")
        .when((F.col("mtime_ms") != F.col("old_mtime")) | (F.col("size") != F.col("old_size")), "changed")
        .otherwise("unchanged"))
    stale = missing_ranges(stored_units).scalar() if stored_units is not None else F.lit(False)
    return (
        current.select("path", "mtime_ms", "size").join(before, "path", "left")
        .select("path", "mtime_ms", "size", status.alias("status"))
        .withColumn("reindex", F.lit(force) | stale | (F.col("status") != "unchanged")))


def delete_by_file(units: DataFrame, paths: DataFrame) -> DataFrame:
    """``units`` without those of the given ``path`` rows."""
    gone = paths.select(F.col("path").alias("file_path")).distinct()
    return runtime.lookup_join(units, gone, ["file_path"], "left_anti", F.col("id"), "file_path")


def of_files(units: DataFrame, paths: DataFrame) -> DataFrame:
    """``units`` of the given ``path`` rows."""
    wanted = paths.select(F.col("path").alias("file_path")).distinct()
    return runtime.lookup_join(units, wanted, ["file_path"], "left_semi", F.col("id"), "file_path")


def replace_by_file(units: DataFrame, new_units: DataFrame, paths: DataFrame) -> DataFrame:
    """``units`` with the rows of ``paths`` exchanged for ``new_units``."""
    return delete_by_file(units, paths).unionByName(new_units, allowMissingColumns=True)


def delete_edges(edges: DataFrame, units: DataFrame, paths: DataFrame) -> DataFrame:
    """``edges`` without those that start or end in a unit of the given ``path`` rows."""
    gone = runtime.lookup_join(
        units.select("id", F.col("file_path").alias("path")), paths.select("path").distinct(),
        ["path"], "left_semi", F.col("id"), "path").select("id")
    gone = runtime.cut(gone)
    kept = edges
    # A hub may be the end of a large share of all edges.
    for end, other in (("caller_id", "callee_id"), ("callee_id", "caller_id")):
        kept = runtime.lookup_join(
            kept, gone.select(F.col("id").alias(end)), [end], "left_anti", F.col(other))
    return kept.select("caller_id", "callee_id")


def upsert_files(stored: DataFrame, changed: DataFrame) -> DataFrame:
    """``stored`` with the rows of ``changed`` put in or replaced."""
    columns = ["path", "mtime_ms", "size"]
    return stored.select(columns).join(changed.select("path"), "path", "left_anti").unionByName(changed.select(columns))


def prune_missing(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Stored files that are no longer in the tree."""
    return stored.join(current.select("path"), "path", "left_anti")


def index_stats(status: DataFrame, units: DataFrame) -> DataFrame:
    """One row ``files_scanned, functions_indexed``: files worked on now, units in the index."""
    return status.agg(F.count_if("reindex").alias("files_scanned")).withColumn(
        "functions_indexed", units.agg(F.count("*")).scalar())


def count_files(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("files"))
