"""Index snapshots: a folder of Parquet tables per run, and a manifest file per commit.

A run writes only the rows that it made, into a folder of its own, with the ids
of the units that it replaced (``gone``) and the names whose definitions it
changed (``names``).  An index is the runs that its manifest lists: rows of
replaced units are left out when the tables are read, edges to a changed name
count only from the last run that resolved it.  ``compact`` writes what is left
as one run.

A commit is the creation of the next manifest file, which fails if the file is
there: of two runs that start from the same commit one wins and the other
raises ``ConcurrentRun``; the folder of the loser is never listed.  Renaming
without overwriting is atomic on HDFS, linking is on local file systems.
Object stores without an atomic rename need one writer at a time.
"""

from __future__ import annotations

import functools
import json
import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timezone
from typing import NamedTuple
from urllib.parse import unquote, urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window, functions as F

from .. import runtime
from ..functions.vectors import vector_keys

SCHEMAS = {
    "units": (
        "id bigint, name string, kind string, class_name string, file_path string, start_line int, end_line int, "
        "start_offset int, end_offset int, code string, embedding array<float>"),
    "files": "path string, mtime_ms bigint, size bigint, dropped boolean",
    "calls": "caller_id bigint, name string, receiver string, at int",
    "postings": "token string, id bigint, in_name boolean, in_class boolean, tf bigint",
    "edges": "caller_id bigint, callee_id bigint, name string",
    "gone": "id bigint",
    "names": "name string",
    "vectors": "key string, embedding array<float>",
}

# Runs that an index lists at the most before it is compacted.
MAX_RUNS = 16


class ConcurrentRun(RuntimeError):
    """Another run committed first; nothing of this one is visible."""


class Index(NamedTuple):
    """An index as of a commit.

    ``version`` counts the commits that changed rows and is 0 for an index that
    was never built.  ``runs`` has the folder and the row counts of each run.
    """

    folder: str
    commit: int
    version: int
    last_id: int
    runs: tuple[dict, ...]
    files: DataFrame
    units: DataFrame
    postings: DataFrame
    calls: DataFrame
    named_edges: DataFrame
    edges: DataFrame
    stats: DataFrame
    vectors: DataFrame


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _local(path: str) -> str:
    return unquote(urlparse(path).path) if path.startswith("file:") else path


def _commits(spark: SparkSession, folder: str) -> dict[int, str]:
    fs, target = _file_system(spark, f"{folder}/manifest")
    if not fs.exists(target):
        return {}
    names = [s.getPath().getName() for s in fs.listStatus(target)]
    return {int(n[7:-5]): f"{folder}/manifest/{n}" for n in names if n.startswith("commit-") and n.endswith(".json")}


def _read_text(spark: SparkSession, path: str) -> str:
    fs, target = _file_system(spark, path)
    stream = fs.open(target)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def _publish(spark: SparkSession, folder: str, commit: int, text: str) -> None:
    """Create the manifest file of ``commit`` with its whole content, or raise ``ConcurrentRun``."""
    fs, manifest = _file_system(spark, f"{folder}/manifest")
    fs.mkdirs(manifest)
    draft, final = (f"{folder}/manifest/{n}" for n in (f"draft-{uuid.uuid4().hex}", f"commit-{commit:012d}.json"))
    _, draft_path = _file_system(spark, draft)
    stream = fs.create(draft_path, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    try:
        if fs.getUri().getScheme() == "file":
            os.link(_local(draft), _local(final))
        else:
            options = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.NONE
            context = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(
                fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
            array = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
            array[0] = options
            context.rename(draft_path, _file_system(spark, final)[1], array)
    except FileExistsError:
        raise ConcurrentRun(f"commit {commit} of {folder} was made by another run") from None
    except Py4JJavaError as error:
        if "FileAlreadyExists" in str(error.java_exception.toString()):
            raise ConcurrentRun(f"commit {commit} of {folder} was made by another run") from None
        raise
    finally:
        fs.delete(draft_path, False)


def put(df: DataFrame, path: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """Write a new table, and read it back; ``metrics`` are observed while it is written."""
    if metrics:
        seen = Observation()
        df.observe(seen, *[column.alias(name) for name, column in metrics.items()]).write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path), seen.get
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), {}


def new_run() -> str:
    return f"{datetime.now(timezone.utc):%Y%m%dT%H%M%S}-{uuid.uuid4().hex}"


def run_table(folder: str, run: str, name: str) -> str:
    return f"{folder}/runs/{run}/{name}"


@contextmanager
def staging(spark: SparkSession, folder: str, run: str) -> Iterator[str]:
    """A folder for what only this run needs; it is gone when the run ends, whether it succeeds or not."""
    at = f"{folder}/staging/{run}"
    try:
        yield at
    finally:
        fs, target = _file_system(spark, at)
        fs.delete(target, True)


def _tables(spark: SparkSession, folder: str, runs: list[dict], name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(*[run_table(folder, r["run"], name) for r in runs])


def _alive(rows: DataFrame, gone: DataFrame | None, key: str, small: bool) -> DataFrame:
    if gone is None:
        return rows
    gone = gone.withColumnRenamed("id", key)
    return rows.join(F.broadcast(gone) if small else gone, key, "left_anti").select(rows.columns)


def _load(spark: SparkSession, folder: str, commit: int, manifest: dict) -> Index:
    runs = manifest["runs"]
    # The manifest knows the sizes of all that is compared with every row.
    replacing = [r for r in runs if r["gone"]]
    gone = _tables(spark, folder, replacing, "gone") if replacing else None
    few_gone = sum(r["gone"] for r in runs) <= runtime.BROADCAST_ROWS
    units, postings = (_alive(_tables(spark, folder, runs, n), gone, "id", few_gone) for n in ("units", "postings"))
    calls = _alive(_tables(spark, folder, runs, "calls"), gone, "caller_id", few_gone)

    if len(runs) == 1:
        edges = _tables(spark, folder, runs, "edges")
        files = _tables(spark, folder, runs, "files").filter("NOT dropped").drop("dropped")
    else:
        numbered = {
            name: [_tables(spark, folder, [r], name).withColumn("_run", F.lit(i)) for i, r in enumerate(runs) if name != "names" or r["names"]]
            for name in ("edges", "files", "names")}
        edges, files = _union(numbered["edges"]), _union(numbered["files"])
        if numbered["names"]:
            last = _union(numbered["names"]).groupBy("name").agg(F.max("_run").alias("_last"))
            small = (
                sum(r["names"] for r in runs) <= runtime.BROADCAST_ROWS and sum(r["name_bytes"] for r in runs) <= runtime.BROADCAST_BYTES)
            if small:
                edges = edges.join(F.broadcast(last), "name", "left")
            else:
                [hot] = runtime.hot_keys(edges, ["name"])
                edges = runtime.skew_join(edges, last, ["name"], "left", F.col("caller_id"), hot)
            edges = edges.filter(F.col("_last").isNull() | (F.col("_last") <= F.col("_run")))
        edges = _alive(edges.select("caller_id", "callee_id", "name"), gone, "caller_id", few_gone)
        newest = files.groupBy("path").agg(F.max_by(F.struct("mtime_ms", "size", "dropped"), "_run").alias("f"))
        files = newest.filter("NOT f.dropped").select("path", "f.mtime_ms", "f.size")
    stats = spark.createDataFrame(
        [(manifest["files_scanned"], manifest["functions_indexed"])], "files_scanned bigint, functions_indexed bigint")
    return Index(
        folder, commit, manifest["version"], manifest["last_id"], tuple(runs), files, units, postings, calls, edges,
        edges.select("caller_id", "callee_id"), stats, _vectors(spark, folder, runs))


def _vectors(spark: SparkSession, folder: str, runs: list[dict]) -> DataFrame:
    """Stored vectors, one row per key: those since the last forced run, which made its own."""
    since = max((i for i, r in enumerate(runs) if r.get("forced")), default=0)
    holding = [r for r in runs[since:] if r.get("vectors")]
    return _tables(spark, folder, holding, "vectors") if holding else spark.createDataFrame([], SCHEMAS["vectors"])


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out


def load_index(spark: SparkSession, folder: str) -> Index:
    """The index as of its newest commit, or an empty one.  Tables are read when used."""
    commits = _commits(spark, folder)
    if commits:
        newest = max(commits)
        return _load(spark, folder, newest, json.loads(_read_text(spark, commits[newest])))
    empty = {name: spark.createDataFrame([], schema) for name, schema in SCHEMAS.items()}
    stats = spark.createDataFrame([], "files_scanned bigint, functions_indexed bigint")
    edges = empty["edges"]
    return Index(
        folder, 0, 0, 0, (), empty["files"].drop("dropped"), empty["units"], empty["postings"], empty["calls"], edges,
        edges.select("caller_id", "callee_id"), stats, empty["vectors"])


def commit(
    spark: SparkSession, before: Index, runs: list[dict], last_id: int, files_scanned: int, functions: int, changed: bool = True
) -> None:
    """Make ``runs`` the index, if nobody committed since ``before`` was loaded."""
    manifest = {
        "version": before.version + (1 if changed else 0), "runs": runs, "last_id": last_id, "files_scanned": files_scanned,
        "functions_indexed": functions, "run_at": datetime.now(timezone.utc).isoformat()}
    _publish(spark, before.folder, before.commit + 1, json.dumps(manifest))


def embedders(index: Index) -> list[str]:
    """Names of the embedders that the index has stored vectors of."""
    return sorted({n for r in index.runs for n in r.get("embedders", ())})


def crowded(index: Index) -> bool:
    """Does the index list many runs, or more replaced units than others?"""
    made, gone = (sum(r[k] for r in index.runs) for k in ("units", "gone"))
    return len(index.runs) > MAX_RUNS or (gone > 0 and 2 * gone > made)


def compact(spark: SparkSession, folder: str) -> Index:
    """Write the rows of the index that are left as one run.  Its rows and its version stay the same."""
    index, run = load_index(spark, folder), new_run()
    if len(index.runs) < 2:
        return index
    put(index.units, run_table(folder, run, "units"))
    # In token order, a search of a few words skips the row groups without them.
    put(index.postings.repartitionByRange("token", "id").sortWithinPartitions("token"), run_table(folder, run, "postings"))
    put(index.calls, run_table(folder, run, "calls"))
    put(index.named_edges, run_table(folder, run, "edges"))
    put(index.files.withColumn("dropped", F.lit(False)), run_table(folder, run, "files"))
    # Vectors of texts that no unit has any more are left behind.
    used = functools.reduce(DataFrame.unionByName, [vector_keys(index.units, n).select("key") for n in embedders(index)], index.vectors.select("key").limit(0))
    _, kept = put(index.vectors.join(used.distinct(), "key", "left_semi"), run_table(folder, run, "vectors"), n=F.count("*"))
    stats = index.stats.first()
    entry = {"run": run, "units": sum(r["units"] - r["gone"] for r in index.runs), "gone": 0, "names": 0, "name_bytes": 0, "vectors": kept["n"], "embedders": embedders(index)}
    commit(spark, index, [entry], index.last_id, stats["files_scanned"], stats["functions_indexed"], changed=False)
    return load_index(spark, folder)


def number_new(staged: DataFrame, path: str, last_id: int) -> DataFrame:
    """Give the rows of a sorted table, written to ``path``, the ids after ``last_id``, in file order.

    A row's number is its place in its part file plus the rows of the part
    files before it: no window over all rows, no shuffle of the rows.
    """
    spark = staged.sparkSession
    staged.write.parquet(path)
    rows = spark.read.schema(staged.schema).parquet(path).select(
        "*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    # One row per part file: its number follows the number of tasks, not the data.
    # Part numbers have five digits at least: order by number, not by name.
    counts = rows.groupBy("_file").agg(F.count("*").alias("_n"))
    part = F.regexp_extract("_file", r"^part-(\d+)", 1).cast("bigint")
    earlier = Window.orderBy(part, "_file").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_file", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return rows.join(before, "_file").select(
        (F.col("_before") + F.col("_row") + 1 + F.lit(last_id)).cast("bigint").alias("id"), *staged.columns)
