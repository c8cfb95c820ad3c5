"""Build, update and query an index of source files.

``index_project`` takes a folder, ``build_index`` a table of files; ``search``,
``search_keyword``, ``build_context`` and ``run_benchmark`` answer a whole
table of queries against a loaded index.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import runtime
from .functions.vectors import EmbedderFactory, embed_queries, embed_units, embedder_name, vector_keys
from .operators import callgraph, context, evaluate, expand, extract, maintain, search as ranking
from .sources import files as trees, snapshot
from .sources.snapshot import ConcurrentRun, Index, compact, load_index

__all__ = [
    "ConcurrentRun", "Index", "compact", "load_index", "index_project", "build_index", "search", "search_keyword", "build_context", "run_benchmark"]


def build_index(
    current: DataFrame, folder: str, read: Callable[[DataFrame], DataFrame], force: bool = False,
    make_embedder: EmbedderFactory | None = None, prune_missing: bool = False, with_vectors: bool = True,
    embedder: str | None = None,
) -> Index:
    """Bring the index in ``folder`` up to date with the files of ``current``.

    ``current`` has ``path, mtime_ms, size``.  ``read`` turns the rows that are
    due into ``path, content``; unchanged files are never read.  Rows of
    changed files are replaced and get new, larger ids.  A run writes only its
    own rows: calls are resolved again where the definitions of their name
    changed, all other rows and edges stay where they are.  Files that
    disappeared stay unless ``prune_missing`` is set.  Texts that an earlier run
    embedded by the same embedder keep their vectors; ``force`` embeds all anew.
    ``embedder`` names the model and its version.  Without it the name of a
    plain function is taken; vectors of closures, lambdas and objects are then
    not taken over by later runs.  Raises
    ``ConcurrentRun`` if another run committed meanwhile.
    """
    spark, run = current.sparkSession, snapshot.new_run()
    before = load_index(spark, folder)
    with snapshot.staging(spark, folder, run) as stage:
        made = _write_run(before, current, run, stage, read, force, make_embedder, prune_missing, with_vectors, embedder)
    index = load_index(spark, folder)
    return snapshot.compact(spark, folder) if made and snapshot.crowded(index) else index


def _write_run(
    before: Index, current: DataFrame, run: str, stage: str, read: Callable[[DataFrame], DataFrame], force: bool,
    make_embedder: EmbedderFactory | None, prune_missing: bool, with_vectors: bool, embedder: str | None,
) -> bool:
    """Write and commit the rows of one run; False if nothing was due.

    Counts are observed while the tables are written, so no job runs for them.
    """
    spark, folder = current.sparkSession, before.folder
    put, at = snapshot.put, lambda name: snapshot.run_table(folder, run, name)
    stale = before.units if before.version else None
    status, seen = put(
        maintain.file_status(current, before.files, stale, force), f"{stage}/status", due=F.count_if("reindex"))
    due = status.filter("reindex")
    paths, missing = due.select("path"), None
    gone_files = 0
    if prune_missing:
        missing, found = put(maintain.prune_missing(before.files, status), f"{stage}/missing", n=F.count("*"))
        paths, gone_files = paths.unionByName(missing.select("path")), found["n"]
    functions = sum(r["units"] - r["gone"] for r in before.runs)
    if before.version and not seen["due"] and not gone_files:
        # The tables stay as they are, only the run is recorded.
        snapshot.commit(spark, before, list(before.runs), before.last_id, 0, functions, changed=False)
        return False

    found = extract.extract_functions(read(due.select("path", "mtime_ms", "size")).select("path", "content"))
    # Sorting by range samples its input first; it should not extract twice.
    found, _ = put(found, f"{stage}/found")
    # A file's functions in reading order, outer before inner.
    order = ["file_path", "start_offset", F.desc("end_offset")]
    staged = found.repartitionByRange("file_path", "start_offset").sortWithinPartitions(*order)
    fresh = snapshot.number_new(staged, f"{stage}/staged", before.last_id)
    vectors, name = 0, embedder or embedder_name(make_embedder)
    if with_vectors:
        known = before.vectors if name and not force else before.vectors.limit(0)
        fresh, vectors = _with_vectors(fresh, known, stage, at("vectors"), name or run, make_embedder)
    else:
        fresh = fresh.withColumn("embedding", F.lit(None).cast("array<float>"))
    units, added = put(fresh.select(before.units.columns), at("units"), n=F.count("*"), last=F.max("id"))
    calls, _ = put(extract.unit_calls(units), at("calls"))
    # In token order, a search of a few words skips the row groups without them.
    put(ranking.postings(units).sortWithinPartitions("token"), at("postings"))
    entry = {
        "run": run, "units": added["n"], "gone": 0, "names": 0, "name_bytes": 0, "forced": force, "vectors": vectors if name else 0,
        "embedders": [name] if with_vectors and name else []}

    if before.version:
        narrow = before.units.select("id", "name", "class_name", "file_path")
        replaced, n = put(maintain.of_files(narrow, paths).select("id", "name"), f"{stage}/replaced", n=F.count("*"))
        gone, _ = put(replaced.select("id"), at("gone"))
        names, m = put(
            callgraph.changed_names(replaced, units), at("names"), n=F.count("*"), bytes=F.coalesce(F.sum(F.octet_length("name")), F.lit(0)))
        entry |= {"gone": n["n"], "names": m["n"], "name_bytes": m["bytes"]}
        stayed = runtime.lookup_join(narrow, gone, ["id"], "left_anti", F.col("id"))
        stayed_calls = runtime.lookup_join(
            before.calls, gone.withColumnRenamed("id", "caller_id"), ["caller_id"], "left_anti", F.col("at"))
        edges = callgraph.edges_again(stayed.unionByName(units.select(stayed.columns)), stayed_calls, calls, names)
    else:
        edges = callgraph.named_edges(callgraph.resolve_calls(units, calls))
    put(edges, at("edges"))
    files = due.select("path", "mtime_ms", "size").withColumn("dropped", F.lit(False))
    if missing is not None:
        files = files.unionByName(missing.select("path", "mtime_ms", "size").withColumn("dropped", F.lit(True)))
    put(files, at("files"))
    snapshot.commit(
        spark, before, [*before.runs, entry], max(before.last_id, added["last"] or 0), seen["due"], functions + entry["units"] - entry["gone"])
    return True


def _with_vectors(
    fresh: DataFrame, known: DataFrame, stage: str, path: str, name: str, make_embedder: EmbedderFactory | None
) -> tuple[DataFrame, int]:
    """``fresh`` with the vector of its text, and how many vectors were made for that.

    A text is embedded once, whichever units and runs have it: ``known`` are
    the vectors of earlier runs, ``path`` takes the new ones.
    """
    put = snapshot.put
    keyed, _ = put(vector_keys(fresh, name), f"{stage}/keys")
    # One unit stands for all of its key.
    asked, _ = put(keyed.groupBy("key").agg(F.min("id").alias("id")), f"{stage}/asked")
    held, _ = put(
        runtime.lookup_join(known, asked.select("key"), ["key"], "left_semi", F.col("key"), "key").select("key", "embedding"), f"{stage}/held")
    unseen, _ = put(asked.join(held.select("key"), "key", "left_anti"), f"{stage}/unseen")
    chosen = runtime.lookup_join(fresh, unseen.select("id"), ["id"], "left_semi", F.col("id"))
    made, counted = put(embed_units(chosen, make_embedder).join(unseen, "id").select("key", "embedding"), path, n=F.count("*"))
    # A copied text may be a large share of all units.
    [hot] = runtime.hot_keys(keyed, ["key"])
    found = runtime.skew_join(keyed, held.unionByName(made), ["key"], "inner", F.col("id"), hot).select("id", "embedding")
    return fresh.join(found, "id", "left"), counted["n"]


def index_project(
    spark: SparkSession, root: str, folder: str, force: bool = False, ignore: Sequence[str] = (), **options
) -> Index:
    """Index the source files below a folder that all executors can reach."""
    return build_index(
        trees.list_tree(spark, root, ignore), folder, lambda due: trees.read_contents(due, root), force, **options)


def search_keyword(index: Index, queries: DataFrame, k: int = 5) -> DataFrame:
    """Ranked matches by token overlap alone, with the units' columns."""
    return ranking.describe(ranking.keyword_search(index.units, queries, k, index=index.postings), index.units)


def _ranked(
    index: Index, queries: DataFrame, k: int, expand_dependencies: bool, depth: int, make_embedder: EmbedderFactory | None
) -> DataFrame:
    if "embedding" not in queries.columns:
        queries = embed_queries(queries, make_embedder)
    found = ranking.hybrid_search(index.units, queries, k, index=index.postings)
    # The edge table is read only when it is needed.
    return expand.expand(found, index.edges, index.units, depth) if expand_dependencies else found


def search(
    index: Index, queries: DataFrame, k: int = 5, expand_dependencies: bool = False, depth: int = 1,
    make_embedder: EmbedderFactory | None = None,
) -> DataFrame:
    """Ranked matches by similarity and token overlap, widened along the call graph on request.

    Queries without an ``embedding`` column are embedded as the units were.
    """
    ranking.check_k(k)
    expand.check_depth(depth)
    return ranking.describe(_ranked(index, queries, k, expand_dependencies, depth, make_embedder), index.units)


def build_context(
    index: Index, queries: DataFrame, k: int = 6, expand_dependencies: bool = False, depth: int = 1,
    make_embedder: EmbedderFactory | None = None,
) -> DataFrame:
    """``query_id, context``: the source of the results of every query as one text."""
    ranking.check_k(k)
    expand.check_depth(depth)
    found = _ranked(index, queries, k, expand_dependencies, depth, make_embedder)
    return context.build_context(found, index.units, queries)


def run_benchmark(
    sources: DataFrame, queries: DataFrame, qrels: DataFrame, folder: str, k: int = 3,
    make_embedder: EmbedderFactory | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Index ``path, content`` rows from scratch and compare the three methods.

    Returns the method table and the one-row corpus summary.
    """
    current = sources.select("path", F.lit(0).cast("bigint").alias("mtime_ms"), F.octet_length("content").cast("bigint").alias("size"))
    start = time.perf_counter()
    index = build_index(current, folder, lambda due: sources.join(due, "path", "left_semi"), True, make_embedder)
    indexing_ms = (time.perf_counter() - start) * 1000
    embedded = runtime.cut(embed_queries(queries, make_embedder))
    methods = {
        evaluate.KEYWORD: lambda: ranking.keyword_search(index.units, queries, k, index=index.postings),
        evaluate.HYBRID: lambda: ranking.hybrid_search(index.units, embedded, k, index=index.postings)}
    metrics = evaluate.benchmark_report(methods, index.units, queries, qrels, sources, indexing_ms)
    return metrics, evaluate.corpus_summary(sources, index.units, queries)
