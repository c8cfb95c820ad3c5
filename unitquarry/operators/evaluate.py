"""Precision, recall and context reduction of retrieval methods against labels.

``qrels`` has ``query_id, key`` with keys of the form ``file:name``.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from .. import runtime
from ..functions.text import token_estimate, unit_key

FULL, KEYWORD, HYBRID = "Full Repository", "Keyword Search", "Hybrid Search"


def corpus_tokens(files: DataFrame) -> DataFrame:
    """One row: the sum of the per-file token estimates."""
    return files.agg(F.coalesce(F.sum(token_estimate(F.col("content"))), F.lit(0)).alias("tokens"))


def corpus_summary(files: DataFrame, units: DataFrame, queries: DataFrame) -> DataFrame:
    """One row: ``files, functions, scenarios, estimated_repository_tokens``."""
    return files.agg(
        F.count("*").alias("files"),
        F.coalesce(F.sum(token_estimate(F.col("content"))), F.lit(0)).alias("estimated_repository_tokens"),
    ).select(
        "files",
        units.agg(F.count("*")).scalar().alias("functions"),
        queries.agg(F.count("*")).scalar().alias("scenarios"),
        "estimated_repository_tokens")


def keyed(units: DataFrame) -> DataFrame:
    """``id, key, tokens`` of every unit: all that judging needs of the text."""
    return units.select(
        "id", unit_key(F.col("file_path"), F.col("name")).alias("key"), token_estimate(F.col("code")).alias("tokens"))


def per_query(
    results: DataFrame, units: DataFrame, queries: DataFrame, qrels: DataFrame, repository_tokens: DataFrame
) -> DataFrame:
    """``query_id, returned, hits, relevant, precision, recall, token_reduction_percent``.

    Returned rows count with repeats, hits are distinct keys.  Every returned
    key is charged the tokens of the first unit with that key.  A query without
    results has precision and recall 0 and reduction 100.
    """
    one = results.select(F.lit("").alias("method"), "query_id", "id")
    return per_method_and_query(one, [""], units, queries, qrels, repository_tokens).drop("method")


def per_method_and_query(
    results: DataFrame, methods: Sequence[str], units: DataFrame, queries: DataFrame, qrels: DataFrame, repository_tokens: DataFrame
) -> DataFrame:
    """``per_query`` of several methods in one pass: ``results`` and the answer have a ``method``.

    Every query has a row for each of ``methods``, whether it has results or not.
    """
    qrels = qrels.select("query_id", "key").distinct()
    # The ranking is read several times; write it once.
    results = runtime.cut(results.select("method", "query_id", "id"))
    keyed_units = units if "tokens" in units.columns else keyed(units)
    # Results are few and units many: shrink the units before anything is shuffled.
    found = runtime.lookup_join(
        keyed_units.select("id", "key"), results.select("id").distinct(), ["id"], "left_semi", F.col("id"))
    # A unit, and a key, may be returned for a large share of all queries.
    returned = runtime.lookup_join(results, runtime.cut(found), ["id"], "inner", F.col("query_id"), "key")
    returned = runtime.cut(returned.groupBy("method", "query_id", "key").agg(F.count("*").alias("rows")))
    same_key = runtime.lookup_join(
        keyed_units, returned.select("key").distinct(), ["key"], "left_semi", F.col("id"), "key")
    first = runtime.cut(same_key.groupBy("key").agg(F.min_by("tokens", "id").alias("tokens")))
    judged = (
        runtime.lookup_join(returned, first, ["key"], "inner", F.col("query_id"), "key")
        .join(qrels.withColumn("relevant", F.lit(1)), ["query_id", "key"], "left")
        .groupBy("method", "query_id").agg(
            F.sum("rows").alias("returned"),
            F.count("relevant").alias("hits"),
            F.sum(F.col("rows") * F.col("tokens")).alias("context_tokens")))
    counts = (
        queries.select("query_id")
        .join(qrels.groupBy("query_id").agg(F.count("*").alias("relevant")), "query_id", "left")
        .withColumn("method", F.explode(F.array(*[F.lit(m) for m in methods])))
        .join(judged, ["method", "query_id"], "left")
        .fillna(0, ["relevant", "returned", "hits", "context_tokens"]))
    share = F.col("context_tokens") / repository_tokens.select("tokens").scalar()
    return counts.select(
        "method", "query_id", "returned", "hits", "relevant",
        _ratio("hits", "returned").alias("precision"),
        _ratio("hits", "relevant").alias("recall"),
        (100.0 * (1.0 - share)).alias("token_reduction_percent"))


def _ratio(part: str, whole: str):
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)


def per_query_full(units: DataFrame, queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """The whole-corpus baseline, from counts: every unit returned for every query, reduction 0."""
    keys = (units if "key" in units.columns else keyed(units)).select("key").distinct()
    wanted = qrels.select("query_id", "key").distinct()
    relevant = wanted.groupBy("query_id").agg(F.count("*").alias("relevant"))
    hits = wanted.join(keys, "key", "left_semi").groupBy("query_id").agg(F.count("*").alias("hits"))
    return (
        queries.select("query_id")
        .join(relevant, "query_id", "left").join(hits, "query_id", "left")
        .fillna(0, ["relevant", "hits"])
        .withColumn("returned", units.agg(F.count("*")).scalar())
        .select(
            "query_id", "returned", "hits", "relevant",
            _ratio("hits", "returned").alias("precision"),
            _ratio("hits", "relevant").alias("recall"),
            F.lit(0.0).alias("token_reduction_percent")))


MEASURES = ("token_reduction_percent", "precision", "recall")


def macro_average(per: DataFrame, methods: Sequence[str]) -> DataFrame:
    """One row per method, in their order: the plain mean over its queries; NULL without any."""
    means = per.agg(*[
        F.struct(F.lit(m).alias("method"), *[F.avg(F.when(F.col("method") == m, F.col(c))).alias(c) for c in MEASURES]).alias(f"m{i}")
        for i, m in enumerate(methods)])
    return means.select(F.inline(F.array(*means.columns)))


def compare_methods(
    methods: dict[str, DataFrame], units: DataFrame, queries: DataFrame, qrels: DataFrame, files: DataFrame
) -> DataFrame:
    """One row per method, the whole corpus first: ``method, token_reduction_percent, precision, recall``.

    All methods are judged together: units and labels are read once.
    """
    # Labels and corpus size serve every method; work them out once.
    qrels, tokens = runtime.cut(qrels.select("query_id", "key").distinct()), runtime.cut(corpus_tokens(files))
    units = runtime.cut(keyed(units))
    full = macro_average(per_query_full(units, queries, qrels).withColumn("method", F.lit(FULL)), [FULL])
    if not methods:
        return full
    results = reduce(DataFrame.unionByName, [
        found.select(F.lit(method).alias("method"), "query_id", "id") for method, found in methods.items()])
    per = per_method_and_query(results, list(methods), units, queries, qrels, tokens)
    return full.unionByName(macro_average(per, list(methods)))


def timed(run: Callable[[], DataFrame], queries: int) -> tuple[DataFrame, float]:
    """Run a retrieval for all queries; its written rows and the mean milliseconds per query."""
    start = time.perf_counter()
    rows = runtime.cut(run())
    return rows, (time.perf_counter() - start) * 1000 / max(1, queries)


def benchmark_report(
    methods: dict[str, Callable[[], DataFrame]], units: DataFrame, queries: DataFrame, qrels: DataFrame,
    files: DataFrame, indexing_ms: float | None = None,
) -> DataFrame:
    """Quality and time of every method.

    ``method, indexing_ms, retrieval_latency_ms, token_reduction_percent,
    precision, recall``.  Times are wall-clock and differ from run to run;
    latency is the batch time divided by the number of queries, for the whole
    corpus the time to read all units once.
    """
    n_queries = queries.count()
    start = time.perf_counter()
    units.write.format("noop").mode("overwrite").save()
    results, latency = {}, {FULL: (time.perf_counter() - start) * 1000 / max(1, n_queries)}
    for method, run in methods.items():
        results[method], latency[method] = timed(run, n_queries)
    quality = compare_methods(results, units, queries, qrels, files)
    spark = units.sparkSession
    times = spark.createDataFrame(
        [(m, None if m == FULL else indexing_ms, ms) for m, ms in latency.items()],
        "method string, indexing_ms double, retrieval_latency_ms double")
    return times.join(quality, "method")
