"""The registered queries: every operator on whole driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import runtime
from ..functions import text, vectors
from ..operators import callgraph, clusters, context, evaluate, expand, extract, maintain, search
from ..sources import files, report
from . import views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def registered(query: Query) -> Query:
    QUERIES[query.__name__] = query
    return query


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# --- text -----------------------------------------------------------------

@registered
def q_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.document_units(spark, sf_dir)
    return docs.select(F.explode(text.tokenize(F.col("code"))).alias("token")).groupBy("token").agg(
        F.count("*").alias("n"))


@registered
def q_split_identifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.document_units(spark, sf_dir)
    return docs.select("id", F.posexplode(text.split_identifier(F.col("name"))).alias("nth", "piece"))


@registered
def q_body_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.document_units(spark, sf_dir)
    return (
        docs.select("id", F.explode(text.body_tokens(F.col("code"), text.BODY_TOKEN_CAP)).alias("token"))
        .groupBy("id", "token").agg(F.count("*").alias("tf")))


@registered
def q_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.postings(views.page_units(spark, sf_dir), body_cap=None)


@registered
def q_token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.document_units(spark, sf_dir).select(
        "id", text.unit_key(F.col("file_path"), F.col("name")).alias("key"),
        text.unit_label(F.col("class_name"), F.col("name")).alias("label"),
        text.token_estimate(F.col("code")).alias("tokens"))


# --- search ---------------------------------------------------------------

@registered
def q_keyword_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    units, queries = views.document_units(spark, sf_dir), views.text_queries(spark, sf_dir)
    return _rounded(search.keyword_search(units, queries), "score")


@registered
def q_keyword_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    units, queries = views.page_units(spark, sf_dir), views.title_queries(spark, sf_dir)
    return _rounded(search.keyword_search(units, queries, k=3, body_cap=None), "score")


@registered
def q_keyword_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    units, queries = views.document_units(spark, sf_dir), views.text_queries(spark, sf_dir)
    found = search.keyword_search(units, queries, index=search.postings(units))
    return _rounded(search.describe(found, units), "score")


@registered
def q_semantic_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = views.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return _rounded(search.semantic_search(units, views.embedded_queries(spark, sf_dir)), "score")


@registered
def q_semantic_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same matches through clusters that are skipped by their bounds."""
    units = views.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    found = clusters.clustered_search(clusters.cluster_units(units, centres=32), views.embedded_queries(spark, sf_dir))
    return _rounded(found, "score")


@registered
def q_hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    units, queries = views.embedded_units(spark, sf_dir), views.embedded_queries(spark, sf_dir)
    return _rounded(search.hybrid_search(units, queries), "score")


@registered
def q_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector against the vector of the query of the same number."""
    items = views.embedded_queries(spark, sf_dir).select("query_id", F.col("embedding").alias("a"))
    labelled = views.table(spark, sf_dir, "embeddings").select(F.col("label").cast("bigint").alias("query_id"), "vec_id", F.col("embedding").alias("b"))
    pairs = runtime.lookup_join(labelled, items, ["query_id"], "inner", F.col("vec_id"), "a")
    return pairs.select("vec_id", F.round(vectors.dot(F.col("a"), F.col("b")), 6).alias("similarity"))


@registered
def q_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = views.table(spark, sf_dir, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double") * F.col("label")).alias("v"))
    return vectors.normalize(scaled, "v").select("vec_id", F.posexplode("v").alias("nth", "x")).withColumn(
        "x", F.round("x", 6))


@registered
def q_embed_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of the stand-in embedder."""
    found = vectors.embed_units(views.document_units(spark, sf_dir), dim=64)
    return _rounded(found.select("id", F.posexplode(F.col("embedding").cast("array<double>")).alias("nth", "x")), "x")


@registered
def q_embed_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vectors.embed_queries(views.text_queries(spark, sf_dir), dim=64)
    return _rounded(found.select("query_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("nth", "x")), "x")


@registered
def q_embed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.document_units(spark, sf_dir).select(
        "id", text.embedding_text(F.col("class_name"), F.col("name"), F.col("code")).alias("embedded"))


# --- index maintenance ----------------------------------------------------

@registered
def q_scan_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.scan_files(views.page_paths(spark, sf_dir), root="/srv/project", ignore=["**/spam-*/**"])


@registered
def q_changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.file_status(views.current_files(spark, sf_dir), views.stored_files(spark, sf_dir))


@registered
def q_forced_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.file_status(
        views.current_files(spark, sf_dir), views.stored_files(spark, sf_dir), force=True)


@registered
def q_stale_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One language's units lack the end of their range, so every file is due."""
    units = views.document_units(spark, sf_dir).withColumn(
        "end_offset", F.when(F.col("class_name") != "fr", F.col("end_offset")))
    return maintain.file_status(
        views.current_files(spark, sf_dir), views.stored_files(spark, sf_dir), units)


@registered
def q_upsert_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = views.stored_files(spark, sf_dir)
    changed = maintain.file_status(views.current_files(spark, sf_dir), stored).filter("reindex")
    return maintain.upsert_files(stored, changed)


@registered
def q_prune_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.prune_missing(views.stored_files(spark, sf_dir), views.current_files(spark, sf_dir))


@registered
def q_replace_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = views.document_units(spark, sf_dir).select("id", "name", "file_path", "code")
    paths = views.touched_paths(units)
    fresh = runtime.lookup_join(
        units, paths.withColumnRenamed("path", "file_path"), ["file_path"], "left_semi", F.col("id"), "file_path"
    ).withColumn("id", -F.col("id") - 1)
    return maintain.replace_by_file(units, fresh, paths)


@registered
def q_delete_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = views.part_units(spark, sf_dir)
    gone = units.filter(F.col("class_name") == "Brand#7").select(F.col("file_path").alias("path"))
    return maintain.delete_edges(views.part_edges(spark, sf_dir), units, gone)


@registered
def q_index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    current, stored = views.current_files(spark, sf_dir), views.stored_files(spark, sf_dir)
    stats = maintain.index_stats(maintain.file_status(current, stored), views.document_units(spark, sf_dir))
    return stats.withColumn("files", maintain.count_files(stored).scalar())


# --- extraction -----------------------------------------------------------

@registered
def q_segment_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.table(spark, sf_dir, "documents", "doc_id")
    return extract.segment_lines(docs, "doc_id", "text")


@registered
def q_call_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    scripts = views.page_scripts(spark, sf_dir)
    return extract.extract_calls(scripts).select("path", "name", "receiver", "at")


@registered
def q_extract_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_functions(views.generated_sources(spark, sf_dir)).select(
        "file_path", "name", "kind", "class_name", "start_offset", "end_offset", "start_line", "end_line", "code")


@registered
def q_extract_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = views.generated_sources(spark, sf_dir)
    return extract.extract_units_and_calls(sources).calls.select("file_path", "start_offset", "name", "receiver")


@registered
def q_rejected_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose brackets do not close."""
    return extract.rejected_sources(views.damaged_sources(spark, sf_dir))


# --- call graph -----------------------------------------------------------

@registered
def q_resolve_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = runtime.stored(views.part_calls(spark, sf_dir))
    resolved = callgraph.resolve_calls(views.part_units(spark, sf_dir), calls)
    answers = ["caller_id", "name", "receiver", "callee_id", "rule"]
    return runtime.dealt(resolved, calls.count(), *answers).groupBy(*answers).agg(F.count("*").alias("n"))


@registered
def q_call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return callgraph.build_call_graph(views.part_units(spark, sf_dir), runtime.stored(views.part_calls(spark, sf_dir)))


@registered
def q_update_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that end in an odd digit were indexed again, some of their units under another name."""
    units, calls = views.part_units(spark, sf_dir), runtime.stored(views.part_calls(spark, sf_dir))
    now, now_calls = views.edited_parts(units), runtime.stored(views.edited_calls(units, calls))
    gone = maintain.of_files(units, views.touched_paths(units))
    stayed, fresh = now.filter("id >= 0"), now.filter("id < 0")
    names = callgraph.changed_names(gone, fresh)
    edges = runtime.stored(callgraph.named_edges(callgraph.resolve_calls(units, calls)))
    again = callgraph.edges_again(stayed.unionByName(fresh), now_calls.filter("caller_id >= 0"), now_calls.filter("caller_id < 0"), names)
    return callgraph.merge_edges(edges, again, names, gone)


def _expanded(spark: SparkSession, sf_dir: str, depth: int) -> DataFrame:
    return expand.expand(
        views.part_matches(spark, sf_dir), views.part_edges(spark, sf_dir), views.part_units(spark, sf_dir), depth)


@registered
def q_expand_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _expanded(spark, sf_dir, 1)


@registered
def q_expand_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _expanded(spark, sf_dir, 2)


# --- context and evaluation -----------------------------------------------

@registered
def q_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    units, queries = views.document_units(spark, sf_dir), views.text_queries(spark, sf_dir)
    return context.build_context(search.keyword_search(units, queries, k=6), units, queries)


@registered
def q_context_expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    units, queries = views.part_units(spark, sf_dir), views.part_queries(spark, sf_dir)
    found = expand.expand(views.part_matches(spark, sf_dir), views.part_edges(spark, sf_dir), units, 1)
    return context.build_context(found, units, queries)


@registered
def q_result_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    units, queries = views.document_units(spark, sf_dir), views.text_queries(spark, sf_dir)
    return context.result_lines(search.keyword_search(units, queries), units)


@registered
def q_result_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    units, queries = views.document_units(spark, sf_dir), views.text_queries(spark, sf_dir)
    return context.result_summary(search.keyword_search(units, queries), units, queries)


@registered
def q_result_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    units, queries = views.document_units(spark, sf_dir), views.text_queries(spark, sf_dir)
    return context.result_listing(search.keyword_search(units, queries), units, queries)


@registered
def q_retrieval_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole corpus, keyword search and hybrid search side by side."""
    units, queries = views.embedded_units(spark, sf_dir), views.embedded_queries(spark, sf_dir)
    plain = views.document_units(spark, sf_dir)
    methods = {
        evaluate.KEYWORD: search.keyword_search(plain, queries, k=3),
        evaluate.HYBRID: search.hybrid_search(units, queries, k=3)}
    quality = evaluate.compare_methods(
        methods, plain, queries, views.shared_sentences(spark, sf_dir), views.document_files(spark, sf_dir))
    return _rounded(quality, "token_reduction_percent", "precision", "recall")


@registered
def q_query_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    units, queries = views.document_units(spark, sf_dir), views.text_queries(spark, sf_dir)
    per = evaluate.per_query(
        search.keyword_search(units, queries, k=3), units, queries, views.shared_sentences(spark, sf_dir),
        evaluate.corpus_tokens(views.document_files(spark, sf_dir)))
    return _rounded(per, "precision", "recall", "token_reduction_percent")


@registered
def q_corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.corpus_summary(
        views.document_files(spark, sf_dir), views.document_units(spark, sf_dir), views.text_queries(spark, sf_dir))


@registered
def q_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report text over the keyword evaluation, with fixed times."""
    units, queries = views.document_units(spark, sf_dir), views.text_queries(spark, sf_dir)
    corpus_files = views.document_files(spark, sf_dir)
    quality = evaluate.compare_methods(
        {evaluate.KEYWORD: search.keyword_search(units, queries, k=3)},
        units, queries, views.shared_sentences(spark, sf_dir), corpus_files)
    metrics = quality.withColumns({
        "indexing_ms": F.when(F.col("method") != evaluate.FULL, F.lit(2000.0)), "retrieval_latency_ms": F.lit(1.0)})
    return report.format_report(
        metrics, evaluate.corpus_summary(corpus_files, units, queries), "2026-01-01T00:00:00.000Z")
