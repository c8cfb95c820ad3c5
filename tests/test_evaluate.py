import json
import math

import pytest

import brute
import corpus
from unitquarry import index as idx
from unitquarry.operators import context, evaluate
from unitquarry.sources import report

UNITS = "id bigint, name string, class_name string, file_path string, start_line int, end_line int, code string"


def test_report_text(spark, tmp_path):
    metrics = spark.createDataFrame([
        ("Keyword Search", 250.0, 41.25, 91.36, 0.375, 0.5), ("Full Repository", None, 6.5, 0.0, 0.0625, 1.0), ("Other", 4000.0, 0.04, -3.0, 0.0, 0.0),
        ("Hybrid Search", 250.0, 77.77, 90.0, 0.25, 0.9375)],
        "method string, indexing_ms double, retrieval_latency_ms double, token_reduction_percent double, precision double, recall double")
    summary = spark.createDataFrame([(17, 65, 8, 4321)], "files int, functions int, scenarios int, estimated_repository_tokens bigint")
    lines = report.format_report(metrics, summary, "a Tuesday").first().report.split("\n")
    assert lines[2] == "Generated: a Tuesday"
    assert lines[4] == "Corpus: 17 files, 65 functions, 8 queries, ~4321 repository tokens."
    assert lines[6].startswith("| Method | Indexing speed |")
    assert lines[8:12] == [
        "| Full Repository | N/A | 6.5 ms | 0.0% | 6.3% | 100.0% |",
        "| Keyword Search | 260.0 funcs/s (250.0 ms) | 41.3 ms | 91.4% | 37.5% | 50.0% |",
        "| Hybrid Search | 260.0 funcs/s (250.0 ms) | 77.8 ms | 90.0% | 25.0% | 93.8% |",
        "| Other | 16.3 funcs/s (4000.0 ms) | 0.0 ms | -3.0% | 0.0% | 0.0% |"]
    assert lines[12] == "" and lines[13].startswith("- ") and lines[-1] == ""
    report.write_report(metrics, summary, str(tmp_path / "out"), "then")
    assert spark.read.text(str(tmp_path / "out.md"), wholetext=True).first().value.rstrip("\n") == "\n".join(
        lines).replace("a Tuesday", "then").rstrip("\n")
    written = json.loads(spark.read.text(str(tmp_path / "out.json")).first().value)
    assert written["corpus"]["functions"] == 65 and {m["method"] for m in written["methods"]} == {m.method for m in metrics.collect()}


def test_metrics_by_hand(spark):
    units = spark.createDataFrame([
        (1, "a", None, "f", 1, 1, "x" * 9), (2, "a", None, "f", 2, 2, "y" * 40), (3, "b", None, "f", 3, 3, "z" * 4), (4, "c", None, "g", 1, 1, "")], UNITS)
    queries = spark.createDataFrame([(1, "q"), (2, "r"), (3, "s")], "query_id bigint, text string")
    qrels = spark.createDataFrame([(1, "f:a"), (1, "g:c"), (1, "g:none"), (2, "f:b"), (2, "f:b")], "query_id bigint, key string")
    files = spark.createDataFrame([("f", "x" * 101), ("g", "")], "path string, content string")
    results = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 4)], "query_id bigint, id bigint")
    tokens = evaluate.corpus_tokens(files)
    assert tokens.first().tokens == 26
    rows = {r.query_id: r for r in evaluate.per_query(results, units, queries, qrels, tokens).collect()}
    # The second unit of key f:a is charged like the first.
    assert (rows[1].returned, rows[1].hits, rows[1].relevant) == (3, 1, 3)
    assert rows[1].precision == pytest.approx(1 / 3) and rows[1].token_reduction_percent == pytest.approx(100 * (1 - 7 / 26))
    assert (rows[2].hits, rows[2].relevant, rows[2].precision, rows[2].recall) == (0, 1, 0.0, 0.0)
    assert (rows[3].returned, rows[3].precision, rows[3].recall, rows[3].token_reduction_percent) == (0, 0.0, 0.0, 100.0)
    full = {r.query_id: r for r in evaluate.per_query_full(units, queries, qrels).collect()}
    assert (full[1].hits, full[1].precision, full[1].recall, full[1].token_reduction_percent) == (2, 0.5, pytest.approx(2 / 3), 0.0)
    compared = {r.method: r for r in evaluate.compare_methods({"Keyword Search": results}, units, queries, qrels, files).collect()}
    assert compared["Keyword Search"].precision == pytest.approx((1 / 3) / 3)
    assert compared["Full Repository"].recall == pytest.approx((2 / 3 + 1) / 3)


def test_methods_are_judged_in_one_pass(spark, monkeypatch):
    units = spark.createDataFrame([(i, f"n{i % 5}", None, "f", i, i, "x" * (7 * i % 40)) for i in range(12)], UNITS)
    queries = spark.createDataFrame([(i, "q") for i in range(6)], "query_id bigint, text string")
    qrels = spark.createDataFrame([(q, f"f:n{(q + j) % 5}") for q in range(4) for j in range(q)], "query_id bigint, key string")
    files = spark.createDataFrame([("f", "x" * 900)], "path string, content string")
    methods = {
        f"m{k}": spark.createDataFrame([(q, (q * k + j) % 12) for q in range(5) for j in range(k)], "query_id bigint, id bigint") for k in range(4)}
    tokens = evaluate.corpus_tokens(files)
    rows = {r.method: r for r in evaluate.compare_methods(methods, units, queries, qrels, files).collect()}
    assert list(rows) == ["Full Repository", *methods]
    for name, results in methods.items():
        alone = evaluate.per_query(results, units, queries, qrels, tokens).collect()
        assert len(alone) == 6
        for measure in evaluate.MEASURES:
            assert rows[name][measure] == pytest.approx(sum(r[measure] for r in alone) / 6)
    # As many checkpoints for three methods as for one.
    cuts, plain = [], evaluate.runtime.cut
    monkeypatch.setattr(evaluate.runtime, "cut", lambda df: cuts.append(1) or plain(df))
    evaluate.compare_methods({"m1": methods["m1"]}, units, queries, qrels, files)
    one = len(cuts)
    evaluate.compare_methods(methods, units, queries, qrels, files)
    assert len(cuts) == 2 * one
    none = evaluate.compare_methods(methods, units, queries.limit(0), qrels, files).collect()
    assert [r.method for r in none] == ["Full Repository", *methods] and all(r.recall is None for r in none)


def test_benchmark_run(spark, tmp_path):
    sources = spark.createDataFrame(list(corpus.SOURCES.items()), "path string, content string")
    queries = spark.createDataFrame(corpus.QUERIES, "query_id bigint, text string")
    qrels = spark.createDataFrame(corpus.QRELS, "query_id bigint, key string")
    metrics, summary = idx.run_benchmark(sources, queries, qrels, str(tmp_path / "index"))
    total = sum(math.ceil(len(t) / 4) for t in corpus.SOURCES.values())
    assert tuple(summary.first()) == (3, len(corpus.FUNCTIONS), 3, total)
    rows = {r.method: r for r in metrics.collect()}
    units = [r.asDict() for r in idx.load_index(spark, str(tmp_path / "index")).units.collect()]
    precision = recall = 0.0
    for query_id, text in corpus.QUERIES:
        best = brute.rank({u["id"]: round(brute.keyword_score(text, u), 12) for u in units}, 3)
        keys = [f"{u['file_path']}:{u['name']}" for i, _ in best for u in units if u["id"] == i]
        wanted = {k for q, k in corpus.QRELS if q == query_id}
        precision += len(wanted & set(keys)) / len(keys) / 3 if keys else 0
        recall += len(wanted & set(keys)) / len(wanted) / 3
    assert rows["Keyword Search"].precision == pytest.approx(precision) and rows["Keyword Search"].recall == pytest.approx(recall)
    assert rows["Full Repository"].recall == 1.0 and rows["Full Repository"].indexing_ms is None
    assert rows["Hybrid Search"].retrieval_latency_ms > 0 and rows["Hybrid Search"].indexing_ms > 0


def test_context_and_listings(spark):
    units = spark.createDataFrame([
        (1, "open", "Gate", "gate.ts", 3, 5, "open() {\n}"), (2, "help", None, "util.ts", 1, 1, "function help() {}")], UNITS)
    queries = spark.createDataFrame([(1, "open gate"), (2, "nothing")], "query_id bigint, text string")
    results = spark.createDataFrame(
        [(1, 2, 2, 0.0, "calls", 1), (1, 1, 1, 0.456, None, None), (1, 3, 77, 0.0, "calls", 1)],
        "query_id bigint, pos int, id bigint, score double, relationship string, expansion_depth int")
    texts = {r.query_id: r.context for r in context.build_context(results, units, queries).collect()}
    assert texts[1] == (
        "// Gate.open()\n// gate.ts:3-5 (score: 0.46)\nopen() {\n}\n\n// ----------------------------------------\n\n"
        "// help()\n// util.ts:1-1 (calls, depth 1)\nfunction help() {}")
    assert texts[2].startswith('// No relevant functions found for query: "nothing"\n// ')
    lines = {r.query_id: r.summary for r in context.result_summary(results, units, queries).collect()}
    assert lines[1] == "Gate.open() — gate.ts:3 (score: 0.46)\nhelp() — util.ts:1 (calls, depth 1)"
    assert lines[2].startswith('No matches found for "nothing"')
    listing = {r.query_id: r.listing for r in context.result_listing(results, units, queries).collect()}
    assert listing[1] == (
        "Gate.open()\ngate.ts:3-5\nScore: 0.46\n--------------------\nhelp()\nutil.ts:1-1\nRelationship: calls (depth 1)")


def test_sentences_meet_the_queries_before_they_move(spark, tmp_path):
    """Labels shuffle only sentences that some query has; repeats and short pieces change nothing."""
    from unitquarry.plans import views

    shared = "the harbor opens when the tide is high"
    spark.createDataFrame(
        [(1, f"One. {shared}. {shared}\nA sentence that no query has at all", "en", "web", 9), (2, f"Two. {shared.upper()}.", "en", "web", 9),
         (3, f"One.\n  {shared}  \n", "en", "web", 9), (4, None, "en", "web", 0), (5, f"Five. {shared}", "en", None, 9)],
        "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, f"Why. {shared}. {shared}."), (8, "One."), (9, f"{shared}\nTwo.")], "item_id bigint, text string").write.parquet(
        str(tmp_path / "benchmark.parquet"))
    found = views.shared_sentences(spark, str(tmp_path))
    plan = found._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line and "key#" in line]
    assert moved and not any("sentence#" in line for line in moved)
    assert sorted(tuple(r) for r in found.collect()) == [(7, "Five"), (7, "web:One"), (9, "Five"), (9, "web:One")]
