import os

import pytest
from pyspark.sql import functions as F

import brute
import corpus
from unitquarry import index as idx
from unitquarry.functions.vectors import embed_queries
from unitquarry.operators import maintain
from unitquarry.sources import files as trees


def write(root, path, text):
    full = os.path.join(root, path)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "w") as f:
        f.write(text)


def tree(tmp_path):
    root = str(tmp_path / "project")
    for path, text in corpus.SOURCES.items():
        write(root, path, text)
    return root


def units_of(index):
    rows = index.units.orderBy("file_path", "start_offset").collect()
    return [(r.file_path, r.name, r.kind, r.class_name, r.start_offset, r.code) for r in rows]


def edges_of(index):
    names = {r.id: r.name for r in index.units.select("id", "name").collect()}
    return {(names[e.caller_id], names[e.callee_id]) for e in index.edges.collect()}


def test_listing_finds_every_source_file(spark, tmp_path):
    root = str(tmp_path)
    wanted = ["a.ts", "_app.tsx", "__tests__/b.jsx", "deep/er/c.mjs", "d.cjs", "e.js", "builder/f.ts", "x.min.ts"]
    ignored = [
        "node_modules/a.ts", "deep/node_modules/b.js", "dist/c.js", "pkg/build/d.ts", ".git/e.js", "coverage/f.js", "types.d.ts",
        "lib/g.min.js", ".hidden.ts", "deep/.cache/h.ts", "i.py", "j.TS", "k.ts.bak", "gen/l.ts"]
    for path in wanted + ignored:
        write(root, path, "x")
    found = trees.list_tree(spark, root, ["gen/**"]).collect()
    assert {r.path for r in found} == set(wanted)
    stat = os.stat(os.path.join(root, "a.ts"))
    [a] = [r for r in found if r.path == "a.ts"]
    assert (a.mtime_ms, a.size) == (stat.st_mtime_ns // 1_000_000, 1)
    table = spark.createDataFrame([(f"file:{root}/{p}",) for p in wanted + ignored], "path string")
    assert {r.path for r in trees.scan_files(table, root, ["gen/**"]).collect()} == set(wanted)
    through_reader = {r.path for r in trees.binary_sources(spark, root, ["gen/**"]).select("path").collect()}
    assert through_reader == {p for p in wanted if not p.startswith("_")}


def test_globs():
    import re
    def hit(glob, path):
        return re.match(trees.glob_pattern(glob), path) is not None
    assert hit("**/dist/**", "dist/a") and hit("**/dist/**", "a/b/dist/c/d") and not hit("**/dist/**", "distant/a")
    assert hit("src/*.ts", "src/a.ts") and not hit("src/*.ts", "src/b/a.ts") and hit("**/*.{js,ts}", "q/a.js")
    assert hit("a?[0-9].ts", "ab3.ts") and not hit("a?[!0-9].ts", "ab3.ts")


def test_bad_bytes_become_replacement_characters(spark, tmp_path):
    with open(tmp_path / "a.js", "wb") as f:
        f.write(b"f(\xff)")
    files = trees.list_tree(spark, str(tmp_path))
    assert trees.read_contents(files, str(tmp_path)).first().content == "f(�)"


def test_build_update_and_query(spark, tmp_path):
    root, folder = tree(tmp_path), str(tmp_path / "index")
    first = idx.index_project(spark, root, folder)
    assert first.stats.first().asDict() == {"files_scanned": 3, "functions_indexed": len(corpus.FUNCTIONS)}
    rows = first.units.orderBy("id").collect()
    assert [r.id for r in rows] == list(range(1, len(corpus.FUNCTIONS) + 1))
    assert [(r.file_path, r.name, r.kind, r.class_name) for r in rows] == corpus.FUNCTIONS
    assert edges_of(first) == corpus.EDGES
    assert all(len(r.embedding) == 384 for r in rows)

    again = idx.index_project(spark, root, folder)
    assert again.stats.first().files_scanned == 0 and units_of(again) == units_of(first)
    assert again.edges.exceptAll(first.edges).isEmpty() and again.version == 1

    write(root, "mail.js", corpus.SOURCES["mail.js"] + "\nfunction rebateMail() { return deliver(); }\n")
    write(root, "new/extra.ts", "export function extra() { return highest(); }\n")
    os.remove(os.path.join(root, "orders/cart.ts"))
    third = idx.index_project(spark, root, folder)
    assert third.stats.first().files_scanned == 2
    fresh = third.units.filter(F.col("file_path").isin("mail.js", "new/extra.ts")).select(F.min("id")).first()[0]
    assert fresh == len(corpus.FUNCTIONS) + 1
    assert ("extra", "highest") in edges_of(third) and ("rebateMail", "deliver") in edges_of(third)
    assert third.files.count() == 4  # a file that is gone stays

    pruned = idx.index_project(spark, root, folder, prune_missing=True)
    full = idx.index_project(spark, root, str(tmp_path / "other"))
    assert units_of(pruned) == units_of(full) and edges_of(pruned) == edges_of(full)
    assert pruned.files.exceptAll(full.files).isEmpty() and full.files.count() == pruned.files.count()
    forced = idx.index_project(spark, root, folder, force=True)
    assert forced.stats.first().files_scanned == 3 and units_of(forced) == units_of(full)

    queries = spark.createDataFrame(corpus.QUERIES, "query_id bigint, text string")
    found = idx.search_keyword(full, queries, 3).collect()
    units = [r.asDict() for r in full.units.collect()]
    for query_id, text in corpus.QUERIES:
        scores = {u["id"]: round(brute.keyword_score(text, u), 12) for u in units}
        got = sorted((r.pos, r.id, round(r.score, 9)) for r in found if r.query_id == query_id)
        assert got == [(p + 1, i, round(s, 9)) for p, (i, s) in enumerate(brute.rank(scores, 3))]
    plain = idx.search(full, queries, 3).count()
    wide = idx.search(full, queries, 3, expand_dependencies=True, depth=2)
    assert wide.filter("relationship IS NULL").count() == plain < wide.count()
    texts = {r.query_id: r.context for r in idx.build_context(full, queries, 2, True).collect()}
    assert "// TideTable.highest()\n// harbor/tides.ts:7-9 (score: " in texts[1] and "(called-by, depth 1)\nexport function extra" in texts[1]


def test_failed_run_leaves_the_index_as_it_was(spark, tmp_path):
    root, folder = tree(tmp_path), str(tmp_path / "index")
    first = idx.index_project(spark, root, folder, with_vectors=False)
    write(root, "mail.js", "function changed() { return 1 }")

    def broken():
        raise RuntimeError("no model")

    with pytest.raises(Exception, match="no model"):
        idx.index_project(spark, root, folder, make_embedder=broken)
    assert idx.load_index(spark, folder).version == first.version == 1
    assert "changed" in {u[1] for u in units_of(idx.index_project(spark, root, folder, with_vectors=False))}


def test_status_rules(spark):
    stored = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("c", 1, 1), ("gone", 1, 1)], "path string, mtime_ms bigint, size bigint")
    current = spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("c", 1, 2), ("d", 1, 1)], "path string, mtime_ms bigint, size bigint")
    ranged = spark.createDataFrame([(1, 0, 5)], "id bigint, start_offset int, end_offset int")
    stale = spark.createDataFrame([(1, 0, 5), (2, 3, None)], "id bigint, start_offset int, end_offset int")

    def due(**options):
        return {(r.path, r.status, r.reindex) for r in maintain.file_status(current, stored, **options).collect()}

    normal = {("a", "unchanged", False), ("b", "changed", True), ("c", "changed", True), ("d", "new", True)}
    everything = {(p, s, True) for p, s, _ in normal}
    assert due() == due(stored_units=ranged) == normal
    assert due(force=True) == due(stored_units=stale) == everything
    assert {r.path for r in maintain.prune_missing(stored, current).collect()} == {"gone"}


def test_plan_reads_no_content_for_metadata(spark, tmp_path):
    root = tree(tmp_path)
    plan = trees.binary_sources(spark, root).select("path", "size")._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert "ReadSchema: struct<path:string,length:bigint>" in plan


def test_ignored_names_leave_out_a_file_or_what_is_below_a_folder(spark, tmp_path):
    root = str(tmp_path)
    for path in ["a.ts", "b/c.ts", "d/b/e.ts", "d/x.ts", "x/y.ts", "_app/f.tsx"]:
        write(root, path, "x")

    def listed(ignore):
        found = {r.path for r in trees.list_tree(spark, root, ignore).collect()}
        table = spark.createDataFrame([(f"{root}/{p}",) for p in ["a.ts", "b/c.ts", "d/b/e.ts", "d/x.ts", "x/y.ts", "_app/f.tsx"]], "path string")
        assert found == {r.path for r in trees.scan_files(table, root, ignore).collect()}
        return found

    assert listed(["**/x"]) == {"a.ts", "b/c.ts", "d/b/e.ts", "d/x.ts", "_app/f.tsx"}
    assert listed(["b"]) == {"a.ts", "d/b/e.ts", "d/x.ts", "x/y.ts", "_app/f.tsx"}
    assert listed(["**/b/**", "_app/**"]) == {"a.ts", "d/x.ts", "x/y.ts"}
    assert {r.path for r in trees.list_tree(spark, "file://" + root, ["d"]).collect()} == {"a.ts", "b/c.ts", "x/y.ts", "_app/f.tsx"}


def test_the_reader_of_spark_takes_bad_bytes_too(spark, tmp_path):
    with open(tmp_path / "a.js", "wb") as f:
        f.write(b"f(\xff)")
    assert trees.binary_sources(spark, str(tmp_path)).select("content").first().content == "f(�)"


def test_an_unclosed_file_does_not_stop_incremental_runs(spark, tmp_path):
    root, folder = str(tmp_path / "p"), str(tmp_path / "index")
    write(root, "open.js", "function f() { if (x) {")
    write(root, "b.js", "function g() { f() }")
    first = idx.index_project(spark, root, folder, with_vectors=False)
    assert first.units.filter("code IS NULL OR end_offset IS NULL").isEmpty()
    again = idx.index_project(spark, root, folder, with_vectors=False)
    assert again.stats.first().files_scanned == 0 and again.version == 1
    queries = spark.createDataFrame([(1, "what is f")], "query_id bigint, text string")
    with pytest.raises(ValueError, match="whole bodies"):
        from unitquarry.operators import search
        search.keyword_search(again.units, queries, body_cap=500, index=again.postings)


def test_a_word_far_down_a_body_is_found(spark, tmp_path):
    from unitquarry.operators import search
    units = spark.createDataFrame([(1, "f", None, "plain " * 800 + "needle needle needle needle needle"), (2, "g", None, "plain")],
                                  "id bigint, name string, class_name string, code string")
    queries = spark.createDataFrame([(1, "needle")], "query_id bigint, text string")
    assert [r.id for r in search.keyword_search(units, queries).collect()] == [1]
    assert [r.id for r in search.keyword_search(units, queries, index=search.postings(units)).collect()] == [1]
    assert search.keyword_search(units, queries, body_cap=500).isEmpty()


def test_a_touched_file_writes_only_its_rows(spark, tmp_path, monkeypatch):
    root, folder = tree(tmp_path), str(tmp_path / "index")
    first = idx.index_project(spark, root, folder, with_vectors=False)
    assert os.listdir(os.path.join(folder, "staging")) == []
    write(root, "mail.js", corpus.SOURCES["mail.js"] + "\nfunction added() { return highest(); }\n")
    second = idx.index_project(spark, root, folder, with_vectors=False)
    assert len(second.runs) == 2 and second.runs[0] == first.runs[0]
    at = f"{folder}/runs/{second.runs[1]['run']}"
    rows = spark.read.parquet(f"{at}/units")
    assert {r.file_path for r in rows.collect()} == {"mail.js"}
    ids, names = {r.id for r in rows.collect()}, {r.name for r in spark.read.parquet(f"{at}/names").collect()}
    assert {r.id for r in spark.read.parquet(f"{at}/postings").collect()} <= ids
    assert {r.caller_id for r in spark.read.parquet(f"{at}/calls").collect()} <= ids
    assert all(r.caller_id in ids or r.name in names for r in spark.read.parquet(f"{at}/edges").collect())
    assert [r.path for r in spark.read.parquet(f"{at}/files").collect()] == ["mail.js"]

    full = idx.index_project(spark, root, str(tmp_path / "other"), with_vectors=False)
    packed = idx.compact(spark, folder)
    assert len(packed.runs) == 1 and packed.version == second.version
    for index in (second, packed):
        assert units_of(index) == units_of(full) and edges_of(index) == edges_of(full)
        assert index.files.exceptAll(full.files).isEmpty() and index.files.count() == full.files.count()
        names = {r.id: (r.file_path, r.start_offset) for r in index.units.collect()}
        other = {r.id: (r.file_path, r.start_offset) for r in full.units.collect()}
        tokens = lambda i, n: sorted((r.token, n[r.id], r.tf) for r in i.postings.collect())
        assert tokens(index, names) == tokens(full, other) and index.calls.count() == full.calls.count()


def test_two_runs_at_once(spark, tmp_path):
    """The run that commits second raises, and its rows are never seen."""
    root, folder = tree(tmp_path), str(tmp_path / "index")
    idx.index_project(spark, root, folder, with_vectors=False)
    write(root, "a.ts", "function fromOuter() { return 1 }")
    listed = trees.list_tree(spark, root)
    inner = []

    def read(due):
        # The other run starts and ends while this one reads.
        if not inner:
            inner.append(idx.index_project(spark, root, folder, with_vectors=False))
        return trees.read_contents(due, root)

    with pytest.raises(idx.ConcurrentRun):
        idx.build_index(listed, folder, read, with_vectors=False)
    now = idx.load_index(spark, folder)
    assert now.commit == inner[0].commit and units_of(now) == units_of(inner[0])
    assert "fromOuter" in {u[1] for u in units_of(now)} and now.units.select("id").distinct().count() == now.units.count()
    again = idx.build_index(listed, folder, read, with_vectors=False)
    assert again.stats.first().files_scanned == 0


def test_many_runs_are_compacted(spark, tmp_path, monkeypatch):
    from unitquarry.sources import snapshot
    monkeypatch.setattr(snapshot, "MAX_RUNS", 1)
    root, folder = tree(tmp_path), str(tmp_path / "index")
    idx.index_project(spark, root, folder, with_vectors=False)
    write(root, "b.ts", "function late() { return deliver() }")
    index = idx.index_project(spark, root, folder, with_vectors=False)
    assert len(index.runs) == 1 and index.version == 2 and ("late", "deliver") in edges_of(index)


def test_a_text_is_embedded_once(spark, tmp_path):
    """Over all units and runs, until a run is forced; copies share the vector."""
    root, folder, seen = tree(tmp_path), str(tmp_path / "index"), str(tmp_path / "seen")
    os.makedirs(seen)

    def counting():
        import uuid
        import numpy as np

        def embed(texts):
            with open(f"{seen}/{uuid.uuid4().hex}", "w") as f:
                f.write("\0".join(texts))
            return np.array([[len(t), sum(map(ord, t)) % 97, 1.0] for t in texts])
        return embed

    def handed():
        out = []
        for name in sorted(os.listdir(seen)):
            with open(os.path.join(seen, name)) as f:
                out += f.read().split("\0")
            os.remove(os.path.join(seen, name))
        return sorted(out)

    def texts_of(index):
        rows = index.units.collect()
        assert all(r.embedding is not None and abs(sum(x * x for x in r.embedding) - 1) < 1e-5 for r in rows)
        names = {r.id: (f"{r.class_name}.{r.name}" if r.class_name else r.name) + "\n" + r.code for r in rows}
        vectors = {}
        for r in rows:
            assert vectors.setdefault(names[r.id], r.embedding) == r.embedding
        return set(vectors)

    copy = "function twin() { return 1 }\n"
    write(root, "p.js", copy)
    write(root, "q.js", copy * 2)
    first = idx.index_project(spark, root, folder, make_embedder=counting, embedder="counting")
    assert handed() == sorted(texts_of(first))
    write(root, "q.js", copy * 3 + "function fresh() { return 2 }\n")
    second = idx.index_project(spark, root, folder, make_embedder=counting, embedder="counting")
    assert [t.split("\n")[0] for t in handed()] == ["fresh"]
    assert second.units.filter("name = 'twin'").count() == 4 and second.vectors.count() == len(texts_of(second))
    # Another embedder's vectors are its own, also of a text that is known.
    write(root, "r.js", copy)
    assert idx.index_project(spark, root, folder).units.filter("file_path = 'r.js'").first().embedding is not None
    write(root, "r.js", "function last() { return 3 }")
    packed = idx.compact(spark, idx.index_project(spark, root, folder, make_embedder=counting, embedder="counting").folder)
    assert [t.split("\n")[0] for t in handed()] == ["last"]
    # The text of twin has a vector of either embedder.
    assert packed.vectors.count() == len(texts_of(packed)) + 1
    write(root, "s.js", copy + "function last() { return 3 }")
    idx.index_project(spark, root, folder, make_embedder=counting, embedder="counting")
    assert handed() == []
    forced = idx.index_project(spark, root, folder, force=True, make_embedder=counting, embedder="counting")
    assert handed() == sorted(texts_of(forced)) and forced.vectors.count() == len(texts_of(forced))


def test_only_plain_functions_name_their_vectors():
    import functools
    from unitquarry.functions.vectors import embedder_name
    assert embedder_name(tree) == f"{tree.__module__}.tree" and embedder_name(None)
    assert [embedder_name(f) for f in (lambda: None, functools.partial(tree, 1), (lambda n: functools.wraps(embedder_name)(lambda: n))(1).__wrapped__.__get__(1))] == [None] * 3
