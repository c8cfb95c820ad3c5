import os
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from test_mixing import plain_targets
from test_simhash import plain_components, plain_fingerprint

SF_DIR = "/root/testdata/sf0.001"


def test_stages_in_order_and_rows_of_run(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "language ID", "simhash near-dedup", "mixing sources", "packing"]
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    columns, seen = docs.columns, {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF_DIR).cache()
        rows = after.collect()
        assert after.columns == columns
        left = {r.doc_id for r in rows}
        assert left <= seen
        if name == "quality classifier":
            known = [i for i in seen if i in labels]
            assert sum((i in left) == bool(labels[i]) for i in known) / len(known) > 0.95
        elif name == "language ID":
            assert left == {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
        elif name == "simhash near-dedup":
            before = docs.collect()
            groups = plain_components([plain_fingerprint(r.text) for r in before], [r.doc_id for r in before])
            assert sorted(r.doc_id for r in rows) == sorted(set(groups))
        else:
            sizes, taken, longest = {}, {}, {}
            for r in docs.collect():
                n = len((r.text or "").split())
                sizes[r.source] = sizes.get(r.source, 0) + n
                longest[r.source] = max(longest.get(r.source, 0), n)
            for r in rows:
                taken[r.source] = taken.get(r.source, 0) + len((r.text or "").split())
            for source, target in plain_targets(sizes).items():
                assert abs(taken.get(source, 0) - target) <= longest[source] + 1e-6
        docs, seen = after, left
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    assert sorted(map(tuple, packed.collect())) == sorted(map(tuple, corpus_pipeline.run(spark, SF_DIR).collect()))
    assert packed.count() == docs.count()


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES, ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_nulls_repeats_and_empty_tables(spark, name, stage):
    rows = [(1, "the boat and the harbour of the town", "en", "a", 5), (1, "the boat and the harbour of the town", "en", "a", 5), (None, None, None, None, None),
            (None, "le bateau est dans le port de la ville", "fr", None, 0), (2, "", "en", "a", 0), (3, " \n\t", None, "b", None), (4, "word " * 30_000, "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumns(
        {"score": F.lit("x"), "fp": F.lit(1), "host": F.lit(0), "size": F.lit("y"), "digest": F.lit(2), "copies": F.lit(0), "n_tokens": F.lit("z"), "bucket": F.lit(1)})
    out = stage(spark, docs, SF_DIR)
    if name != "packing":
        assert out.columns == docs.columns
    out.collect()
    assert stage(spark, docs.limit(0), SF_DIR).count() == 0


def test_the_rest_imports_without_this_subpackage(tmp_path):
    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    shutil.copytree(os.path.join(root, "unitquarry"), tmp_path / "unitquarry", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; assert not [q for q in e.queries() if q[:2] == 'op' or q == 'pipeline']; print(len(e.queries()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert done.returncode == 0 and int(done.stdout) > 30, done.stderr
