import numpy as np
import pytest
from pyspark.sql import functions as F

from unitquarry import runtime
from unitquarry.operators import clusters, search


def groups(n=600, dim=12, seed=2):
    """Unit vectors around a few far directions, some equal, one without a vector, one that is no number."""
    rng = np.random.default_rng(seed)
    far = np.eye(dim)[:6]
    vectors = far[np.arange(n) % 6] + rng.normal(0, 0.03, (n, dim))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors[10:16] = vectors[10]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(vectors)]
    return rows + [(n, None)], far


def answers(frame):
    return sorted((r.query_id, r.pos, r.id, r.score) for r in frame.collect())


@pytest.fixture
def tables(spark):
    rows, far = groups()
    units = spark.createDataFrame(rows, "id bigint, embedding array<float>").repartition(5)
    asked = [(i, [float(x) for x in far[i % 6] * (0.5 + i)]) for i in range(9)] + [(20, [0.0] * 12), (21, None), (22, [0.3] * 12)]
    return units, spark.createDataFrame(asked, "query_id bigint, embedding array<float>")


@pytest.mark.parametrize("k", [0, 1, 7, 200])
def test_same_matches_as_a_whole_scan(spark, tables, k):
    units, queries = tables
    made = clusters.cluster_units(units, centres=20)
    assert answers(clusters.clustered_search(made, queries, k)) == answers(search.semantic_search(units, queries, k))


def test_clusters_are_skipped_and_rows_not_copied(spark, tables, monkeypatch, tmp_path):
    units, queries = tables
    made = clusters.cluster_units(units, str(tmp_path / "clusters"), centres=20)
    assert made.rows.count() == 600 and made.table.agg(F.sum("units")).first()[0] == 600
    open_pairs, scanned, whole = [], [], clusters._scan

    def counted(rows, open_, numbers, *rest):
        open_pairs.append(open_.sum())
        scanned.append(rows.filter(F.col("cluster").isin([int(numbers[c]) for c in np.flatnonzero(open_.any(axis=0))])).count())
        return whole(rows, open_, numbers, *rest)

    monkeypatch.setattr(clusters, "_scan", counted)
    monkeypatch.setattr(runtime, "BROADCAST_BYTES", 600)
    got = clusters.clustered_search(made, queries.filter("query_id < 9"), 3)
    assert answers(got) == answers(search.semantic_search(units, queries.filter("query_id < 9"), 3))
    assert len(open_pairs) > 2 and sum(open_pairs) < 0.5 * 9 * made.table.count()
    assert max(scanned) <= 600
    plan = got._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert "Generate" not in plan and "CartesianProduct" not in plan and "FlatMapCoGroups" not in plan


def test_odd_vectors(spark):
    rows = [(1, [float("nan"), 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [float("inf"), 0.0])]
    units = spark.createDataFrame(rows, "id bigint, embedding array<float>")
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id bigint, embedding array<float>")
    made = clusters.cluster_units(units, centres=3)
    assert answers(clusters.clustered_search(made, queries)) == answers(search.semantic_search(units, queries))
    none = clusters.cluster_units(units.limit(0))
    assert clusters.clustered_search(none, queries).isEmpty()
