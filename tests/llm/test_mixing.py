import pytest
from pyspark.sql import functions as F

from unitquarry.llm import mixing


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: float(weights[i % 3]) for i, s in enumerate(names)}
    target, left, free = {}, share * sum(sizes.values()), set(names)
    while free:
        every = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / every > cap * sizes[s]]
        if not over:
            target |= {s: left * weight[s] / every for s in free}
            break
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
            free.remove(s)
    return target


@pytest.fixture
def docs(spark):
    rows = []
    for i in range(3000):
        source = "hot" if i % 3 == 0 else f"s{i % 7}"
        rows.append((i, source, " ".join(["w"] * (1 + i * 7 % 50))))
    rows += [(9000, None, "no source here"), (9001, None, None), (None, "s1", "no id"), (9002, "", " \t"), (9003, "tiny", "one"),
             (9004, "Ünder", "one two"), (9005, "hot", "v " * 40_000), (9006, "s2", "same row"), (9006, "s2", "same row")]
    frame = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    return frame.withColumns({"size": F.lit(-1), "copies": F.lit("x"), "h": F.lit(0), "source_no": F.lit(3), "target": F.lit(0)})


def test_targets_and_words_taken(spark, docs):
    got = mixing.mixed_words(docs).toPandas()
    assert len(got) == docs.count()
    source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    plain = {}
    for r in docs.select("source", "text").collect():
        plain[r.source] = plain.get(r.source, 0) + len((r.text or "").split())
    targets = plain_targets(plain)
    largest, taken = {}, {}
    for r in got.itertuples():
        s = source[None if r.doc_id != r.doc_id else int(r.doc_id)]
        assert r.source_size == plain[s] and r.target == pytest.approx(targets[s])
        assert 0 <= r.taken <= 2 * r.size and (r.taken == 0 or r.taken % r.size == 0)
        taken[s] = taken.get(s, 0) + r.taken
        largest[s] = max(largest.get(s, 0), r.size)
    for s, words in taken.items():
        assert abs(words - targets[s]) <= largest[s] + 1e-6
    assert sum(targets.values()) == pytest.approx(1.5 * sum(plain.values()))


def test_reruns_and_partitionings_agree(spark, docs):
    one = sorted(map(tuple, mixing.mixed_words(docs).collect()), key=str)
    two = sorted(map(tuple, mixing.mixed_words(docs.repartition(7, "text")).collect()), key=str)
    assert one == two


def test_expected_copies_hold_on_average(spark):
    docs = spark.createDataFrame([(i, f"s{i % 3}", "w " * (1 + i % 4)) for i in range(12)], "doc_id bigint, source string, text string")
    total = {}
    for seed in range(25):
        for r in mixing.mixed_words(docs, seed=seed).collect():
            total.setdefault(r.doc_id, [0, r.target / r.source_size])[0] += r.taken / r.size
    mean_error = sum(n / 25 - want for n, want in total.values()) / len(total)
    assert abs(mean_error) < 0.1
    assert all(abs(n / 25 - want) < 0.5 for n, want in total.values())


def test_mix_repeats_rows_and_keeps_columns(spark, docs):
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    words = sum(len((r.text or "").split()) for r in mixed.select("text").collect())
    assert words == mixing.mixed_words(docs).agg(F.sum("taken")).first()[0]


def test_empty_table(spark, docs):
    assert mixing.mixed_words(docs.limit(0)).count() == 0
    assert mixing.mix(docs.limit(0)).count() == 0
    blank = docs.filter("doc_id = 9002")
    assert [(r.size, r.target, r.taken) for r in mixing.mixed_words(blank).collect()] == [(0, 0.0, 0)]


def test_plan_holds_no_python(spark, docs):
    plan = mixing.mixed_words(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_repeated_rows_are_settled_one_by_one(spark):
    """However many rows repeat, a source ends within one document of its target."""
    rows = [(None, "a", "x " * 10)] * 1000 + [(5, "b", "y " * 7)] * 3000 + [(i, "c", "z " * (1 + i % 5)) for i in range(200)] + [(7, "c", "k " * 3), (7, "c", "l " * 3)]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id bigint, source string, text string, no int").repartition(8)
    found = mixing.mixed_words(docs.drop("no"))
    assert found.count() == len(rows)
    sums = found.groupBy("target").agg(F.sum("taken").alias("taken"), F.max("size").alias("size")).collect()
    assert len(sums) == 3 and all(abs(r.taken - r.target) <= r.size for r in sums)
    assert found.filter("taken > 2 * size").count() == 0
    mixed = mixing.mix(docs)
    per = mixed.groupBy("no").count().collect()
    assert max(r["count"] for r in per) <= 2
    words = mixed.groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " "))).alias("n"))
    want = sorted(r.taken for r in sums)
    assert sorted(r.n for r in words.collect()) == want
