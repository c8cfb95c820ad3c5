import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from unitquarry.llm import lexical, queries

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_terms(text):
    return Counter(TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")))


def plain_search(docs, items, k=20):
    counts = [(d, plain_terms(t)) for d, t in docs]
    n_docs, n_terms = sum(1 for _, c in counts if c), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in set(items):
        scored = []
        for d, c in counts:
            if not c:
                continue
            m = 100 - 25 + 25 * sum(c.values()) * n_docs // n_terms
            s = sum(
                reps * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m))
                for t, reps in plain_terms(text).items() if c[t])
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(item, i + 1, None if null else d, -s) for i, (s, null, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def corpus(n, words, seed=1):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)]
    # A few words are in most texts, and copies lie close together.
    return [" ".join(rnd.choices(vocabulary, weights=[words / (i + 1) for i in range(words)], k=rnd.randint(0, 40))) for _ in range(n)]


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_terms_of_any_text():
    texts = [None, "", "Ab-cd AB ÉÀ é٣x_y 12\t3", "\x00\x7f", "x" * 50, "\U0001F600z ab" * 9]
    for text in texts:
        want = {t.encode(): n for t, n in plain_terms(text).items()}
        assert lexical.term_counts(text) == want


def test_long_texts_are_split_between_terms(monkeypatch):
    text = " ".join(corpus(30, 50)) + " " + "y" * 300 + " é end"
    whole = lexical.term_counts(text)
    for piece in (1, 7, 64):
        monkeypatch.setattr(lexical, "PIECE", piece)
        assert lexical.term_counts(text) == whole


@pytest.mark.parametrize("k,block,cells", [(1, 1, 1), (3, 4, 2000), (20, 32, 12_000_000)])
def test_search_equals_a_plain_version(spark, monkeypatch, k, block, cells):
    monkeypatch.setattr(lexical, "BLOCK_DOCS", block)
    monkeypatch.setattr(lexical, "CELLS", cells)
    texts = corpus(400, 60) + ["w1 w2 rare"] * 60
    docs = list(enumerate(texts)) + [(None, "w1 rare"), (None, None), (5, "w5 rare"), (7, ""), (9, None)]
    items = [(i, t) for i, t in enumerate(corpus(25, 60, 2))] + [(0, "rare W1"), (None, "w3"), (3, None), (4, "unknown"), (None, "w3")]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({c: F.lit("x") for c in ("n", "terms", "score", "rank")})
    asked = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(1))
    want = plain_search(docs, items, k)
    assert rows(lexical.search(frame, asked, k)) == want
    if k == 3:
        assert rows(lexical.search(frame, asked, k, pass_entries=40)) == want


def test_blocks_are_skipped():
    rnd = np.random.default_rng(0)
    n, terms = 4000, 40
    matrix = np.zeros((n, terms))
    for r in range(n):
        group = r % 8
        matrix[r, group * 5 + rnd.choice(5, 3, replace=False)] = rnd.integers(1, 1000, 3)
    entries = [(i, t, 10 + t) for i in range(8) for t in (i * 5, i * 5 + 1, (i * 5 + 7) % terms)]
    block = lexical._Items([(i, i) for i in range(8)], entries, 5)
    matrix = matrix[:, block.terms]
    for at in range(0, n, 1000):
        block.add(matrix[at : at + 1000], np.arange(at, min(at + 1000, n)), np.zeros(min(1000, n - at), bool))
    got = {(r["item_id"], r["doc_id"], r["score"]) for r in block.rows().to_pylist()}
    scores = matrix @ block.weights
    want = {(i, int(d), int(scores[d, i])) for i in range(8) for d in np.lexsort((np.arange(n), -scores[:, i]))[:5]}
    assert got == want
    assert block.skipped > 0 and block.scored < 0.25 * n * 8


def test_large_weights_stay_exact():
    block = lexical._Items([(1, 1)], [(0, 0, 2**40), (0, 1, 1)], 2)
    assert block.kind == np.int64
    block.add(np.array([[3, 1], [3, 2], [0, 5]]), np.arange(3), np.zeros(3, bool))
    assert [r["score"] for r in block.rows().to_pylist()] == [3 * 2**40 + 2, 3 * 2**40 + 1]


def test_registered_query_over_corner_cases(spark, tmp_path):
    docs = [(1, "alpha beta"), (2, "alpha " * 30_000), (None, None), (3, ""), (3, "beta"), (4, "gamma delta")]
    items = [(1, "Alpha, alpha!"), (2, None), (3, "gamma"), (None, "beta")]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert rows(queries.op12_geometric_search(spark, str(tmp_path))) == plain_search(docs, items)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    assert lexical.search(docs.limit(0), items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0
    with pytest.raises(ValueError):
        lexical.search(docs, items, 0)
