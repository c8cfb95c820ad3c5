import subprocess
import sys
import zlib
from itertools import product
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from unitquarry.llm import ppm, quality, queries

ROOT = Path(__file__).parents[2]
GOOD = ["the boats came in with the tide and the wall held", "a chest of coins was found under the stones.", "it was kept by the council"]
BAD = ["BUY!! NOW!! CHEAP!! BOATS!! HERE!!", "one | two | three | four | five |", "boat boat boat boat boat boat", "b### o*** a%%% t$$$ s&&&"]


def test_marginals_against_all_labellings():
    draw = np.random.default_rng(3)
    count = np.array([1, 4, 2, 5, 1])
    scores, moves = draw.normal(size=(count.sum(), 2)), draw.normal(size=(2, 2))
    lines, pair, total = quality.marginals(scores, moves, count)
    want, want_pair, want_total, at = np.zeros_like(scores), np.zeros((2, 2)), 0.0, 0
    for n in count:
        own = scores[at : at + n]
        paths = list(product((0, 1), repeat=int(n)))
        value = np.array([sum(own[i, y] for i, y in enumerate(p)) + sum(moves[a, b] for a, b in zip(p, p[1:])) for p in paths])
        z = np.logaddexp.reduce(value)
        want_total += z
        for p, v in zip(paths, np.exp(value - z)):
            for i, y in enumerate(p):
                want[at + i, y] += v
            for a, b in zip(p, p[1:]):
                want_pair[a, b] += v
        at += n
    assert np.allclose(lines, want) and np.allclose(pair, want_pair) and np.isclose(total, want_total)


def test_features_do_not_depend_on_other_texts():
    texts = [b"", b"one\n\none", "é ü\nÄ".encode(), b"a" * 5000, b"\n\n", b" x "]
    together, size, count = quality.line_features(texts)
    assert together.shape == (count.sum(), quality.FEATURES) and np.isfinite(together).all()
    at = 0
    for text, n in zip(texts, count):
        alone, own, _ = quality.line_features([text])
        assert np.allclose(alone, together[at : at + n]) and (own == size[at : at + n]).all()
        at += n


@pytest.mark.parametrize("n", [1, 7, 8, 9, 16, 33, 64, 65])
def test_long_chains_in_pieces(monkeypatch, n):
    monkeypatch.setattr(quality, "PIECE_LINES", 8)
    monkeypatch.setattr(quality, "WALK_LINES", 16)
    draw = np.random.default_rng(n)
    scores, moves = 3 * draw.normal(size=(n, 2)), draw.normal(size=(2, 2))
    want = quality.marginals(scores, moves, np.array([n]))[0]
    got = list(quality.long_marginals(scores, moves))
    assert [at for at, _ in got] == list(np.cumsum([0, *[len(x) for _, x in got]])[:-1])
    assert np.allclose(np.concatenate([x for _, x in got]), want)


def test_texts_of_many_lines_are_scored_as_others(monkeypatch):
    draw = np.random.default_rng(5)
    model = {"weights": draw.normal(size=(quality.FEATURES + 1, 2)), "moves": draw.normal(size=(2, 2)), "curve": np.array([1.0, 0.2])}
    texts = ["\n".join(draw.choice([*GOOD, *BAD, "", "a", "  "], size=k)).encode() for k in (40, 41, 100, 333)] + [b"\n" * 90, b"x" * 3000 + b"\n" * 40]
    want = quality.scores(texts, model)
    for name, value in [("PIECE_LINES", 8), ("WALK_LINES", 32), ("CHUNK_BYTES", 500)]:
        monkeypatch.setattr(quality, name, value)
    assert np.allclose(quality.scores(texts, model), want)


def test_memory_of_a_long_text_of_short_lines():
    code = (
        "import resource, numpy as np\n"
        "from unitquarry.llm import quality\n"
        "model = {'weights': np.zeros((quality.FEATURES + 1, 2)), 'moves': np.zeros((2, 2)), 'curve': np.array([1.0, 0.0])}\n"
        "print(quality.scores([b'a\\n' * 3_000_000], model)[0], resource.getrusage(resource.RUSAGE_SELF).ru_maxrss)\n")
    score, peak = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=ROOT).stdout.split()
    assert float(score) == pytest.approx(0.5) and int(peak) < 1_000_000


@pytest.fixture
def docs(spark):
    rows = []
    for i in range(400):
        bank = BAD if i % 4 == 0 else GOOD
        rows.append((i, "\n".join(bank[(i + j * 3) % len(bank)] + f" {i % 7}" for j in range(1 + i % 6))))
    rows += [(1000, None), (1001, ""), (1002, "\n" * 50), (None, GOOD[0]), (1003, GOOD[0]), (1003, GOOD[0]), (1004, "\n".join(GOOD * 20_000)), (1005, "x" * 200_000)]
    return spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"quality": F.lit(1), "label": F.lit("x"), "n": F.lit(0)})


def test_held_out_accuracy_and_corner_cases(spark, docs):
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(400)] + [(None, 1, 0), (1003, 0, 0), (77, None, 0)], "doc_id bigint, quality int, toxic int")
    learns = F.coalesce(ppm.bucket_of(F.col("doc_id"), 5) != 0, F.lit(False))
    model = quality.train(docs, labels, learns)
    got = quality.with_score(docs, model, "found").select("doc_id", "text", "found", ppm.bucket_of(F.col("doc_id"), 5).alias("b")).collect()
    assert len(got) == docs.count()
    held = [r for r in got if r.b == 0 and r.doc_id is not None and r.doc_id < 400]
    assert sum((r.found >= 0.3) == (r.doc_id % 4 != 0) for r in held) / len(held) > 0.95
    assert all(0 <= r.found <= 1 for r in got)
    assert len({r.found for r in got if r.doc_id in (1000, 1001)}) == 1
    assert len({r.found for r in got if r.doc_id == 1003}) == 1


def test_registered_query(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = queries.QUERIES["op7_crf_quality"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in table.select("doc_id").collect())
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3)


def test_training_is_bounded_in_lines(spark, docs, monkeypatch):
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(400)] + [(1002, 0)], "doc_id bigint, quality int")
    monkeypatch.setattr(quality, "SAMPLE_LINES", 30)
    held = []
    monkeypatch.setattr(quality, "fit", lambda features, size, count, label: held.append(count.sum()) or {})
    quality.train(docs, labels, F.lit(True))
    assert 0 < held[0] <= 30


def test_training_is_bounded_and_needs_both_kinds(spark, docs):
    one = spark.createDataFrame([(1, 1), (2, 1)], "doc_id bigint, quality int")
    model = quality.train(docs, one, F.lit(True))
    assert all(r[0] > 0.8 for r in quality.with_score(docs, model).select("score").collect())
    none = quality.train(docs, one.limit(0), F.lit(True))
    assert [r[0] for r in quality.with_score(docs, none).select("score").collect()] == pytest.approx([0.5] * docs.count())
    assert quality.with_score(docs.limit(0), model).count() == 0
