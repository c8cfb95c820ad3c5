import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from unitquarry.llm import queries, winnow


def plain_marks(text, k, w):
    """Every window looked at on its own."""
    k = min(k, len(text))
    if not text:
        return []
    base, hashes = winnow._BASE, []
    for i in range(len(text) - k + 1):
        h = 0
        for c in text[i : i + k]:
            h = (h * base + ord(c) + 1) % 2**64
        h = (h ^ (h >> 32)) * int(winnow._MIX) % 2**64
        hashes.append(h ^ (h >> 32))
    w = min(w, len(hashes))
    kept = set()
    for i in range(len(hashes) - w + 1):
        window = hashes[i : i + w]
        kept.add(i + max(j for j, h in enumerate(window) if h == min(window)))
    return [(hashes[i], i) for i in sorted(kept)]


def listed(found):
    return list(zip(found[0].tolist(), found[1].tolist()))


@pytest.mark.parametrize("k,w", [(1, 1), (3, 4), (5, 7), (16, 16), (7, 2), (30, 1)])
def test_marks_equal_a_plain_version(k, w):
    rnd = random.Random(k * 100 + w)
    for n in (0, 1, 2, k - 1, k, k + w - 1, 60, 200):
        text = "".join(rnd.choice("ab é\U0001F600") for _ in range(n))
        assert listed(winnow.marks(text, k, w)) == plain_marks(text, k, w)
    assert listed(winnow.marks("a" * 50, k, w)) == plain_marks("a" * 50, k, w)


def test_long_texts_are_hashed_in_blocks(monkeypatch):
    rnd = random.Random(3)
    text = "".join(rnd.choice("abc") for _ in range(700)) + "z" * 300
    whole = listed(winnow.marks(text, 6, 9))
    for block in (1, 2, 10, 64):
        monkeypatch.setattr(winnow, "BLOCK", block)
        assert listed(winnow.marks(text, 6, 9)) == whole == plain_marks(text, 6, 9)


def test_shared_runs_are_found(spark):
    rnd = random.Random(5)
    word = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    run = word(winnow.GRAM + winnow.WINDOW - 1)
    rows = [(1, word(100) + run + word(40)), (2, word(7) + run), (3, word(300))]
    found = winnow.fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("marks", F.lit(0)))
    a, b = found.filter("doc_id = 1"), found.filter("doc_id > 1")
    got = winnow.shared_runs(a, b).collect()
    assert got and {(r.a_id, r.b_id) for r in got} == {(1, 2)}
    assert all(100 <= r.at_a < 100 + len(run) and r.at_a - r.at_b == 93 for r in got)


def plain_edits(rows, k=winnow.GRAM, w=winnow.WINDOW):
    """Over rows with different ids, in one list."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0]), reverse=True)
    out = []
    for i, (doc_id, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        m = len(text) // 3
        edited = text[: len(text) - m] + after[:m]
        own, other, then = (plain_marks(t, k, w) for t in (text, edited, after))
        near = lambda a, b: len({h for h, _ in a} & {h for h, _ in b}) / len({h for h, _ in a} | {h for h, _ in b}) if a or b else 1.0
        sign = lambda found: hashlib.sha256(
            np.array([h for h, _ in found], "<u8").tobytes() + np.array([p for _, p in found], "<i8").tobytes()).hexdigest()
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), sign(own), sign(other), near(own, other), near(own, then)))
    return sorted(out, key=repr)


def texts(n):
    rnd = random.Random(n)
    return ["".join(rnd.choice("étude of words ") for _ in range(rnd.choice([0, 1, 5, 40, 300]))) for _ in range(n)]


@pytest.mark.parametrize("n", [1, 2, 3, 120])
def test_registered_query_equals_a_plain_version(spark, tmp_path, n):
    rows = [(i * 3 - 50, t) for i, t in enumerate(texts(n))]
    if n > 3:
        rows += [(None, "no id"), (10**12, None), (10**12 + 1, ""), (10**12 + 2, "word " * 60_000)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    frame = frame.withColumns({c: F.lit(1) for c in ("n_chars", "_part", "_edge", "fingerprint")})
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_winnowing(spark, str(tmp_path))
    if n > 3:
        short = [tuple(r) for r in got.filter("n_chars < 1000").collect()]
        want = plain_edits([r for r in rows if r[0] != 10**12 + 2])
        # The long text is the first in order: only the last row's partner differs without it.
        differs = [r for r in sorted(short, key=repr) if r not in want]
        assert len(short) == len(want) and [r[0] for r in differs] in ([], [None])
        long = got.filter(f"doc_id = {10**12 + 2}").first()
        assert long.n_chars == 300_000 and long.near_next == 0
    else:
        assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_edits(rows)


def test_repeated_rows_and_an_empty_table(spark):
    frame = spark.createDataFrame([(1, "same text of some length here")] * 5 + [(None, None)] * 3, "doc_id bigint, text string")
    got = winnow.compare_edited(frame).toPandas()
    assert len(got) == 8 and got[got.doc_id == 1].fingerprint.nunique() == 1
    assert winnow.compare_edited(frame.limit(0)).count() == 0


def test_edited_texts_stay_nearer_than_others(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = winnow.compare_edited(docs).filter("n_chars >= 200").toPandas()
    assert (got.near_edited > 0.25).mean() > 0.98
    assert got.near_next.median() < 0.05
