import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from unitquarry.llm import graph, simhash


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [words] if len(words) < 4 else [words[i : i + 4] for i in range(len(words) - 3)]
    hashes = [xxhash.xxh64_intdigest(b" ".join(s), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, ids):
    root = list(range(len(prints)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 4:
                root[find(i)] = find(j)
    least = {}
    for i in range(len(prints)):
        if ids[i] is not None:
            r = find(i)
            least[r] = min(least.get(r, ids[i]), ids[i])
    return [least.get(find(i)) for i in range(len(prints))]


def test_every_word_decodes_within_three_bits():
    words = np.arange(1 << 23, dtype=np.int64)[::97]
    code = words ^ simhash.LEADERS[simhash._remainders(words)]
    assert (simhash._remainders(code) == 0).all()
    assert (np.bitwise_count(words ^ code) <= 3).all()


def test_words_within_two_bits_share_a_near_codeword():
    # The code is linear: one word for each syndrome stands for all.
    words = np.array([int(p) for p in simhash.LEADERS])
    flips = [1 << a for a in range(23)] + [1 << a | 1 << b for a in range(23) for b in range(a)]
    mine, _ = simhash.near_indices(words)
    for flip in flips:
        theirs, _ = simhash.near_indices(words ^ flip)
        assert (mine[:, :, None] == theirs[:, None, :]).any(axis=(1, 2)).all()


def test_words_within_one_bit_reach_each_other():
    words = np.array([int(p) for p in simhash.LEADERS])
    near, _ = simhash.near_indices(words)
    for flip in [0] + [1 << a for a in range(23)]:
        assert (near == simhash.decode(words ^ flip)[:, None]).any(axis=1).all()


def test_links_are_those_of_all_pairs(spark):
    draw = np.random.default_rng(5)
    prints = [int(x) for x in draw.integers(0, 1 << 63, 60, dtype=np.uint64)]
    for base in prints[:60]:
        for bits in (1, 2, 3, 4, 4, 4, 5, 6):
            flip = 0
            for b in draw.choice(64, bits, replace=False):
                flip |= 1 << int(b)
            prints.append(base ^ flip)
    prints = sorted({p - (1 << 64) if p >> 63 else p for p in prints})
    df = spark.createDataFrame([(p,) for p in prints], "fp bigint")
    got = {tuple(r) for r in simhash.linked_fingerprints(df).collect()}
    bits = [p % (1 << 64) for p in prints]
    want = {(prints[i], prints[j]) for j in range(len(prints)) for i in range(j) if (bits[i] ^ bits[j]).bit_count() <= 4}
    assert got == want and len(want) > 300


def test_components_of_chains_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(100, 180)] + [(500, i) for i in range(300, 340)] + [(1, 2), (2, 3), (3, 1), (7, 7)]
    got = dict(graph.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect())
    want = {i: 100 for i in range(100, 181)} | {i: 300 for i in range(300, 340)} | {500: 300, 1: 1, 2: 1, 3: 1}
    assert got == want
    assert graph.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


LONG = " ".join(f"token{i}" for i in range(30_000))


@pytest.fixture
def docs(spark):
    base = " ".join(f"word{i}" for i in range(200))
    rows = [(5, base), (3, base.upper()), (9, base + " more"), (9, base + " more"), (1, "a different text altogether"),
            (2, None), (4, ""), (None, " \t\n"), (None, "nobody owns this text"), (6, "x"), (7, "  X "), (8, LONG), (10, LONG + " end")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    return frame.withColumns({"fp": F.lit("clash"), "key": F.lit(1), "digest": F.lit(0), "component_id": F.lit("x")})


def test_near_duplicates_against_brute_force(spark, docs):
    rows = docs.select("doc_id", "text").collect()
    prints = [plain_fingerprint(r.text) for r in rows]
    want = sorted(zip([r.doc_id for r in rows], prints, plain_components(prints, [r.doc_id for r in rows]), strict=True), key=str)
    got = simhash.near_duplicates(docs).select("doc_id", simhash.hexadecimal(F.col("fp")).alias("f"), "component_id").collect()
    assert sorted(((r.doc_id, int(r.f, 16), r.component_id) for r in got), key=str) == want


def test_keep_one_leaves_one_row_of_each_group(spark, docs):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    rows = docs.select("doc_id", "text").collect()
    prints = [plain_fingerprint(r.text) for r in rows]
    groups = plain_components(prints, [r.doc_id for r in rows])
    assert ids == sorted(set(groups), key=str)


def test_empty_table(spark, docs):
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_one_row_of_linked_texts_without_ids_stays(spark):
    """Texts a few bits apart, all without an id, are one component."""
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(None, base), (None, base + " tail"), (None, base + " end"), (None, "other words in a short text of its own")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = simhash.near_duplicates(frame).toPandas()
    assert simhash.keep_one(frame).count() == found.root.nunique() == 2
