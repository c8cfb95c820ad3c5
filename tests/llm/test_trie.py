import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from unitquarry.llm import queries, trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def plain_trie(rows):
    """Every prefix of every conversation, and all pairs of nodes."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        whole[c] = own.get(base, [])[:h] + turns[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    out = []
    for node, convs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        childless = [n for n in below if not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in members)]
        out.append((
            min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs),
            sum(1 for n in below if len(n) == len(node) + 1), len(childless),
            sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n),
            hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def conversations(n, seed):
    """Few different texts, so that many conversations share turns."""
    rnd, rows = random.Random(seed), []
    for c in rnd.sample(range(-20, 3 * n), n):
        for t in range(rnd.choice([1, 2, 3, 5, 9, 12])):
            rows.append((c, t, rnd.choice(["user", "assistant"]), rnd.choice(["", "a", "é", "long text"])))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("siblings,most", [(10_000, 20_000), (2, 3)])
def test_trie_equals_a_plain_version(spark, siblings, most):
    rows = conversations(60, 4)
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("c", "d", "at", "depth", "_part")})
    assert rows_of(trie.prefix_trie(frame, siblings, most)) == plain_trie(rows)


def test_registered_query_over_corner_cases(spark, tmp_path):
    rows = [
        (0, None, None, None), (0, 0, "user", "x"), (0, 1, "user", ""), (5, 0, None, "x" * 300_000), (6, 0, "a", "b"), (6, 0, "a", "b"), (7, 3, "a", "b"),
        (None, 1, "user", "nobody's"), (-3, 0, "user", "x"), (-3, 0, "user", "y"), (11, 0, "u", "v"), (12, 0, "u", "v"), (13, 0, "u", "v")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert rows_of(queries.op13_euler_trie(spark, str(tmp_path))) == plain_trie(rows)


def test_copies_and_a_long_conversation(spark):
    rows = [(5 * c, t, "user", f"turn {t}") for c in range(40) for t in range(3)] + [(1000, t, "user", str(t % 7)) for t in range(400)]
    assert rows_of(trie.prefix_trie(spark.createDataFrame(rows, SCHEMA), 4, 10)) == plain_trie(rows)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert trie.prefix_trie(empty).count() == 0
    assert trie.prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).count() == 0


def test_running_sums_over_parts(spark):
    rows = [(i % 3, i, 1) for i in range(3000)]
    made = trie.running(spark.createDataFrame(rows, "g bigint, i bigint, one bigint"), ["g"], ["i"], {"n": (F.sum, "one", trie._add)})
    got = made.toPandas().sort_values(["g", "i"])
    assert (got.n == got.groupby("g").cumcount() + 1).all() and len(got) == 3000


def test_ranking_a_list_by_contraction(spark):
    order = list(range(500))
    random.Random(1).shuffle(order)
    rows = [(c, 0, n, 0 if n is not None else None, c % 3, c) for c, n in zip(order, [*order[1:], None])]
    arcs = spark.createDataFrame(rows, "c bigint, at bigint, to_c bigint, to_at bigint, leaves bigint, saved bigint")
    got = {r.c: (r.leaves, r.saved) for r in trie.ranked(arcs, most=20).collect()}
    leaves = saved = 0
    for c in order:
        assert got[c] == (leaves, saved)
        leaves, saved = leaves + c % 3, saved + c


def test_digests_of_long_lists_of_ids(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 50)
    ends = spark.range(2000).select(F.col("id").alias("c"), F.floor(F.col("id") % 3 / 2).cast("bigint").alias("d"), F.lit(7).cast("bigint").alias("x"), F.lit(8).cast("bigint").alias("y"))
    got = {r.d: r.ends for r in trie.end_digests(ends).collect()}
    for d in (0, 1):
        assert got[d] == hashlib.sha256(",".join(str(i) for i in range(2000) if i % 3 // 2 == d).encode()).hexdigest()
