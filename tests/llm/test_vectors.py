import numpy as np
import pytest
from pyspark.sql import functions as F

from unitquarry.llm import ann, capfilter
from unitquarry.llm.vectors import usable

NAN, INF = float("nan"), float("inf")
ODD = [(900, None, 1), (901, [], 1), (902, [0.0] * 8, 1), (903, [1.0, None] + [0.0] * 6, 1), (904, [NAN] * 8, 1), (905, [INF] + [1.0] * 7, 1), (906, [1.0, 2.0], 1),
       (907, [1.0, 2.0], 1), (908, [1.0, 2.0], None), (None, [1.0, 2.0], 1), (909, [5.0] * 8, 3), (909, [5.0] * 8, 3), (910, [-0.0] * 7 + [1.0], 4), (911, [0.0] * 7 + [1.0], 4)]
KIND = "vec_id bigint, embedding array<float>, label int"


def clash(df):
    return df.withColumns({"score": F.lit("x"), "rank": F.lit(0), "cls": F.lit(0), "cap": F.lit(0), "n": F.lit("x")})


def test_usable(spark):
    got = spark.createDataFrame(ODD, KIND).select(usable(F.col("embedding")).alias("u")).collect()
    assert [r.u for r in got] == [False] * 6 + [True] * 8


def brute_nearest(rows, queries, k):
    out = {}
    for q, vector in queries:
        far = sorted((float(np.sqrt(((np.float64(v) - np.float64(vector)) ** 2).sum())), i) for i, v in rows if i != q and len(v) == len(vector))
        out[q] = far[:k]
    return out


def test_nearest_recall_copies_and_ties(spark):
    draw = np.random.default_rng(11)
    rows = [(i, draw.normal(size=32).astype(np.float32).tolist(), 0) for i in range(3000)]
    rows[100:140] = [(i, rows[100][1], 0) for i in range(100, 140)]
    df = clash(spark.createDataFrame(rows, KIND)).repartition(3)
    got = {}
    for r in ann.nearest(df, df.filter("vec_id % 100 = 0")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = brute_nearest([r[:2] for r in rows], [r[:2] for r in rows if r[0] % 100 == 0], 10)
    hits = 0
    for q, near in want.items():
        found = sorted(got[q])
        assert [f[0] for f in found] == list(range(1, 11))
        assert [(s, i) for _, i, s in found] == sorted((s, i) for _, i, s in found)
        hits += len({i for _, i in near} & {i for _, i, _ in found})
        vectors = {r[0]: r[1] for r in rows}
        for _, i, s in found:
            assert s == pytest.approx(float(np.linalg.norm(np.float64(vectors[i]) - np.float64(vectors[q]))), rel=1e-12)
    assert hits / (10 * len(want)) > 0.97
    assert [i for _, i, _ in sorted(got[100])] == list(range(101, 111))


def test_nearest_corner_cases(spark):
    df = clash(spark.createDataFrame(ODD, KIND))
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in ann.nearest(df, df.filter("vec_id in (900, 902, 906, 909, 910)")).collect())
    assert got == [(906, 1, 907), (906, 2, 908), (909, 1, 910), (909, 2, 911), (910, 1, 911), (910, 2, 909), (910, 3, 909)]
    assert ann.nearest(df.limit(0), df).count() == 0 and ann.nearest(df, df.limit(0)).count() == 0


def test_query_blocks(spark, monkeypatch):
    draw = np.random.default_rng(2)
    df = spark.createDataFrame([(i, draw.normal(size=8).tolist(), 0) for i in range(300)], KIND)
    one = sorted(map(tuple, ann.nearest(df, df.filter("vec_id % 10 = 0"), 3).collect()))
    monkeypatch.setattr(ann, "QUERY_BYTES", 500)
    monkeypatch.setattr(ann, "BLOCK_ROWS", 40)
    two = sorted(map(tuple, ann.nearest(df, df.filter("vec_id % 10 = 0"), 3).collect()))
    assert len(one) == len(two) == 90 and len(set(one) & set(two)) > 85


def near(draw, vector, cosine):
    other = draw.normal(size=len(vector))
    other -= other @ vector * vector
    other /= np.linalg.norm(other)
    return cosine * vector + np.sqrt(1 - cosine**2) * other


@pytest.mark.parametrize("d", [16, 64, 200])
def test_links_just_above_the_bound_are_found(spark, d):
    draw = np.random.default_rng(d)
    base = draw.normal(size=(1500, d))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    pairs = np.vstack([base, [near(draw, v, 0.9805) for v in base]])
    rows = [(i, [float(x) for x in v], int(i % 1500 % 2)) for i, v in enumerate(np.float32(pairs))]
    got = {r.vec_id: r for r in capfilter.near_duplicates(spark.createDataFrame(rows, KIND)).collect()}
    linked = sum(got[i].n_links >= 1 and got[i + 1500].component_id == i for i in range(1500))
    assert linked >= 1499


def brute_links(rows, least=0.98):
    fit = [(i, np.float64(v), label) for i, v, label in rows
           if v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    return [[j for j, (_, w, m) in enumerate(fit) if j != i and m == label and len(w) == len(v) and v @ w / (np.linalg.norm(v) * np.linalg.norm(w)) >= least]
            for i, (_, v, label) in enumerate(fit)], fit


def test_components_against_brute_force(spark):
    draw = np.random.default_rng(9)
    rows, i = [], 0
    for _ in range(60):
        v = draw.normal(size=24)
        v /= np.linalg.norm(v)
        for _ in range(draw.integers(1, 6)):
            rows.append((10_000 - i, [float(x) for x in np.float32(v)], int(i % 3 > 0)))
            i += 1
            v = near(draw, v, 0.985)
            v /= np.linalg.norm(v)
    rows += [(2000 + n, rows[5][1], rows[5][2]) for n in range(30)] + [(3000, [2 * x for x in rows[7][1]], rows[7][2])]
    rows += [r for r in ODD]
    links, fit = brute_links(rows)
    group = list(range(len(fit)))
    for _ in fit:
        for a, near_a in enumerate(links):
            for b in near_a:
                group[a] = group[b] = min(group[a], group[b])
    least = {}
    for g, (vec_id, *_ ) in zip(group, fit):
        if vec_id is not None:
            least[g] = min(least.get(g, vec_id), vec_id)
    want = sorted(((v, len(n), least.get(g)) for (v, *_), n, g in zip(fit, links, group)), key=str)
    got = capfilter.near_duplicates(clash(spark.createDataFrame(rows, KIND))).collect()
    assert len(got) == len(rows)
    outside = {900, 901, 902, 903, 904, 905, 908}
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got if r.vec_id not in outside), key=str) == want
    assert all((r.n_links, r.component_id, r.kept) == (0, r.vec_id, True) for r in got if r.vec_id in outside)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)
    assert capfilter.near_duplicates(spark.createDataFrame([], KIND)).count() == 0
