import random

import pytest
from pyspark.sql import functions as F

import brute
from unitquarry import runtime
from unitquarry.operators import callgraph, expand

UNITS = "id bigint, name string, class_name string, file_path string"


def graph(spark, units, calls):
    u = spark.createDataFrame(units, UNITS)
    c = spark.createDataFrame(calls, "caller_id bigint, name string, receiver string")
    return {(r.caller_id, r.callee_id) for r in callgraph.build_call_graph(u, c).collect()}


BASE = [
    (1, "weigh", None, "shop/scale.ts"), (2, "fire", "Kiln", "clay/kiln.ts"), (3, "cool", "Kiln", "clay/kiln.ts"),
    (4, "stack", "Shelf", "clay/kiln.ts")]


def test_receivers_and_unique_names(spark):
    calls = [(2, "cool", "this"), (3, "fire", "Kiln"), (4, "weigh", None), (1, "stack", "Shelf"), (1, "cool", "this")]
    assert graph(spark, BASE, calls) == {(2, 3), (3, 2), (4, 1), (1, 4), (1, 3)}


@pytest.fixture(params=[False, True], ids=["plain", "hot"])
def hot(request, monkeypatch):
    """All keys hot, nothing broadcast: the spread joins must agree with the plain ones."""
    if request.param:
        monkeypatch.setattr(runtime, "HOT_ROWS", 1)
        monkeypatch.setattr(runtime, "HOT_SHARE", 0.0)
        monkeypatch.setattr(runtime, "BROADCAST_ROWS", 0)


def test_rules(spark, hot):
    units = BASE + [
        (5, "twin", "Pair", "a.ts"), (6, "twin", "Pair", "b.ts"),      # one class name, two files
        (7, "first", "X", "clay/kiln.ts"), (8, "first", "Y", "clay/kiln.ts"),    # two candidates in a file
        (9, "alone", None, "z.ts"),                                    # the only one of its name
        (14, "glaze", None, "clay/kiln.ts"),                           # the caller
        (10, "many", None, "y.ts"), (11, "many", None, "z.ts"),        # not unique elsewhere
        (12, "blank", "", "clay/kiln.ts"), (13, "blank", None, "clay/kiln.ts"),  # an empty class is not no class
    ]
    calls = [
        (14, "twin", "Pair"), (14, "first", None), (14, "alone", None), (14, "many", None), (14, "glaze", None),
        (14, "alone", "Nobody"), (14, "missing", "this"), (14, "blank", None), (14, "alone", None), (5, "twin", "Pair"), (2, "weigh", ""),
    ]
    assert graph(spark, units, calls) == {(14, 7), (14, 9), (14, 13), (2, 1)}


def test_edges_have_no_loops_and_stay_inside(spark, hot):
    rng = random.Random(3)
    units = [(i, f"n{rng.randint(0, 12)}", rng.choice([None, "A", "B"]), f"f{rng.randint(0, 4)}") for i in range(60)]
    calls = [(rng.randint(0, 59), f"n{rng.randint(0, 14)}", rng.choice([None, "this", "A", "B", "C"])) for _ in range(300)]

    def resolve(caller, name, receiver):
        _, _, owner, path = units[caller]
        options = [u for u in units if u[1] == name]
        if receiver not in (None, "", "this"):
            owned = [u for u in options if u[2] == receiver]
            if len(owned) == 1:
                return owned[0][0]
        near = [u for u in options if u[3] == path]
        kin = [u for u in near if u[2] == owner]
        pick = kin or near or (options if len(options) == 1 else [])
        return pick[0][0] if pick else None

    want = {(c, resolve(c, n, r)) for c, n, r in calls}
    assert graph(spark, units, calls) == {(a, b) for a, b in want if b is not None and a != b}


def expanded(spark, seeds, edges, ids, depth):
    results = spark.createDataFrame(
        [(q, p + 1, i, 0.5) for q, nodes in seeds.items() for p, i in enumerate(nodes)], "query_id bigint, pos int, id bigint, score double")
    e = spark.createDataFrame(edges, "caller_id bigint, callee_id bigint")
    u = spark.createDataFrame([(i,) for i in ids], "id bigint")
    out = {}
    for r in expand.expand(results, e, u, depth).orderBy("query_id", "pos").collect():
        out.setdefault(r.query_id, []).append((r.id, r.relationship, r.expansion_depth))
        assert r.pos == len(out[r.query_id])
        assert r.score == (0.5 if r.relationship is None else 0.0)
    return out


EDGES = [(1, 2), (2, 3), (3, 1), (4, 2), (5, 4), (6, 5), (1, 99), (7, 1), (8, 1), (9, 1), (2, 10), (10, 2), (11, 12)]
IDS = range(1, 13)  # 99 is not there


@pytest.mark.parametrize("depth", [0, 1, 2, 4])
def test_walk(spark, depth, hot, monkeypatch):
    seeds = {1: [1], 2: [4, 2], 3: [12], 4: [3, 9, 1], 5: [99]}
    want = {q: brute.walk(s, EDGES, set(IDS), max(1, depth)) for q, s in seeds.items()}
    assert expanded(spark, seeds, EDGES, IDS, depth) == want


def test_distributed_positions(spark, monkeypatch):
    """Ranges numbered piece by piece agree with one window."""
    monkeypatch.setattr(runtime, "WINDOW_ROWS", 3)
    rng = random.Random(5)
    edges = list({(rng.randint(0, 40), rng.randint(0, 40)) for _ in range(150)})
    edges = [(a, b) for a, b in edges if a != b]
    seeds = {1: [0, 5], 2: [7], 3: [40, 1, 2]}
    want = {q: brute.walk(s, edges, set(range(41)), 3) for q, s in seeds.items()}
    assert expanded(spark, seeds, edges, range(41), 3) == want


def test_stored_links_stay_where_they_are(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(2000)] + [(7, i) for i in range(200)]
    links = expand.adjacency(spark.createDataFrame(edges, "caller_id bigint, callee_id bigint"))
    frontier = spark.createDataFrame([(q, rng.choice([7, rng.randint(0, 320)]), q) for q in range(500)], "query_id bigint, src bigint, pos bigint")
    want = sorted(links.join(frontier, "src").select("query_id", "src", "dst", "direction").collect())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        with expand.stored_links(links) as stored:
            hot = [r[0] for r in spark.range(7, 8).select(F.xxhash64("id")).collect()]
            for some in ([], hot):
                met = expand.meet(stored, frontier, some)
                assert sorted(met.select("query_id", "src", "dst", "direction").collect()) == want
            plan = expand.meet(stored, frontier, [])._jdf.queryExecution().executedPlan().toString()
            moved = [line for line in plan.split("Initial Plan")[0].split("\n") if "Exchange" in line]
            assert "Bucketed: true" in plan and len(moved) == 1 and "REPARTITION_BY_NUM" in moved[0], plan
        assert not [t for t in spark.catalog.listTables() if t.name.startswith("unitquarry_links")]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_large_frontiers_store_the_links_once(spark, monkeypatch):
    monkeypatch.setattr(runtime, "BROADCAST_ROWS", 0)
    rng, made, plain = random.Random(8), [], expand.stored_links
    monkeypatch.setattr(expand, "stored_links", lambda links: made.append(1) or plain(links))
    edges = [(a, b) for a, b in {(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(120)} if a != b]
    seeds = {1: [0, 5], 2: [7]}
    for depth, times in ((1, 0), (3, 1)):
        made.clear()
        want = {q: brute.walk(s, edges, set(range(61)), depth) for q, s in seeds.items()}
        assert expanded(spark, seeds, edges, range(61), depth) == want and len(made) == times


def test_depth_must_be_a_number():
    assert expand.check_depth(2.9) == 2 and expand.check_depth(-3) == 1
    for bad in (float("nan"), "2", None, True):
        with pytest.raises(ValueError):
            expand.check_depth(bad)


def test_incremental_edges_equal_a_full_rebuild(spark, hot):
    """Random edits: files change, appear and disappear; edges to untouched names are never resolved again."""
    rng = random.Random(11)
    fresh_id, units, calls = 0, {}, {}

    def made(path):
        nonlocal fresh_id
        for _ in range(rng.randint(0, 5)):
            fresh_id += 1
            units[fresh_id] = (fresh_id, f"n{rng.randint(0, 9)}", rng.choice([None, "A", "B"]), path)
            calls[fresh_id] = [(fresh_id, f"n{rng.randint(0, 11)}", rng.choice([None, "this", "A", "B"])) for _ in range(rng.randint(0, 4))]

    def frame(of, ids):
        if of is units:
            return spark.createDataFrame([units[i] for i in ids], UNITS)
        return spark.createDataFrame([c for i in ids for c in calls[i]], "caller_id bigint, name string, receiver string")

    for f in range(8):
        made(f"f{f}")
    alive = list(units)
    edges = callgraph.named_edges(callgraph.resolve_calls(frame(units, alive), frame(calls, alive)))
    for edit in range(2 if runtime.BROADCAST_ROWS == 0 else 4):
        path = f"f{rng.randint(0, 9)}"
        gone = [i for i in alive if units[i][3] == path]
        before = fresh_id
        if edit != 2:
            made(path)
        stayed, added = [i for i in alive if i not in gone], [i for i in units if i > before]
        names = callgraph.changed_names(frame(units, gone), frame(units, added))
        again = runtime.cut(callgraph.edges_again(frame(units, stayed + added), frame(calls, stayed), frame(calls, added), names))
        touched = {units[i][1] for i in gone + added} | {c[1] for i in added for c in calls[i]}
        assert {r.name for r in again.collect()} <= touched
        edges = runtime.cut(callgraph.merge_edges(edges, again, names, frame(units, gone)))
        alive = stayed + added
        got = [(r.caller_id, r.callee_id) for r in edges.collect()]
        assert len(got) == len(set(got))
        assert set(got) == graph(spark, [units[i] for i in alive], [c for i in alive for c in calls[i]])


def test_large_lookups_are_dealt_to_more_tasks(spark, monkeypatch):
    """The joins of a resolution get tasks by the number of calls, not the session's number alone."""
    units = spark.createDataFrame([(i, f"n{i}", None, f"f{i % 5}") for i in range(40)], UNITS)
    calls = spark.createDataFrame([(i % 40, f"n{i % 37}", None) for i in range(400)], "caller_id bigint, name string, receiver string")
    want = sorted(map(str, callgraph.resolve_calls(units, calls).collect()))
    monkeypatch.setattr(runtime, "TASK_ROWS", 10)
    for rows in (0, 1):
        monkeypatch.setattr(runtime, "HOT_ROWS", rows or 10**6)
        found = callgraph.resolve_calls(units, calls)
        plan = found._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
        assert plan.count("REPARTITION_BY_NUM") == 4, plan
        assert sorted(map(str, found.collect())) == want


def test_calls_are_made_once(spark, monkeypatch, tmp_path):
    """No step of the update makes the calls again, with nothing small enough to broadcast."""
    from unitquarry.plans import queries, views

    spark.createDataFrame([(i, f"p{i % 7}", f"Brand#{i % 3}", f"t{i % 4}", i % 5) for i in range(60)], "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    spark.createDataFrame([(i // 4, i % 4, i * 7 % 60) for i in range(200)], "l_orderkey bigint, l_linenumber int, l_partkey bigint").write.parquet(str(tmp_path / "lineitem.parquet"))
    want = sorted(map(str, queries.q_update_edges(spark, str(tmp_path)).collect()))
    made, plain = [], runtime.stored
    monkeypatch.setattr(runtime, "stored", lambda df: made.append(1) or plain(df))
    monkeypatch.setattr(runtime, "BROADCAST_ROWS", 0)
    found = queries.q_update_edges(spark, str(tmp_path))
    plan = found._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert len(made) == 3 and "lineitem" not in plan
    assert want and sorted(map(str, found.collect())) == want
