"""Indexes, strong components and levels of chains, against plans and brute force."""

import random
from collections import Counter, defaultdict

import pytest
from juriscope.operators import condense, edges, history, later_courts
from juriscope.plans.indexes import bucketed, graph

SF = "/root/testdata/sf0.001"


@pytest.fixture()
def no_broadcast(spark):
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_and_frontiers_read_edges_without_an_exchange(spark, no_broadcast):
    g = graph(spark, SF)
    assert "Exchange" not in plan(later_courts.rows(edges.valid(g.views)))
    assert "Exchange" not in plan(edges.direct_history(g.views))
    for step, a, b in ((g.down, "actor", "target"), (g.up, "target", "actor")):
        front = spark.range(50).selectExpr("id AS cluster_id", "id AS node").repartition(3)
        found = plan(history.hop(front, step.selectExpr(f"{a} AS node", f"{b} AS next")))
        # What is sent is the frontier (dealt by this test, then by node).
        assert found.count("Exchange hashpartitioning(node") == 1 and found.count("Exchange") == 2 and "Bucketed: true" in found


def test_an_index_is_built_once(spark):
    first, second = graph(spark, SF), graph(spark, SF)
    assert first is second and first.views is second.views


def test_buckets_keep_every_row(spark):
    rows = [(k % 7, k) for k in range(100)] + [(None, 1), (None, 1)]
    frame = spark.createDataFrame(rows, "a long, b long")
    assert Counter(map(tuple, bucketed(frame, "test", ["a"], 3).collect())) == Counter(rows)


def reached(pairs):
    out = defaultdict(set)
    nodes = {x for p in pairs for x in p}
    for x in nodes:
        queue = [x]
        while queue:
            for b in {b for a, b in pairs if a == queue[-1]} - out[x] if queue else ():
                out[x].add(b)
                queue.insert(0, b)
            queue.pop()
    return nodes, out


@pytest.mark.parametrize("seed", range(4))
def test_components_and_what_they_reach(spark, seed):
    rng = random.Random(seed)
    n = (5, 12, 30, 40)[seed]
    pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range((3, 14, 40, 45)[seed])]
    nodes, out = reached(pairs)
    frame = spark.createDataFrame(pairs, "actor long, target long")
    members = condense.components(frame)
    cycle = {x: {y for y in out[x] if x in out[y]} | {x} for x in nodes}
    want = {(x, min(c)) for x, c in cycle.items() if len(c) > 1}
    assert sorted(map(tuple, members.collect())) == sorted(want)
    steps = condense.condensed(frame, members)
    counts = condense.reach_counts(spark.createDataFrame([(x,) for x in sorted(nodes | {99})], "node long"), members, condense.closure(steps))
    told = {(x, min(cycle[x]), len(cycle[x]), len(out[x] - {x}), sum(x in out[y] and y not in out[x] and y != x for y in nodes)) for x in nodes} | {(99, 99, 1, 0, 0)}
    assert set(map(tuple, counts.collect())) == told


def test_no_pairs(spark):
    none = spark.createDataFrame([], "actor long, target long")
    assert condense.components(none).count() == 0 and condense.closure(condense.condensed(none, condense.components(none))).count() == 0


def test_levels_follow_those_found_before(spark):
    """Sequentially: levels of earlier nodes count for later ones."""
    rng = random.Random(3)
    nodes, links, want = [], [], set()
    for chain in range(60):
        n = rng.randrange(1, 7)
        kinds = [(rng.choice(["self", "below", "reported"]), rng.choice([0, 1, 2, 3, 99, 99])) for _ in range(n)]
        acting = [rng.choice(["a court", "the United States Supreme Court"]) for _ in range(n)]
        es = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(2 * n))]
        levels = [x for _, x in kinds]
        for at, (role, level) in enumerate(kinds):
            if level == 99:
                near = [levels[b] for a, b in es if a == at] if role == "reported" else [levels[a] for a, b in es if b == at]
                near = [x for x in near if x < 99]
                top = role == "reported" and "Supreme" in acting[at]
                levels[at] = (0 if top or not near else max(min(near) - 1, 0)) if role == "reported" else min(max(near) + 1, 4) if near else 4
        nodes += [(chain, at, role, level, acting[at], "") for at, (role, level) in enumerate(kinds)]
        links += [(chain, a, b) for a, b in es]
        want |= {(chain, at, x) for at, x in enumerate(levels)}
    got = history.placed(spark.createDataFrame(nodes, "cluster_id long, at int, role string, level int, acting_case string, court string"), spark.createDataFrame(links, "cluster_id long, actor int, target int"))
    assert {(r.cluster_id, r.at, r.level) for r in got.collect()} == want
