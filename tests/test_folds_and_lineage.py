"""Folds and graph walks against plain loops, with blocks so small that keys span many of them."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import corrections, folds, identity, lineage
from tallyforge.session import ship


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


def test_inbox_of_one_key_with_most_events(spark, monkeypatch):
    monkeypatch.setattr(folds, "BLOCK", 7)
    rng = random.Random(3)
    names = ["claim", "succeed", "retryable_failure", "terminal_failure", "conflict", "other"]
    weights = [8, 1, 8, 0.05, 0.05, 2]
    rows = [("hot" if i % 3 else f"k{i % 50}", i // 2, rng.choices(names, weights)[0], rng.choice([None, i - 5, i, i, i])) for i in range(1500)]
    df = spark.createDataFrame([*rows, (None, 1, "claim", 1)], "k string, seq long, event string, token long").repartition(5)
    got = {r.k: (r.state, r.stale) for r in identity.folded(df, "k").collect()}
    by = defaultdict(list)
    for k, *x in rows:
        by[k].append(x)
    want = {}
    for k, events in by.items():
        state, token, stale = "received", 0, 0
        for _, event, t in sorted(events, key=lambda e: (e[0], e[1], -1 if e[2] is None else e[2])):
            if t is not None and t < token:
                stale += 1
            else:
                state = identity.TRANSITIONS.get((state, event), state)
            token = max(token, t or 0)
        want[k] = (state, stale)
    assert got == want


def test_chains_of_overlays(spark):
    rng = random.Random(4)
    rows = [("hot" if i % 3 else f"e{i % 40}", "f", i // 2, i, rng.choice(["set", "set", "redact", "unknown", "strange"]), rng.choice(["a", "b", None, "[redacted]", "unknown"]), rng.choice(["a", "b", None])) for i in range(900)]
    df = spark.createDataFrame(rows, "entity string, field string, seq long, id long, kind string, base string, value string").repartition(5)
    got = {r.entity: (r.value, r.conflicts) for r in corrections.chained(df).collect()}
    by = defaultdict(list)
    for entity, _, *x in rows:
        by[entity].append(x)
    want = {}
    for entity, chain in by.items():
        chain.sort(key=lambda c: c[:2])
        value, conflicts = chain[0][3], 0
        for _, _, kind, base, new in chain:
            if kind == "strange" or value != base:
                conflicts += 1
            else:
                value = {"set": new, "redact": "[redacted]", "unknown": "unknown"}[kind]
        want[entity] = (value, conflicts)
    assert got == want


def graph(spark, pairs):
    return spark.createDataFrame([*{*pairs}], "from_id long, to_id long")


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    rounds = []
    settled = lineage.settled
    monkeypatch.setattr(lineage, "settled", lambda df: rounds.append(1) or settled(df))
    monkeypatch.setattr(lineage, "SHALLOW", 2)
    e = graph(spark, [(i, i + 1) for i in range(300)])
    nodes = spark.range(301).withColumnRenamed("id", "node")
    assert {(r.node, r.level) for r in lineage.peeled(e, nodes).collect()} == {(i, i) for i in range(301)} and len(rounds) < 25
    rounds.clear()
    met = lineage.reachable(e, spark.createDataFrame([(0,), (250,)], "start long")).collect()
    assert {(r.start, r.node) for r in met} == {(0, i) for i in range(301)} | {(250, i) for i in range(250, 301)} and len(rounds) < 40


def test_a_walk_compares_only_pairs_at_nodes_met_before(spark, monkeypatch):
    """In tiers no pair is looked for among the known ones, and pairs at nodes without steps do not move; edges may repeat."""
    plans, settled = [], lineage.settled
    monkeypatch.setattr(lineage, "settled", lambda df: plans.append(df._jdf.queryExecution().analyzed().toString()) or settled(df))
    walk = lambda pairs, starts: sorted((r.start, r.node) for r in lineage.reachable(spark.createDataFrame(pairs, "from_id long, to_id long"), spark.createDataFrame([(x,) for x in starts], "start long")).collect())
    want = lambda pairs, starts: sorted({(x, y) for x in starts for y in closure(pairs).get(x, set()) | {x}})
    tiers = [(x, 10 + (x + k) % 4) for x in range(6) for k in range(2)] * 2 + [(10 + x, 20 + x % 2) for x in range(4)]
    assert walk(tiers, [0, 1, 5, 99, 99]) == want(tiers, [0, 1, 5, 99])
    assert not any("LeftAnti" in p for p in plans) and sum("Join Inner" in p for p in plans) == 2
    rng = random.Random(5)
    pairs = [(rng.randrange(30), rng.randrange(30)) for _ in range(45)] * 2 + [(100 + i, 101 + i) for i in range(12)] * 2 + [(3, 100), (112, 7)]
    for shallow in (2, 8):
        monkeypatch.setattr(lineage, "SHALLOW", shallow)
        plans.clear()
        assert walk(pairs, [3, 4, 5, 104]) == want(pairs, [3, 4, 5, 104]) and any("LeftAnti" in p for p in plans)


def test_tiers_are_peeled_without_contracting_chains(spark, monkeypatch):
    """Edges may repeat, one node has most of them, and no task makes more than a block of them distinct."""
    monkeypatch.setattr(lineage, "contracted", None)
    monkeypatch.setattr(lineage, "BLOCK", 16)
    parts, settled = [], lineage.settled
    monkeypatch.setattr(lineage, "settled", lambda df: parts.append(df._jdf.queryExecution().optimizedPlan().toString()) or settled(df))
    pairs = [(0, 100 + i) for i in range(60)] * 2 + [(1 + i, 100 + i) for i in range(20)] + [(100 + i, 200) for i in range(60)]
    e = spark.createDataFrame(pairs, "from_id long, to_id long")
    want = {i: 0 for i in range(21)} | {100 + i: 1 for i in range(60)} | {200: 2}
    for nodes in (None, spark.createDataFrame([(i,) for i in [*want, 200, 300]], "node long")):
        parts.clear()
        got = [(r.node, r.level) for r in lineage.peeled(e, nodes).collect()]
        assert sorted(got) == sorted((want if nodes is None else want | {300: 0}).items())
        assert sum("RepartitionByExpression" in p and f", {200 // 16 + 1}" in p for p in parts) == 2


def test_cycles_without_branches_are_told_by_their_chains(spark, monkeypatch):
    """No colours are sent, nodes known to be stuck are not peeled again, and rounds do not square the planned size."""
    monkeypatch.setattr(lineage, "spread", None)
    e = graph(spark, [(i, (i + 1) % 40) for i in range(40)] + [(50, 51), (51, 50), (51, 52), (60, 0), (70, 70)])
    levels = lineage.settled(lineage.peeled(e, e.select(F.explode(F.array("from_id", "to_id")).alias("node"))))
    want = {i: 0 for i in range(40)} | {50: 50, 51: 50, 70: 70}
    for stuck in (None, levels.where("level IS NULL").select("node")):
        assert {r.node: r.component for r in lineage.strongly_connected(e, stuck).collect()} == want
    assert lineage.chains(e)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 60


def test_a_recursive_walk_has_no_row_limit(spark):
    """More ways than Spark's limit of rows, which the session keeps."""
    key = "spark.sql.cteRecursionRowLimit"
    spark.conf.set(key, "50")
    try:
        e = graph(spark, [(0, i) for i in range(1, 41)] + [(i, 100) for i in range(1, 41)])
        met = lineage.reachable_sql(spark, e, spark.createDataFrame([(0,)], "start long")).collect()
        assert sorted((r.start, r.node) for r in met) == [(0, i) for i in [*range(41), 100]]
        assert spark.conf.get(key) == "50"
    finally:
        spark.conf.unset(key)


def closure(pairs):
    after = defaultdict(set)
    for a, b in pairs:
        after[a].add(b)
    out = {}
    for a in {x for p in pairs for x in p}:
        seen, work = set(), [a]
        while work:
            for y in after[work.pop()] - seen:
                seen.add(y)
                work.append(y)
        out[a] = seen
    return out


@pytest.mark.parametrize("seed", [1])
def test_cycles_and_what_is_behind_them(spark, seed):
    rng = random.Random(seed)
    pairs = {(rng.randrange(40), rng.randrange(40)) for _ in range(26)} | {(100 + i, 101 + i) for i in range(9)} | {(109, 104), (200, 201), (201, 200), (201, 300), (300, 301), (50, 200), (400, 400), (400, 401)}
    after = closure(pairs)
    want = {a: min(b for b in after[a] if a in after[b]) for a in after if a in after[a]}
    e = graph(spark, pairs)
    assert {r.node: r.component for r in lineage.strongly_connected(e).collect()} == want
    levels = {r.node: r.level for r in lineage.peeled(e, e.select(F.explode(F.array("from_id", "to_id")).alias("node"))).collect()}
    before = defaultdict(set)
    for a, bs in after.items():
        for b in bs:
            before[b].add(a)
    stuck = {a for a in after if a in want or before[a] & want.keys()}
    assert {a for a, n in levels.items() if n is None} == stuck
    longest = lambda a: max((longest(x) + 1 for x, y in pairs if y == a), default=0)
    assert all(levels[a] == longest(a) for a in after if a not in stuck)
    nodes = spark.createDataFrame([(str(a), "c") for a in after], "node_id string, company_id string")
    got = {(r.node_id, r.problem) for r in lineage.gaps(e.selectExpr("string(from_id) from_id", "string(to_id) to_id"), nodes, nodes.select("node_id")).collect()}
    assert got == {(str(a), "in_cycle") for a in want} | {(str(a), "behind_cycle") for a in stuck - want.keys()}
