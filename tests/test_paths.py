"""Paths and clusters against plain searches."""

import random
from collections import defaultdict, deque

import pytest

from ledgerloom.operators import paths


def search(edges, source):
    """Hops and parent of each node reached, the least parent of the level before."""
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
    hops, queue = {source: 0}, deque([source])
    while queue:
        a = queue.popleft()
        for b in near[a]:
            if b not in hops:
                hops[b] = hops[a] + 1
                queue.append(b)
    parent = {b: min(a for a in hops if b in near[a] and hops[a] == hops[b] - 1) for b in hops if hops[b]}
    return hops, parent


def brute(edges, pairs, most):
    out = []
    for s, t in sorted(set(pairs)):
        hops, parent = search(edges, s)
        if hops.get(t, most + 1) <= most:
            path = [t]
            while path[0] != s:
                path.insert(0, parent[path[0]])
            out.append((s, t, hops[t], path))
    return out


def frame(spark, edges):
    return spark.createDataFrame(edges, "a string, b string")


@pytest.mark.parametrize("seed", [1, 2])
def test_shortest_paths(spark, seed):
    rng = random.Random(seed)
    nodes = [f"n{k:02}" for k in range(30)]
    edges = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(45)]
    pairs = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(40)] + [("n01", "n01"), ("zz", "n01")]
    df = frame(spark, [*edges, *edges[:5], ("n03", None), (None, "n04")])
    wanted = spark.createDataFrame([*pairs, pairs[0], (None, "n01"), ("n01", None)], "source string, target string")
    found = sorted(tuple(r) for r in paths.shortest(df, wanted, 5).collect())
    assert found == [x for x in brute(edges, pairs, 5)]


def test_no_pairs_and_no_edges(spark):
    none = spark.createDataFrame([], "source string, target string")
    assert paths.shortest(frame(spark, [("a", "b")]), none).count() == 0
    assert paths.shortest(frame(spark, []), spark.createDataFrame([("a", "b")], "source string, target string")).count() == 0


def test_many_sources_share_a_row_of_a_round(spark, monkeypatch):
    monkeypatch.setattr(paths, "BITS", 4)
    rng = random.Random(5)
    edges = [(f"n{rng.randrange(25):02}", f"n{rng.randrange(25):02}") for _ in range(35)]
    sources = [f"n{k:02}" for k in range(0, 25, 2)] + ["zz"]
    df = paths.reached(frame(spark, edges), spark.createDataFrame([(s,) for s in sources], "source string"), 4, undirected=True)
    both = [*edges, *((b, a) for a, b in edges)]
    want = {(s, n, h, search(both, s)[1].get(n)) for s in sources for n, h in search(both, s)[0].items() if h <= 4}
    assert {tuple(r) for r in df.collect()} == want and df.count() == len(want)
    got = {(r["source"], r["target"]): r["path"] for r in paths.walked(df).collect()}
    assert got == {(s, t): p for s, t, _, p in brute(both, [w[:2] for w in want], 4)}


def mutual(edges):
    nodes = {x for e in edges for x in e}
    reach = {n: set(search(edges, n)[0]) for n in nodes}
    return {n: min(m for m in reach[n] if n in reach[m]) for n in nodes}


def test_clusters_of_chains_cycles_and_random_graphs(spark):
    rng = random.Random(3)
    cycle = [(f"c{k:02}", f"c{(k + 1) % 24:02}") for k in range(24)]
    chain = [(f"d{k:02}", f"d{k + 1:02}") for k in range(8)]
    parts = [(f"r{rng.randrange(40):02}", f"r{rng.randrange(40):02}") for _ in range(60)]
    two = [("e1", "e2"), ("e2", "e1"), ("e2", "f1"), ("f1", "f2"), ("f2", "f1"), ("c05", "e1"), ("g", "g")]
    # a label's smallest node that is in no cycle, before a cycle
    late = [("a0", "b0"), ("b0", "b1"), ("b1", "b2"), ("b2", "b1"), ("b2", "b3"), ("b3", "b4"), ("b4", "b3")]
    edges = cycle + chain + parts + two + late
    rng.shuffle(edges)
    found = {r["node"]: r["cluster"] for r in paths.clusters(frame(spark, [*edges, *edges[:4], ("x", None)])).collect()}
    assert found == mutual(edges)
    assert sum(c == "c00" for c in found.values()) == 24


def test_clusters_of_nothing(spark):
    assert paths.clusters(frame(spark, [])).count() == 0
    assert [tuple(r) for r in paths.clusters(frame(spark, [("a", "b")])).orderBy("node").collect()] == [("a", "a"), ("b", "b")]


def test_rounds_of_clusters_send_no_table_over_the_driver(spark, monkeypatch):
    plans = []

    def recorded(*args, of=paths.scratch):
        cut = of(*args)
        return lambda df, **kept: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df, **kept)

    monkeypatch.setattr(paths, "scratch", recorded)
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 4)], "a int, b int")
    assert sorted(map(tuple, paths.clusters(edges).collect())) == [(1, 1), (2, 1), (3, 3), (4, 4)]
    assert len(plans) > 5 and not any("Broadcast" in p for p in plans)
