"""Invariants and brute-force comparisons of the spatial and network operators."""

import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from velonet.operators import network as N
from velonet.operators import spatial as S
from velonet.operators import study as U


def grid(n=4):
    """Edges of an n x n grid with costs of their own."""
    rng, edges, k = random.Random(1), [], 0
    for x in range(n):
        for y in range(n):
            for a, b in ((x + 1, y), (x, y + 1)):
                if a < n and b < n:
                    edges.append((k, x * n + y, a * n + b, float(rng.randint(1, 9)), float(rng.randint(1, 9))))
                    k += 1
    return edges


def brute(edges, source, limit):
    near = {}
    for _, a, b, f, r in edges:
        near.setdefault(a, []).append((b, f))
        near.setdefault(b, []).append((a, r))
    best, heap = {}, [(0.0, source)]
    while heap:
        c, n = heapq.heappop(heap)
        if n in best:
            continue
        best[n] = c
        for m, w in near[n]:
            if c + w <= limit:
                heapq.heappush(heap, (c + w, m))
    return best


@pytest.fixture(scope="module")
def graph(spark):
    edges = grid()
    df = spark.createDataFrame(edges, "tr_id long, start_node long, end_node long, fwd_s double, bwd_s double")
    return edges, df, N.arcs(df, "min")


def test_paths_two_ways(spark, graph):
    edges, _, arcs = graph
    sources = spark.createDataFrame([(0,), (5,), (99,)], "source long")
    want = {(s, n): c for s in (0, 5) for n, c in brute(edges, s, 15.0).items()}
    kernel = {(r["source"], r["node"]): r["cost"] for r in N.paths(arcs, sources, 15.0).collect()}
    assert kernel.pop((99, 99)) == 0.0
    assert kernel == want
    joins = {(r["source"], r["node"]): r["cost"] for r in N.frontier_paths(arcs, sources.filter("source < 90"), 15.0).collect()}
    assert joins == want


def test_loads_are_conserved(spark, graph):
    edges, _, arcs = graph
    tree = N.paths(arcs, spark.createDataFrame([(0,)], "source long"), 1000.0)
    trips = spark.createDataFrame([(0, n, 2.0) for n in range(1, 16)], "source long, node long, weight double")
    rows = N.tree_loads(tree, trips).collect()
    assert sum(r["load"] for r in rows if r["previous"] == 0) == 30.0
    hops = {r["node"]: r["previous"] for r in tree.collect()}
    want = {}
    for n in range(1, 16):
        while n != 0:
            want[n, hops[n]] = want.get((n, hops[n]), 0) + 2.0
            n = hops[n]
    assert {(r["node"], r["previous"]): r["load"] for r in rows} == want


def test_parallel_arcs(spark):
    df = spark.createDataFrame([(1, 1, 2, 3.0, 4.0), (2, 1, 2, 5.0, 6.0)], "tr_id long, start_node long, end_node long, fwd_s double, bwd_s double")
    assert {(r["src"], r["cost"]) for r in N.arcs(df, "sum").collect()} == {(1, 8.0), (2, 10.0)}
    assert {(r["src"], r["cost"]) for r in N.arcs(df, "min").collect()} == {(1, 3.0), (2, 4.0)}


def test_components_against_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)]
    parent = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        p, q = find(a), find(b)
        parent[max(p, q)] = min(p, q)
    got = {r["node"]: r["root"] for r in N.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for e in edges if e[0] != e[1] for n in e}
    assert N.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_topology_of_a_crossing(spark):
    rows = [(1, 1, 10, 0, 0), (1, 2, 11, 1, 0), (1, 3, 12, 2, 0), (2, 1, 13, 1, 1), (2, 2, 11, 1, 0), (2, 3, 14, 1, -1), (3, 1, 15, 5, 5), (3, 2, 16, 6, 5), (3, 3, 15, 5, 5)]
    v = spark.createDataFrame(rows, "way_id long, seq long, node_id long, x long, y long")
    assert {r["node_id"] for r in N.junctions(v).collect()} == {10, 11, 12, 13, 14, 15}
    parts = {(r["way_id"], r["start_node"], r["end_node"], r["len_m"]) for r in N.split_ways(v).collect()}
    assert parts == {(1, 10, 11, 1.0), (1, 11, 12, 1.0), (2, 13, 11, 1.0), (2, 11, 14, 1.0), (3, 15, 15, 2.0)}


def test_greedy_clusters(spark):
    pairs = [(1, 2), (2, 3), (3, 4), (7, 8)]
    got = {r["site_id"]: r["head"] for r in N.cluster_sites(spark.createDataFrame(pairs, "a long, b long"), spark.range(1, 10).withColumnRenamed("id", "site_id")).collect()}
    # 1 claims 2; 2 claims 1 and 3 under 1; 3 claims 4; 4 finds nobody free
    assert got == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8, 9: 9} | {8: 8, 7: 7}


def test_nearest_line_against_brute_force(spark):
    rng = random.Random(2)
    segs = [(i, 0, rng.uniform(0, 1000), rng.uniform(0, 1000)) for i in range(60)]
    segs = [(i, s, x, y, x + rng.uniform(-80, 80), y + rng.uniform(-80, 80)) for i, s, x, y in segs]
    pts = [(i, rng.uniform(0, 1000), rng.uniform(0, 1000)) for i in range(40)]
    s = spark.createDataFrame(segs, "line long, seg long, x1 double, y1 double, x2 double, y2 double")
    p = spark.createDataFrame(pts, "id long, x double, y double")
    got = {r["id"]: (r["line"], round(r["dist"], 6)) for r in S.nearest_line(p, s, 150.0, 20.0).collect()}

    def dist(px, py, g):
        _, _, a, b, c, d = g
        t = max(0, min(1, ((px - a) * (c - a) + (py - b) * (d - b)) / ((c - a) ** 2 + (d - b) ** 2)))
        return math.hypot(px - a - t * (c - a), py - b - t * (d - b))

    want = {}
    for i, x, y in pts:
        d, line = min((dist(x, y, g), g[0]) for g in segs)
        if d < 150:
            want[i] = (line, round(d, 6))
    assert got == want


def test_line_samples(spark):
    v = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 10.0, 0.0), (1, 2, 10.0, 7.0)], "line long, seq long, x double, y double")
    rows = sorted((r["k"], round(r["pos"], 6), round(r["x"], 6), round(r["y"], 6)) for r in S.sample_lines(S.segments_of(v), 5.0).collect())
    gap = 17 / 4
    assert [r[1] for r in rows] == [round(k * gap, 6) for k in range(5)]
    assert rows[0][2:] == (0.0, 0.0) and rows[-1][2:] == (10.0, 7.0)
    centred = sorted(round(r["pos"], 6) for r in S.sample_lines(S.segments_of(v), 5.0, centred=True).collect())
    assert centred == [1.0, 6.0, 11.0, 16.0]


def test_conflation_prefers_parallel_streets(spark):
    seg = "line long, seg long, x1 double, y1 double, x2 double, y2 double, len double"
    lines = spark.createDataFrame([(1, 0, 0.0, 3.0, 100.0, 3.0, 100.0, 4)], seg + ", infra int")
    streets = spark.createDataFrame([(10, 0, 0.0, 0.0, 100.0, 0.0, 100.0, 0), (11, 0, 50.0, -50.0, 50.0, 50.0, 100.0, 0), (12, 0, 0.0, 12.0, 100.0, 12.0, 100.0, 0)], seg + ", one_way int")
    assert {r["line"]: r["infra"] for r in S.conflate(lines, streets).collect()} == {10: 4}
    pair = streets.withColumn("one_way", F.lit(1))
    assert {r["line"]: r["infra"] for r in S.conflate(lines, pair).collect()} == {10: 4, 12: 4}


def test_tiers_and_weighted_mean(spark):
    s = spark.createDataFrame([(k, 1, 10.0, float(-k)) for k in range(10)], "thread long, grp int, len_m double, gain double")
    assert [r["tier"] for r in U.tiers(s, "gain", "len_m", "grp").orderBy("thread").collect()] == [7, 7, 6, 6, 5, 5, 5, 5, 5, 5]
    w = spark.createDataFrame([(1, 2.0, 1.0), (1, float("nan"), 5.0), (1, 4.0, 3.0), (2, float("inf"), 1.0)], "cell int, v double, w double")
    assert {r["cell"]: (r["mean"], r["weight"]) for r in U.weighted_mean(w, ["cell"], "v", "w").collect()} == {1: (3.5, 4.0), 2: (None, 0.0)}
