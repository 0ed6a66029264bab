"""The planner against a study of the whole network for each scenario, on small random networks."""

import heapq
import random
from collections import defaultdict

import pytest

from velonet.operators import network as N
from velonet.operators import planner as P

LIMIT = 1800.0


def costs(edges, which, built=()):
    out = {}
    for tr, a, b, wf, wb, sf, sb in edges:
        f, r = (sf, sb) if which == "super" else (min(wf, sf), min(wb, sb)) if tr in built else (wf, wb)
        for arc, c in (((a, b), f), ((b, a), r)):
            out[arc] = min(c, out.get(arc, c))
    return out


def distances(arcs, start):
    out, heap = {}, [(0.0, start)]
    around = defaultdict(list)
    for (a, b), c in arcs.items():
        around[a].append((b, c))
    while heap:
        c, n = heapq.heappop(heap)
        if n not in out:
            out[n] = c
            for m, x in around[n]:
                if c + x <= LIMIT:
                    heapq.heappush(heap, (c + x, m))
    return out


def total(edges, o, d, cells, w, built=()):
    times = {}
    for which in ("work", "super"):
        trees = {n: distances(costs(edges, which, built), n) for _, n, _ in d}
        for oi, on, os in o:
            for di, dn, ds in d:
                if on in trees[dn]:
                    key = (which, oi, di)
                    times[key] = min(times.get(key, 1e18), os + trees[dn][on] + ds)
    num, den, pop = defaultdict(int), defaultdict(int), defaultdict(int)
    for _, cell, p in cells:
        pop[cell] += p
    of = {s: c for s, c, _ in cells}
    for (which, oi, di), free in times.items():
        work = times.get(("work", oi, di))
        if which == "super" and 600 < free < LIMIT and work is not None and work < LIMIT:
            num[of[oi]] += int((1e6 * (work / free - 1)) // 1) * w[di]
            den[of[oi]] += w[di]
    return sum(int(pop[c] * num[c] / den[c] // 1) for c in pop if den[c])


def network(seed):
    rng = random.Random(seed)
    edges = []
    for tr in range(1, 61):
        a, b = rng.sample(range(25), 2)
        f, r = rng.randint(60, 400), rng.randint(60, 400)
        edges.append((tr, a, b, float(f + rng.randint(0, 300)), float(r + rng.randint(0, 300)), float(f), float(r)))
    o = [(s, rng.randrange(25), float(rng.randint(0, 90))) for s in range(12) for _ in range(2)]
    d = [(s, rng.randrange(25), float(rng.randint(0, 90))) for s in range(100, 106) for _ in range(2)]
    cells = [(s, s % 4, rng.randint(1, 9)) for s in range(12)]
    return edges, o, d, cells, {s: rng.randint(1, 5) for s in range(100, 106)}, [(tr % 9, tr, 1000 + 37 * tr) for tr in range(1, 31)]


def frames(spark, seed):
    edges, o, d, cells, w, threads = network(seed)
    site = "site_id long, node long, secs double"
    e = spark.createDataFrame(edges, "tr_id long, start_node long, end_node long, work_fwd double, work_bwd double, super_fwd double, super_bwd double")
    study = P.Study(spark.createDataFrame(o, site), spark.createDataFrame(d, site), spark.createDataFrame(cells, "site_id long, cell long, pop long"), spark.createDataFrame(list(w.items()), "site_id long, w long"), 600.0, LIMIT)
    return study, e, spark.createDataFrame(threads, "thread long, tr_id long, len_mm long")


@pytest.mark.parametrize("seed", [1, 2])
def test_plan(spark, seed):
    edges, o, d, cells, w, threads = network(seed)
    study, e, t = frames(spark, seed)
    base = P.baseline(study, e)
    start = total(edges, o, d, cells, w)
    assert base.total().first()["total"] == start
    of, length = defaultdict(set), defaultdict(int)
    for thread, tr, mm in threads:
        of[thread].add(tr)
        length[thread] += mm
    alone = {k: start - total(edges, o, d, cells, w, v) for k, v in of.items()}
    got = {r.thread: r.gain for r in P.marginal_gains(base, e, t).collect()}
    assert got == alone and any(alone.values())
    score = {k: alone[k] / length[k] for k in of}
    rows = sorted(map(tuple, P.plan(base, e, t, 3).collect()))
    want = []
    for iteration in (1, 2):
        order, built, before = sorted(of, key=lambda k: (-score[k], k)), set(), 0
        for rank, k in enumerate(order, 1):
            built |= of[k]
            gain = start - total(edges, o, d, cells, w, built)
            score[k] = (gain - before) / length[k]
            before = gain
            want.append((iteration, rank, k, length[k], sum(length[x] for x in order[:rank]), gain, score[k]))
    assert rows == want


def test_no_threads_and_no_gain(spark):
    study, e, t = frames(spark, 1)
    base = P.baseline(study, e)
    assert P.marginal_gains(base, e, t.limit(0)).collect() == []
    flat = e.withColumns({"work_fwd": e["super_fwd"], "work_bwd": e["super_bwd"]})
    assert {r.gain for r in P.marginal_gains(P.baseline(study, flat), flat, t).collect()} == {0}


def test_loads_of_trips(spark):
    """A line 1-2-3-4 and a branch 2-5; the tree leads to 1."""
    tree = spark.createDataFrame([(1, 1, None), (1, 2, 1), (1, 3, 2), (1, 4, 3), (1, 5, 2), (4, 4, None)], "source long, node long, previous long")
    od = spark.createDataFrame([(10, 20, 700.0, 4, 1), (11, 20, 700.0, 5, 1), (12, 20, 500.0, 3, 1), (13, 20, 900.0, 1, 1), (14, 21, 800.0, 9, 4)], "o_id long, d_id long, secs double, o_node long, d_node long")
    w = spark.createDataFrame([(0, 10, 2.0), (0, 11, 3.0), (0, 12, 50.0), (0, 13, 70.0), (0, 14, 90.0), (1, 20, 10.0), (1, 21, 5.0)], "side int, site_id long, w double")
    got = {(r.node, r.previous): r.load for r in N.trip_loads(tree, od, w, 600.0, 1000.0).collect()}
    assert got == {(4, 3): 20.0, (3, 2): 20.0, (2, 1): 50.0, (5, 2): 30.0}
    edges = spark.createDataFrame([(7, 1, 2, 5.0), (8, 3, 2, 5.0), (9, 3, 4, 5.0), (6, 5, 2, 5.0)], "tr_id long, start_node long, end_node long, len_m double")
    on = {(r.tr_id, r.dir): r.load for r in N.segment_loads(N.trip_loads(tree, od, w, 600.0, 1000.0), edges).collect()}
    assert on == {(9, 1): 20.0, (8, 0): 20.0, (7, 1): 50.0, (6, 0): 30.0}


def test_loads_of_a_long_chain(spark):
    n = 300
    tree = spark.createDataFrame([(0, 0, None)] + [(0, k, k - 1) for k in range(1, n)], "source long, node long, previous long")
    trips = spark.createDataFrame([(0, k, 1.0) for k in range(n)] + [(0, n + 5, 9.0)], "source long, node long, weight double")
    assert {r.node: r.load for r in N.tree_loads(tree, trips).collect()} == {k: float(n - k) for k in range(1, n)}
