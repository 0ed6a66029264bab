"""The unbounded path queries start from every supplier, and their costs are those of shortest paths."""

import heapq
import os

import pytest

from velonet.operators import network as N
from velonet.plans import network_queries as Q
from velonet.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are absent")


def test_dijkstra_takes_all_suppliers(spark):
    want = {r[0] * 20 for r in spark.read.parquet(f"{DATA}/supplier.parquet").select("s_suppkey").collect()}
    got = {}
    for r in registry.QUERIES["g08_dijkstra"](spark, DATA).collect():
        got.setdefault(r["source"], {})[r["node"]] = r["cost"]
    assert set(got) == want and any(s // 20 % 4 for s in want)
    near = {}
    for r in N.arcs(Q._edges(spark, DATA), "min").collect():
        near.setdefault(r["src"], []).append((r["dst"], float(r["cost"])))
    for source in sorted(want)[:6]:
        best, heap = {}, [(0.0, source)]
        while heap:
            c, n = heapq.heappop(heap)
            if n not in best:
                best[n] = c
                for m, w in near.get(n, []):
                    if c + w <= 8000.0:
                        heapq.heappush(heap, (c + w, m))
        assert got[source] == best


def test_loads_go_to_all_suppliers(spark):
    tree = registry.QUERIES["g08_dijkstra"](spark, DATA).collect()
    roots = {r["source"] for r in tree}
    last = {r["previous"] for r in tree if r["cost"] > 600 and r["previous"] in roots}
    assert any(s // 20 % 4 for s in last)
    loads = registry.QUERIES["g13_tree_loads"](spark, DATA).collect()
    assert loads and last <= {r["previous"] for r in loads}
