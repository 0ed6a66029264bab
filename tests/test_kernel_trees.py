"""The kernel of shortest paths: ways to targets only, trees in many tasks, arcs by Arrow whatever the session says."""

import random

from velonet.operators import network as N
from velonet.plans import adapters as D


def _graph(spark):
    rng = random.Random(3)
    arcs = {(rng.randrange(60), rng.randrange(60)): float(rng.randrange(1, 4)) for _ in range(200)}
    return spark.createDataFrame([(a, b, c) for (a, b), c in arcs.items() if a != b], "src long, dst long, cost double")


def test_ways_to_targets_are_those_of_the_whole_trees(spark):
    graph, sources = _graph(spark), spark.createDataFrame([(s,) for s in range(0, 60, 5)], "source long")
    whole = {(r["source"], r["node"]): r for r in N.paths(graph, sources, 8.0).collect()}
    some = {(r["source"], r["node"]): r for r in N.paths(graph, sources, 8.0, spark.createDataFrame([(n,) for n in (3, 11, 40, 999)], "node long")).collect()}
    needed = set()
    for at in whole:
        while at[1] in (3, 11, 40) or at in needed:
            needed.add(at)
            before = whole[at]["previous"]
            if before is None or (at[0], before) in needed:
                break
            at = (at[0], before)
            needed.add(at)
    assert some == {k: whole[k] for k in needed} and len(needed) < len(whole)


def test_searches_are_dealt_out_to_all_tasks(spark):
    sources = spark.range(0, 60).withColumnRenamed("id", "source")
    assert N.paths(_graph(spark), sources, 8.0).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_arcs_reach_the_driver_by_arrow(spark, monkeypatch):
    monkeypatch.setattr(type(_graph(spark)), "toPandas", lambda self: (_ for _ in ()).throw(AssertionError("rows in the driver")))
    assert N.paths(_graph(spark), spark.range(0, 3).withColumnRenamed("id", "source"), 8.0).count() > 3


def test_ways_of_a_small_table_are_dealt_out(spark):
    assert D.ways(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
