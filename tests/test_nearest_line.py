"""Nearest lines against brute force, and what the search sends through its exchanges."""

import random

from pyspark.sql import functions as F

from velonet.operators import spatial as S


def _made(spark):
    rng = random.Random(5)
    at = lambda: rng.randrange(-1000, 1000)
    points = [(i, at(), at()) for i in range(120)] + [(500, 5000, 5000), (501, None, 3)]
    lines = [(k, s, at(), at(), at(), at()) for k in range(60) for s in (1, 2)]
    lines += [(70, 1, 10, -900, 10, 900), (71, 1, -900, 20, 900, 20), (72, 1, 5, 5, 5, 5), (73, 1, 10, 900, 10, -900)]
    return spark.createDataFrame(points, "id long, x long, y long"), spark.createDataFrame(lines, "line long, seg long, x1 long, y1 long, x2 long, y2 long")


def test_nearest_lines_as_by_brute_force(spark):
    points, lines = _made(spark)
    every = S.with_foot(points.crossJoin(lines)).groupBy("id").agg(F.min(F.struct("dist", "line", "seg", "share", "fx", "fy")).alias("m"))
    for reach, size, first in ((400.0, 50.0, 20.0), (3.0, 50.0, None), (7000.0, 200.0, 50.0)):
        want = {tuple(r) for r in every.select("id", "m.line", "m.seg", "m.share", "m.fx", "m.fy", "m.dist").filter(F.col("dist") < reach).collect()}
        assert {tuple(r) for r in S.nearest_line(points, lines, reach, size, first).collect()} == want
    assert S.nearest_line(points.limit(0), lines, 400.0, 50.0).count() == 0
    assert S.nearest_line(points, lines.limit(0), 400.0, 50.0).count() == 0


def test_exchanges_carry_blocks_not_cells(spark):
    points, lines = _made(spark)
    with S.colocated(spark):
        plan = S.passing(points.filter("x is not null"), lines, 1.0, 10.0, 121, (-1000.0, 5000.0, -1000.0, 5000.0))._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in plan.splitlines() if "Exchange" in x]
    assert dealt and not any("place" in x for x in dealt)
