"""Points and lines that pass near them, found by direction and height (F2): all pairs, and few rows a point."""

import random

import numpy as np
from pyspark.sql import functions as F

from velonet.operators import spatial as S


def test_no_pair_within_the_radius_is_left_out():
    rng = np.random.default_rng(3)
    px, py = rng.integers(0, 1000, 700).astype(float), rng.integers(0, 900, 700).astype(float)
    ends = rng.integers(-200, 1200, (4, 5000)).astype(float)
    ends[2, :300], ends[3, 300:600], ends[2:, 600:610] = ends[0, :300], ends[1, 300:600], ends[:2, 600:610]  # upright, level, without length
    x1, y1, dx, dy = ends[0], ends[1], ends[2] - ends[0], ends[3] - ends[1]
    t = np.clip(((px[:, None] - x1) * dx + (py[:, None] - y1) * dy) / np.maximum(dx * dx + dy * dy, 1), 0, 1)
    dist = np.hypot(px[:, None] - x1 - t * dx, py[:, None] - y1 - t * dy)
    for radius in (0.5, 40.0, 3000.0):
        pairs = [(int(p), int(s)) for i, j in S.met_pairs(px, py, tuple(ends), radius) for p, s in zip(i, j, strict=True)]
        assert len(pairs) == len(set(pairs)) and set(zip(*(c.tolist() for c in np.nonzero(dist <= radius)), strict=True)) <= set(pairs)


def test_tasks_pass_on_the_nearest_only(spark):
    rng = random.Random(8)
    at = lambda: rng.randrange(1000)
    points = spark.createDataFrame([(i, at(), at()) for i in range(50)], "id long, x long, y long")
    # half of all lines run in one direction
    lines = [(k, 1, at(), at(), at(), at()) for k in range(1000)] + [(k, 1, 0, k - 1000, 1000, k - 900) for k in range(1000, 2000)]
    lines = spark.createDataFrame(lines, "line long, seg long, x1 long, y1 long, x2 long, y2 long")
    met = S.passing(points, lines, 50.0, 200.0, 50, (0.0, 1000.0, 0.0, 1000.0))
    assert met.count() <= 50 * 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    every = S.with_foot(points.crossJoin(lines)).groupBy("id").agg(F.min(F.struct("dist", "line", "seg")).alias("m"))
    want = {tuple(r) for r in every.select("id", "m.line", "m.dist").collect()}
    assert {tuple(r) for r in S.nearest_line(points, lines, 2000.0, 200.0).select("id", "line", "dist").collect()} == want
