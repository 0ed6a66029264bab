"""Polygon kernels: areas are conserved, pieces add up, hulls contain their points."""

import math
import random

from pyspark.sql import functions as F

from velonet.functions import arrays as A
from velonet.operators import polygons as P

RING = "poly long, xs array<double>, ys array<double>"
L_SHAPE = (1, [0.0, 4.0, 4.0, 1.0, 1.0, 0.0], [0.0, 0.0, 1.0, 1.0, 3.0, 3.0])


def test_triangles_keep_the_area(spark):
    star = [(1 + (k % 2)) * 2 for k in range(10)]
    rows = [L_SHAPE, (2, [r * math.cos(k * math.pi / 5) for k, r in enumerate(star)][::-1], [r * math.sin(k * math.pi / 5) for k, r in enumerate(star)][::-1])]
    df = spark.createDataFrame(rows, RING)
    area = A.shoelace(F.col("xs"), F.col("ys"))
    want = {r["poly"]: r["a"] for r in df.select("poly", area.alias("a")).collect()}
    got = {r["poly"]: (r["a"], r["n"]) for r in P.triangulate(df).groupBy("poly").agg(F.sum(area).alias("a"), F.count(F.lit(1)).alias("n")).collect()}
    assert want[1] == 6.0
    for k, (_, xs, _) in zip((1, 2), rows, strict=True):
        assert abs(got[k][0] - want[k]) < 1e-9 and got[k][1] == len(xs) - 2


def test_clipping(spark):
    poly = spark.createDataFrame([L_SHAPE], RING)
    segs = spark.createDataFrame([(1, 0, -1.0, 0.5, 5.0, 0.5), (2, 0, 0.5, 2.0, 9.0, 2.0), (3, 0, 2.0, -1.0, 2.0, 5.0), (4, 0, 2.0, 2.0, 3.0, 2.5)], "line long, seg long, x1 double, y1 double, x2 double, y2 double")
    got = {r["line"]: round(r["len"], 9) for r in P.clip_segments(segs, poly, 1.0).groupBy("line").agg(F.sum("len").alias("len")).collect()}
    assert got == {1: 4.0, 2: 0.5, 3: 1.0}


def test_cleaning_and_buffers(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0, 10.0, 10.0, 0.0], [0.0, 0.0, 0.0, 10.0, 0.0])], RING)
    xs, ys = P.clean_ring(F.col("xs"), F.col("ys"))
    assert df.select(xs.alias("x")).first()["x"] == [0.0, 10.0, 10.0]
    square = spark.createDataFrame([(1, [0.0, 10.0, 10.0, 0.0], [0.0, 0.0, 10.0, 10.0]), (2, [11.0, 20.0, 20.0, 11.0], [0.0, 0.0, 10.0, 10.0])], RING)
    n = P.dilated_cells(square, 2.0, 0.5).count() * 0.25
    assert abs(n - (20 * 10 + 2 * 2 * 30 + math.pi * 4)) < 4


def test_ring_samples(spark):
    df = spark.createDataFrame([L_SHAPE, (2, [5.0, 5.0], [1.0, 1.0]), (3, [], []), (4, None, None), (5, [0.0, 3.0, 0.0], [0.0, 0.0, 4.0])], RING)
    got = {(r["poly"], r["k"]): (round(r["x"], 9), round(r["y"], 9)) for r in P.sample_rings(df, 2.5).collect()}
    assert got == {(1, 0): (0, 0), (1, 1): (2.5, 0), (1, 2): (4, 1), (1, 3): (1.5, 1), (1, 4): (1, 3), (1, 5): (0, 1.5), (5, 0): (0, 0), (5, 1): (2.5, 0), (5, 2): (1.8, 1.6), (5, 3): (0.3, 3.6), (5, 4): (0, 2)}


def test_hulls(spark):
    rng = random.Random(3)
    pts = [(k % 2, rng.gauss(0, 10), rng.gauss(0, 5)) for k in range(600)] + [(5, 1.0, 2.0)]
    got = {r["g"]: list(zip(r["xs"], r["ys"], strict=True)) for r in P.hulls(spark.createDataFrame(pts, "g long, x double, y double"), "g").collect()}
    assert got[5] == [(1.0, 2.0)]
    for g in (0, 1):
        h = got[g]
        assert set(h) <= {(x, y) for k, x, y in pts if k == g}
        for k in range(len(h)):
            assert P._turn(h[k - 1], h[k], h[(k + 1) % len(h)]) > 0
            assert all(P._turn(h[k - 1], h[k], (x, y)) >= -1e-9 for j, x, y in pts if j == g)
