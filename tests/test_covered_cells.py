"""Cells that polygons cover as a whole, and what is found by them."""

import math
import random

from velonet.operators import spatial as S


def star(rng, k):
    """A ring of nine corners around a place, far and near by turns."""
    x, y = rng.uniform(-50, 150), rng.uniform(-50, 150)
    at = [(x + r * math.cos(a), y + r * math.sin(a)) for i in range(9) for a, r in [(2 * math.pi * i / 9, rng.uniform(8, 20) if i % 2 else rng.uniform(30, 60))]]
    return k, [p[0] for p in at], [p[1] for p in at]


def holds(p, ring):
    _, xs, ys = ring
    hit = [(ys[i] > p[1]) != (ys[j] > p[1]) and p[0] < (xs[j] - xs[i]) * (p[1] - ys[i]) / (ys[j] - ys[i]) + xs[i] for i in range(len(xs)) for j in [(i + 1) % len(xs)]]
    return sum(hit) % 2 == 1


def test_points_by_whole_cells(spark):
    rng = random.Random(11)
    rings = [star(rng, k) for k in range(25)] + [(25, [0.0, 40.0, 40.0, 0.0], [0.0, 0.0, 40.0, 40.0])]
    points = [(i, *rng.choice(((rng.uniform(-120, 220), rng.uniform(-120, 220)), (rng.randrange(-2, 12) * 5.0, rng.randrange(-2, 12) * 5.0))), rng.randrange(1, 100) / 4) for i in range(1500)]
    polygons = spark.createDataFrame(rings + [(26, [], []), (27, None, None)], "poly long, xs array<double>, ys array<double>")
    at = spark.createDataFrame(points, "id long, x double, y double, w double")
    pairs = [(r[0], p) for r in rings for p in points if holds(p[1:3], r)]
    whole, _ = S.covered_cells(polygons, 5.0)
    cells = [tuple(c) for c in whole.select("poly", "cx", "cy").collect()]
    # most of the area is settled by cells alone, each once, and such a cell holds no point that is outside
    assert len(cells) == len(set(cells)) > 25 * 20
    assert all(holds(((cx + dx) * 5, (cy + dy) * 5), rings[k]) for k, cx, cy in cells for dx in (0, 0.5, 0.999) for dy in (0, 0.5, 0.999))
    want = {}
    for k, p in pairs:
        n, w = want.get(k, (0, 0.0))
        want[k] = (n + 1, w + p[3])
    assert {r["poly"]: (r["n"], r["weight"]) for r in S.sums_in_polygons(at, polygons, 40.0, "w").collect()} == want
    first = {}
    for k, p in pairs:
        first[p[0]] = min(k, first.get(p[0], k))
    assert dict(map(tuple, S.polygon_of_points(at, polygons, 40.0).collect())) == first
