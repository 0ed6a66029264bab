"""The spline of a raster passes through its cells and equals the one that a dense solution gives."""

import random

import numpy as np
import pytest

from velonet.operators import spatial as S


def dense(h, axis):
    """Coefficients along an axis: neighbours by 1/6, 4/6, 1/6, mirrored at the ends."""
    n = h.shape[axis]
    m = np.zeros((n, n))
    for i in range(n):
        for k, w in ((-1, 1 / 6), (0, 4 / 6), (1, 1 / 6)):
            m[i, (abs(i + k) if i + k < n else 2 * (n - 1) - i - k)] += w
    return np.moveaxis(np.linalg.solve(m, np.moveaxis(h, axis, 0).reshape(n, -1)).reshape(np.moveaxis(h, axis, 0).shape), 0, axis)


@pytest.mark.parametrize("shape", [(30, 45), (3, 60), (2, 5)])
def test_coefficients(spark, shape):
    rng = random.Random(shape[0])
    h = np.array([[rng.uniform(0, 2000) for _ in range(shape[1])] for _ in range(shape[0])])
    cells = spark.createDataFrame([(c + 7, r - 2, float(h[r, c])) for r in range(shape[0]) for c in range(shape[1])], "col long, row long, h double").repartition(3)
    want = dense(dense(h, 1), 0)
    got = {(r["col"] - 7, r["row"] + 2): r["h"] for r in S.spline_coefficients(cells).collect()}
    assert len(got) == h.size and all(abs(got[c, r] - want[r, c]) < 1e-6 for r in range(shape[0]) for c in range(shape[1]))


def test_heights_at_the_cells(spark):
    rng = random.Random(5)
    h = {(c, r): rng.uniform(-100, 900) for c in range(12) for r in range(9)}
    cells = spark.createDataFrame([(c, r, v) for (c, r), v in h.items()], "col long, row long, h double")
    points = spark.createDataFrame([(c * 100 + r, 10.0 * c + 5, 90.0 - 10 * r - 5) for c, r in h], "id long, x double, y double")
    got = {divmod(r["id"], 100): r["h"] for r in S.raster_sample(points, cells, 0.0, 90.0, 10.0, spline=True).collect()}
    assert len(got) == 9 * 6 and all(abs(v - h[k]) < 1e-6 for k, v in got.items())
