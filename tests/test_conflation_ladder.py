"""Conflation by a ladder of radii (F10): the two nearest streets of a sample as among all pairs, and few rows for it."""

import math
import random

from velonet.operators import spatial as S


def _made(spark):
    rng = random.Random(4)
    line = lambda k, x1, y1, x2, y2, extra: (k, 1, float(x1), float(y1), float(x2), float(y2), math.hypot(x2 - x1, y2 - y1), extra)
    bikeways = [line(k, x := rng.randrange(800), y := rng.randrange(800), x + rng.randrange(20, 90), y + rng.randrange(-60, 60), k % 5 + 1) for k in range(30)]
    streets = [line(k, rng.randrange(1000), rng.randrange(1000), rng.randrange(1000), rng.randrange(1000), k % 2) for k in range(4000)]
    kind = "line long, seg long, x1 double, y1 double, x2 double, y2 double, len double, "
    return bikeways, streets, spark.createDataFrame(bikeways, kind + "infra int"), spark.createDataFrame(streets, kind + "one_way int")


def _by_pairs(bikeways, streets, step=5.0, reach=40.0, angle=30.0):
    bins = {}
    for _, _, x1, y1, x2, y2, length, infra in bikeways:
        sx, sy, start = (x2 - x1) / length, (y2 - y1) / length, length % step / 2
        for k in range(math.ceil((length - start) / step)):
            t = (k * step + start) / length
            x, y, near = x1 + t * (x2 - x1), y1 + t * (y2 - y1), []
            for line, _, a1, b1, a2, b2, n, one_way in streets:
                dx, dy, px, py = a2 - a1, b2 - b1, x - a1, y - b1
                det = -sy * dy - sx * dx
                if n and abs(sx * dx + sy * dy) > math.cos(math.radians(angle)) * n and 0 <= (u := (-sy * py - sx * px) / det) <= 1 and (d := abs((px * dy - py * dx) / det)) <= reach:
                    near.append((d, line, u * n, one_way))
            near.sort()
            for d, line, at, _ in near[: 2 if len(near) > 1 and near[0][3] == near[1][3] == 1 else 1]:
                key = (line, math.floor(at / step))
                bins[key] = max(bins.get(key, 0), infra)
    out = {}
    for line, _, _, _, _, _, n, _ in streets:
        hit = [v for (k, _), v in bins.items() if k == line]
        if hit:
            size = max(1, math.ceil(n / step))
            out[line] = 0 if 2 * max(size - len(hit), 0) >= size else max(set(hit), key=lambda v: (hit.count(v), v))
    return out


def test_conflation_as_among_all_pairs(spark, monkeypatch):
    radii, search = [], S.passing
    monkeypatch.setattr(S, "passing", lambda p, s, radius, *more: (radii.append(radius), search(p, s, radius, *more))[1])
    bikeways, streets, b, s = _made(spark)
    assert {r["line"]: r["infra"] for r in S.conflate(b, s).collect()} == _by_pairs(bikeways, streets)
    assert len(radii) > 1 and radii[0] < 40.0 == radii[-1]  # dense streets do not all come within the reach


def test_no_streets_or_bikeways(spark):
    _, _, b, s = _made(spark)
    assert S.conflate(b, s.limit(0)).count() == 0 and S.conflate(b.limit(0), s).count() == 0
