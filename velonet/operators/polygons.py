"""Polygon operators: cleaning, clipping of segments, hulls, triangles, and dissolved buffers on a grid."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from velonet.functions import arrays as A

from . import spatial as S


def clean_ring(xs: Column, ys: Column) -> tuple[Column, Column]:
    """A ring without consecutive equal corners and without its closing corner."""
    pts = A.without_repeats(F.arrays_zip(xs.alias("x"), ys.alias("y")))

    def opened(p: Column) -> Column:
        n = F.size(p)
        return F.when((n > 1) & F.get(p, 0).eqNullSafe(F.get(p, n - 1)), F.slice(p, F.lit(1), n - 1)).otherwise(p)

    ring = A.let(pts, opened)
    return F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])


def clip_segments(segments: DataFrame, polygons: DataFrame, size: float, keep: tuple[str, ...] = ()) -> DataFrame:
    """Pieces (poly, line, seg, t0, t1, len, keep..) of segments (line, seg, x1, y1, x2, y2) inside polygons (poly, xs, ys).

    Cells bring both together; a segment is cut at all edges it crosses, and the pieces whose middle is inside stay.
    ``keep`` names further columns of the segments.
    """
    pairs = S.hash_boxes(S.with_boxes(polygons), size).join(S.hash_segments(segments, size), ["cx", "cy"]).dropDuplicates(["poly", "line", "seg"])
    x1, y1, x2, y2 = (F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2"))
    dx, dy = x2 - x1, y2 - y1

    def crossing(i: Column) -> Column:
        j = (i + 1) % F.size("xs")
        ax, ay = F.get(F.col("xs"), i), F.get(F.col("ys"), i)
        ex, ey = F.get(F.col("xs"), j) - ax, F.get(F.col("ys"), j) - ay
        det = F.nullif(A.cross(dx, dy, ex, ey), F.lit(0.0))
        t, u = A.cross(ax - x1, ay - y1, ex, ey) / det, A.cross(ax - x1, ay - y1, dx, dy) / det
        return F.when(t.between(0, 1) & u.between(0, 1), t)

    cuts = F.transform(F.sequence(F.lit(0), F.size("xs") - 1), crossing)
    cuts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), F.filter(cuts, lambda t: t.isNotNull()))))
    parts = pairs.withColumn("cuts", cuts).withColumn("k", F.explode(F.sequence(F.lit(0), F.size("cuts") - 2)))
    parts = parts.withColumns({"t0": F.get(F.col("cuts"), F.col("k")), "t1": F.get(F.col("cuts"), F.col("k") + 1)})
    mid = (F.col("t0") + F.col("t1")) / 2
    inside = S.inside(x1 + mid * dx, y1 + mid * dy, F.col("xs"), F.col("ys"))
    return parts.filter(inside).select("poly", "line", "seg", "t0", "t1", ((F.col("t1") - F.col("t0")) * F.sqrt(dx * dx + dy * dy)).alias("len"), *keep)


def dilated_cells(polygons: DataFrame, reach: float, size: float) -> DataFrame:
    """Grid cells (cx, cy) whose centre lies in a polygon or within ``reach`` of one: the dissolved buffer on a grid."""
    at = S.hash_boxes(S.with_boxes(polygons), size, reach).withColumns({"px": (F.col("cx") + 0.5) * size, "py": (F.col("cy") + 0.5) * size})

    def gap(i: Column) -> Column:
        j = (i + 1) % F.size("xs")
        ax, ay, bx, by = F.get(F.col("xs"), i), F.get(F.col("ys"), i), F.get(F.col("xs"), j), F.get(F.col("ys"), j)
        ex, ey = bx - ax, by - ay
        t = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), A.dot(F.col("px") - ax, F.col("py") - ay, ex, ey) / F.nullif(A.dot(ex, ey, ex, ey), F.lit(0.0)))), F.lit(0.0))
        return A.distance(F.col("px"), F.col("py"), ax + t * ex, ay + t * ey)

    near = F.array_min(F.transform(F.sequence(F.lit(0), F.size("xs") - 1), gap)) <= reach
    return at.filter(S.inside(F.col("px"), F.col("py"), F.col("xs"), F.col("ys")) | near).select("cx", "cy").distinct()


def sample_rings(polygons: DataFrame, step: float) -> DataFrame:
    """Points (poly, k, x, y) every ``step`` along the closed rings of polygons (poly, xs, ys), from the first corner on.

    The closing point is not repeated; rings without length, empty or null ones have no points. ``poly`` is to be unique.
    """
    at = polygons.filter("size(xs) > 0").select("poly", F.transform("xs", lambda v: v.cast("double")).alias("xs"), F.transform("ys", lambda v: v.cast("double")).alias("ys"))
    nxt = lambda c: F.concat(F.slice(c, F.lit(2), F.size(c)), F.slice(c, 1, 1))
    edge = at.select("poly", F.posexplode(F.arrays_zip("xs", "ys", nxt("xs").alias("nx"), nxt("ys").alias("ny"))).alias("i", "e")).select("poly", "i", F.col("e.xs").alias("x1"), F.col("e.ys").alias("y1"), F.col("e.nx").alias("x2"), F.col("e.ny").alias("y2"))
    ring = W.partitionBy("poly").orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    edge = edge.withColumn("len", A.distance(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))).withColumn("before", F.coalesce(F.sum("len").over(ring), F.lit(0.0)))
    # an edge makes the points from its beginning up to, not including, its end
    edge = edge.withColumns({"a": F.ceil(F.col("before") / step).cast("long"), "b": F.ceil((F.col("before") + F.col("len")) / step).cast("long") - 1}).filter("len > 0 and a <= b")
    k = edge.withColumn("k", F.explode(F.sequence("a", "b"))).withColumn("t", (F.col("k") * step - F.col("before")) / F.col("len"))
    return k.select("poly", "k", (F.col("x1") + F.col("t") * (F.col("x2") - F.col("x1"))).alias("x"), (F.col("y1") + F.col("t") * (F.col("y2") - F.col("y1"))).alias("y"))


def _turn(a, b, c) -> float:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def triangles_of(points: list[tuple[float, float]]) -> list[tuple[int, int, int]]:
    """Triangles of a simple ring by clipping ears; counter-clockwise, as corner numbers."""
    n = len(points)
    ring = list(range(n))
    if sum(points[i - 1][0] * points[i][1] - points[i][0] * points[i - 1][1] for i in range(n)) < 0:
        ring.reverse()
    out = []
    while len(ring) > 3:
        for k in range(len(ring)):
            i, j, m = ring[k - 1], ring[k], ring[(k + 1) % len(ring)]
            a, b, c = points[i], points[j], points[m]
            if _turn(a, b, c) <= 0:
                continue
            if any(q not in (i, j, m) and _turn(a, b, points[q]) >= 0 and _turn(b, c, points[q]) >= 0 and _turn(c, a, points[q]) >= 0 for q in ring):
                continue
            out.append((i, j, m))
            del ring[k]
            break
        else:  # only flat corners are left
            for k in range(len(ring)):
                if _turn(points[ring[k - 1]], points[ring[k]], points[ring[(k + 1) % len(ring)]]) == 0:
                    del ring[k]
                    break
            else:
                return out
    return [*out, tuple(ring)] if len(ring) == 3 else out


def triangulate(polygons: DataFrame) -> DataFrame:
    """Triangles (poly, k, xs, ys) of simple polygons (poly, xs, ys)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for poly, xs, ys in zip(batch["poly"], batch["xs"], batch["ys"], strict=True):
                pts = list(zip(map(float, xs), map(float, ys), strict=True))
                rows += [(poly, k, [pts[i][0] for i in t], [pts[i][1] for i in t]) for k, t in enumerate(triangles_of(pts))]
            yield pd.DataFrame(rows, columns=["poly", "k", "xs", "ys"])

    return polygons.select("poly", "xs", "ys").mapInPandas(run, "poly long, k int, xs array<double>, ys array<double>")


def hulls(points: DataFrame, key: str) -> DataFrame:
    """Convex hulls (key, xs, ys) of points (key, x, y) by group, counter-clockwise from the leftmost point.

    A group is first thinned to its extremes by column of a fixed grid of its width, in a partial aggregate, so that a
    large group does not meet in one task as it is.
    """
    ends = points.groupBy(key).agg(F.min("x").alias("l"), F.max("x").alias("r"))
    slot = F.floor((F.col("x") - F.col("l")) / F.nullif(F.col("r") - F.col("l"), F.lit(0)) * 4096)
    thin = points.join(ends, key).groupBy(key, "x", slot.alias("slot")).agg(F.min("y").alias("lo"), F.max("y").alias("hi"))

    def chain(part: pd.DataFrame) -> pd.DataFrame:
        pts = sorted({*zip(part["x"], part["lo"], strict=True), *zip(part["x"], part["hi"], strict=True)})
        half = []
        for seq in (pts, pts[::-1]):
            h: list = []
            for p in seq:
                while len(h) > 1 and _turn(h[-2], h[-1], p) <= 0:
                    h.pop()
                h.append(p)
            half += h[:-1] if len(pts) > 1 else h
        half = half if len(pts) > 1 else half[:1]
        return pd.DataFrame({key: [part[key].iloc[0]], "xs": [[p[0] for p in half]], "ys": [[p[1] for p in half]]})

    kind = dict(points.dtypes)[key]
    # hulls of parts have the hull of the whole: each slot's rows first, then what is left of a group
    part = thin.select(key, F.col("x").cast("double").alias("x"), F.col("lo").cast("double").alias("lo"), F.col("hi").cast("double").alias("hi"), (F.coalesce("slot", F.lit(0)) / 64).cast("int").alias("strip"))
    first = part.groupBy(key, "strip").applyInPandas(lambda d: chain(d), f"{key} {kind}, xs array<double>, ys array<double>")
    flat = first.select(key, F.explode(F.arrays_zip("xs", "ys")).alias("p")).select(key, F.col("p.xs").alias("x"), F.col("p.ys").alias("lo"), F.col("p.ys").alias("hi"))
    return flat.groupBy(key).applyInPandas(lambda d: chain(d), f"{key} {kind}, xs array<double>, ys array<double>")
