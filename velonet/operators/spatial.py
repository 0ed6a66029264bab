"""Spatial operators: every join is an equality join on grid cells that an exact test refines.

Geometry comes as rows: points (id, x, y), segments (line, seg, x1, y1, x2, y2) in metres, and polygons as arrays of
corner coordinates (poly, xs, ys). Nothing is broadcast by hand; Spark picks the join from the sizes it sees.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StructType

from velonet.functions import arrays as A
from velonet.operators.network import settle


def cell_of(v: Column, size: float, low: float = 0.0, n: int | None = None) -> Column:
    """Number of the grid interval that holds a coordinate; with ``n`` clamped into 0..n-1."""
    c = F.floor((v - low) / size).cast("long")
    return c if n is None else F.greatest(F.lit(0), F.least(F.lit(n - 1), c)).cast("long")


def hash_points(points: DataFrame, size: float) -> DataFrame:
    return points.withColumns({"cx": cell_of(F.col("x"), size), "cy": cell_of(F.col("y"), size)})


def hash_boxes(boxes: DataFrame, size: float, grow: float = 0.0) -> DataFrame:
    """One row for each cell that a box (l, r, b, t), grown by ``grow``, touches."""
    span = lambda lo, hi: F.explode(F.sequence(cell_of(F.col(lo) - grow, size), cell_of(F.col(hi) + grow, size)))
    return boxes.withColumn("cx", span("l", "r")).withColumn("cy", span("b", "t"))


def hash_segments(segments: DataFrame, size: float, grow: float = 0.0) -> DataFrame:
    """One row for each cell a segment crosses, or comes within ``grow`` of in either axis.

    For every column of cells the range of rows is computed from the part of the segment inside the column, so long
    diagonal segments do not cover the whole of their bounding box.
    """
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    cols = segments.withColumn("cx", F.explode(F.sequence(cell_of(F.least(x1, x2) - grow, size), cell_of(F.greatest(x1, x2) + grow, size))))
    left, right = F.col("cx") * size - grow, (F.col("cx") + 1) * size + grow
    at = lambda x: y1 + (F.greatest(F.least(x, F.greatest(x1, x2)), F.least(x1, x2)) - x1) * (y2 - y1) / F.nullif(x2 - x1, F.lit(0))
    a, b = F.coalesce(at(left), y1), F.coalesce(at(right), y2)
    rows = F.sequence(cell_of(F.least(a, b) - grow, size), cell_of(F.greatest(a, b) + grow, size))
    return cols.withColumn("cy", F.explode(rows))


def segments_of(vertices: DataFrame, line: str = "line", order: str = "seq") -> DataFrame:
    """Vertices (line, seq, x, y) -> segments with their length; a line's rows are sorted within the line only."""
    w = W.partitionBy(line).orderBy(order)
    out = vertices.select(line, F.col(order).alias("seg"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2"))
    return out.filter("x2 is not null").withColumn("len", A.distance(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")))


def along(segments: DataFrame, line: str = "line") -> DataFrame:
    """With ``before``: metres of the line ahead of each segment."""
    w = W.partitionBy(line).orderBy("seg").rowsBetween(W.unboundedPreceding, -1)
    return segments.withColumn("before", F.coalesce(F.sum("len").over(w), F.lit(0.0)))


def foot(px: Column, py: Column) -> tuple[Column, Column, Column, Column]:
    """Of a point on the segment of the row: share along it, nearest x and y, distance."""
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    dx, dy = x2 - x1, y2 - y1
    t = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x1) * dx + (py - y1) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0)))), F.lit(0.0))
    fx, fy = x1 + t * dx, y1 + t * dy
    return t, fx, fy, A.distance(px, py, fx, fy)


def with_foot(df: DataFrame) -> DataFrame:
    """With share, fx, fy and dist of foot() for the point x, y, one projection for each step, so that none is repeated."""
    c = lambda n: F.col(n).cast("double")
    out = df.withColumns({"_dx": c("x2") - c("x1"), "_dy": c("y2") - c("y1"), "_px": c("x") - c("x1"), "_py": c("y") - c("y1")})
    out = out.withColumn("share", (F.col("_px") * F.col("_dx") + F.col("_py") * F.col("_dy")) / F.nullif(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy"), F.lit(0.0)))
    out = out.withColumn("share", F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("share"))), F.lit(0.0)))
    out = out.withColumns({"fx": c("x1") + F.col("share") * F.col("_dx"), "fy": c("y1") + F.col("share") * F.col("_dy")})
    return out.withColumn("dist", A.distance(F.col("x"), F.col("y"), F.col("fx"), F.col("fy"))).drop("_dx", "_dy", "_px", "_py")


def box_query(boxes: DataFrame, points: DataFrame, size: float) -> DataFrame:
    """Points (id, x, y) in the cells of each box (box, l, r, b, t): a superset of those inside, as the index gives it."""
    return hash_boxes(boxes, size).join(hash_points(points, size), ["cx", "cy"]).select("box", "id").distinct()


def inside(px: Column, py: Column, xs: Column, ys: Column) -> Column:
    """Even-odd test of a point in a polygon given by its corners."""
    n = F.size(xs)

    def crosses(acc: Column, i: Column) -> Column:
        j = (i + 1) % n
        xi, yi, xj, yj = F.get(xs, i), F.get(ys, i), F.get(xs, j), F.get(ys, j)
        hit = ((yi > py) != (yj > py)) & (px < (xj - xi) * (py - yi) / F.nullif(yj - yi, F.lit(0)) + xi)
        return acc + F.when(hit, 1).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), crosses) % 2 == 1


def with_boxes(polygons: DataFrame) -> DataFrame:
    return polygons.withColumns({"l": F.array_min("xs"), "r": F.array_max("xs"), "b": F.array_min("ys"), "t": F.array_max("ys")})


def points_in_polygons(points: DataFrame, polygons: DataFrame, size: float, *keys: str) -> DataFrame:
    """Pairs (keys, poly, id) of points (id, x, y) inside polygons (poly, xs, ys) that agree in the columns ``keys``, if any."""
    covered = hash_boxes(with_boxes(polygons), size)
    met = covered.join(hash_points(points, size), [*keys, "cx", "cy"])
    # comparisons with the box come first: the test of the corners is slow
    boxed = F.col("x").between(F.col("l"), F.col("r")) & F.col("y").between(F.col("b"), F.col("t"))
    return met.filter(boxed & inside(F.col("x"), F.col("y"), F.col("xs"), F.col("ys"))).select(*keys, "poly", "id")


def covered_cells(polygons: DataFrame, size: float) -> tuple[DataFrame, DataFrame]:
    """Cells that lie whole in polygons (poly, xs, ys), as (poly, cx, cy), and those that an edge touches, with xs and ys.

    ``poly`` is unique. Row by row of cells: what lies between the crossings of the row's middle is inside, but for the cells
    of the edges; so the corners are looked at once a row, not once a cell or point.
    """
    rings = polygons.filter("size(xs) > 2").select("poly", "xs", "ys")
    n, at = F.size("xs"), F.posexplode(F.arrays_zip(F.col("xs").cast("array<double>").alias("x"), F.col("ys").cast("array<double>").alias("y")))
    corner = dealt_out(rings, "poly").select("poly", n.alias("n"), F.col("xs"), F.col("ys"), at.alias("i", "p"))
    nxt = lambda c: F.get(F.col(c), (F.col("i") + 1) % F.col("n")).cast("double")
    sides = corner.select("poly", F.col("p.x").alias("x1"), F.col("p.y").alias("y1"), nxt("xs").alias("x2"), nxt("ys").alias("y2"))
    rows = hash_segments(sides, size, 1e-6).groupBy("poly", "cy").agg(F.collect_set("cx").alias("touched")).join(rings, "poly")
    mid = (F.col("cy") + 0.5) * size

    def crossing(i: Column) -> Column:
        j = (i + 1) % n
        xi, yi, xj, yj = (F.get(F.col(c), k).cast("double") for k in (i, j) for c in ("xs", "ys"))
        return F.when((yi > mid) != (yj > mid), (xj - xi) * (mid - yi) / (yj - yi) + xi)

    rows = rows.withColumn("met", F.array_sort(F.filter(F.transform(F.sequence(F.lit(0), n - 1), crossing), lambda v: v.isNotNull())))
    # cells whose middle lies between the first and the second crossing, the third and the fourth and so on
    first, last = (lambda v: F.ceil(v / size - 0.5).cast("long")), (lambda v: F.ceil(v / size - 0.5).cast("long") - 1)
    none = F.array().cast("array<bigint>")
    span = lambda k: A.let(F.struct(first(F.get("met", 2 * k)).alias("a"), last(F.get("met", 2 * k + 1)).alias("b")), lambda s: F.when(s["a"] <= s["b"], F.sequence(s["a"], s["b"])).otherwise(none))
    between = F.when(F.size("met") > 1, F.flatten(F.transform(F.sequence(F.lit(0), F.floor(F.size("met") / 2).cast("int") - 1), span))).otherwise(none)
    rows = settle(rows.select("poly", "cy", "touched", F.array_except(between, "touched").alias("whole"), "xs", "ys"))
    return rows.select("poly", F.explode("whole").alias("cx"), "cy"), rows.select("poly", F.explode("touched").alias("cx"), "cy", "xs", "ys")


#: Of a cell's size, that of the cells which polygons cover as a whole.
FINE = 1 / 8


def covered_by(polygons: DataFrame, size: float, *keys: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """covered_cells of polygons (keys, poly, xs, ys) with the ``keys``, and the covered cells (keys, cx, cy, first): the smallest around each."""
    whole, touched = covered_cells(polygons.select(F.struct(*keys, "poly").alias("poly"), "xs", "ys"), size)
    names = [F.col(f"poly.{k}").alias(k) for k in (*keys, "poly")]
    whole, touched = whole.select(*names, "cx", "cy"), touched.select(*names, "cx", "cy", "xs", "ys")
    return whole, touched, settle(whole.groupBy(*keys, "cx", "cy").agg(F.min("poly").alias("first")))


def sums_in_polygons(points: DataFrame, polygons: DataFrame, size: float, weight: str) -> DataFrame:
    """Rows (poly, n, weight): how many points (id, x, y, weight) lie in each polygon that has any, and the sum of their weights.

    Cells inside a polygon add their own sums; points are tested in the cells of its edges only.
    """
    whole, touched = covered_cells(polygons, size * FINE)
    at = hash_points(points.select("x", "y", F.col(weight).alias("weight")), size * FINE)
    sums = [F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight")]
    inner = whole.join(at.groupBy("cx", "cy").agg(*sums), ["cx", "cy"]).select("poly", "n", "weight")
    outer = touched.join(at, ["cx", "cy"]).filter(inside(F.col("x"), F.col("y"), F.col("xs"), F.col("ys"))).groupBy("poly").agg(*sums)
    return inner.union(outer).groupBy("poly").agg(F.sum("n").alias("n"), F.sum("weight").alias("weight"))


def polygon_of_points(points: DataFrame, polygons: DataFrame, size: float) -> DataFrame:
    """For each point inside any polygon the one with the smallest number.

    The smallest polygon around a whole cell bounds the search: of those whose edges touch it only smaller ones are tested.
    """
    whole, touched = covered_cells(polygons, size * FINE)
    first = whole.groupBy("cx", "cy").agg(F.min("poly").alias("first"))
    at = settle(hash_points(points.select("id", "x", "y"), size * FINE).join(first, ["cx", "cy"], "left"))
    hits = touched.join(at, ["cx", "cy"]).filter((F.col("first").isNull() | (F.col("poly") < F.col("first"))) & inside(F.col("x"), F.col("y"), F.col("xs"), F.col("ys")))
    return hits.select("id", "poly").union(at.filter("first is not null").select("id", "first")).groupBy("id").agg(F.min("poly").alias("poly"))


def dealt_out(df: DataFrame, key: str = "line") -> DataFrame:
    """In all tasks, by key: adaptive execution leaves small tables in few, which would then make all their cells."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def cells_asked_for(cells: DataFrame, asked: DataFrame) -> DataFrame:
    """Of the rows of ``cells`` (cx, cy, ..) those in a cell of ``asked``, dealt out by cell.

    Only these go on to the exchange, which also keeps the generated code of both sides small enough to be compiled.
    """
    some = cells.join(asked.select("cx", "cy").distinct(), ["cx", "cy"], "left_semi")
    return some.repartition(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), "cx", "cy")


@contextmanager
def colocated(spark) -> Iterator[None]:
    """Joins on more keys than both sides were dealt out by are made where the rows are, for what is executed meanwhile."""
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    was = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, was)


#: Points that a block of the search has, if they are spread evenly, and the intervals of direction in which lines are counted.
BLOCK_POINTS, DIRECTIONS = 110_000, 1024
#: Segments of alike directions that are compared with the points at once at least, the widest such interval, and pairs held at once.
ALIKE, WIDEST, PAIRS = 2000, 0.4, 2_000_000


def met_pairs(px: np.ndarray, py: np.ndarray, ends: tuple[np.ndarray, ...], radius: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row of the point, row of the segment) of all points within ``radius`` of segments (x1, y1, x2, y2), and few more.

    Segments of alike directions are laid flat with the points: in columns across them, points sorted by height are those
    between two places of a sorted array, where the segment is.
    """
    x1, y1, x2, y2 = ends
    angle = np.arctan2(y2 - y1, x2 - x1) % np.pi
    order = np.argsort(angle, kind="stable")
    angle, many, start = angle[order], max(ALIKE, len(order) // 64), 0
    while start < len(order):
        end = min(start + many, int(np.searchsorted(angle, angle[start] + WIDEST, "right")))
        some, span, mean = order[start:end], angle[end - 1] - angle[start], (angle[start] + angle[end - 1]) / 2
        start = end
        c, s = np.cos(mean), np.sin(mean)
        u, v = px * c + py * s, py * c - px * s
        left, low = u.min(), v.min()
        height, wide = v.max() - low, max(u.max() - left, 1e-3)
        columns = int(min(1000, max(1, np.sqrt(0.15 * len(u) * span))))
        width, step = wide / columns, height + 2
        key = np.minimum(((u - left) / width).astype(np.int64), columns - 1) * step + (v - low)
        sort = np.argsort(key)
        key = key[sort]
        ua, va, ub, vb = x1[some] * c + y1[some] * s - left, y1[some] * c - x1[some] * s - low, x2[some] * c + y2[some] * s - left, y2[some] * c - x2[some] * s - low
        turn = ua > ub
        ua, va, ub, vb = np.where(turn, ub, ua), np.where(turn, vb, va), np.where(turn, ua, ub), np.where(turn, va, vb)
        slope = (vb - va) / np.where(ub > ua, ub - ua, 1)
        first, last = np.maximum(np.floor((ua - radius) / width), 0), np.minimum(np.floor((ub + radius) / width), columns - 1)
        n = np.where((ua - radius > wide) | (ub + radius < 0), 0, np.maximum(last - first + 1, 0)).astype(np.int64)
        at = np.repeat(np.arange(len(some)), n)
        if not len(at):
            continue
        column = np.repeat(first.astype(np.int64), n) + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        ua, va, ub, slope = ua[at], va[at], ub[at], slope[at]
        h1 = va + (np.clip(column * width - radius, ua, ub) - ua) * slope
        h2 = va + (np.clip((column + 1) * width + radius, ua, ub) - ua) * slope
        base = column * step
        lo = np.searchsorted(key, base + np.clip(np.minimum(h1, h2) - radius, -0.5, height + 0.5), "left")
        n = np.searchsorted(key, base + np.clip(np.maximum(h1, h2) + radius, -0.5, height + 0.5), "right") - lo
        at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
        total, k = np.cumsum(n), 0
        while k < len(n):
            until = max(k + 1, int(np.searchsorted(total, (total[k - 1] if k else 0) + PAIRS, "right")))
            m = n[k:until]
            yield sort[np.repeat(lo[k:until] - np.cumsum(m) + m, m) + np.arange(m.sum())], some[np.repeat(at[k:until], m)]
            k = until


def _to_segment(p: dict[str, np.ndarray], s: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
    """Distances from points to segments, row by row; all count, and for sure."""
    dx, dy, x, y = s["x2"] - s["x1"], s["y2"] - s["y1"], p["x"] - s["x1"], p["y"] - s["y1"]
    n = dx * dx + dy * dy
    t = np.clip((x * dx + y * dy) / np.where(n > 0, n, 1), 0, 1)
    return np.hypot(x - t * dx, y - t * dy), np.ones(len(dx), bool), np.ones(len(dx), bool)


#: For distances that tasks and Spark's columns may round differently.
HAIR = 1e-6


def _least(best: np.ndarray, p: np.ndarray, d: np.ndarray) -> None:
    """Set the rows ``p`` of ``best``, the smallest distances of each point in order, to what they are with ``d`` as well."""
    order = np.lexsort((d, p))
    p, d = p[order], d[order]
    begins = np.flatnonzero(np.r_[True, p[1:] != p[:-1]][: len(p)])
    rank = np.arange(len(p)) - np.repeat(begins, np.diff(np.r_[begins, len(p)]))
    few = rank < best.shape[1]
    more = np.full((len(begins), best.shape[1]), np.inf)
    more[np.repeat(np.arange(len(begins)), np.diff(np.r_[begins, len(p)]))[few], rank[few]] = d[few]
    best[p[begins]] = np.sort(np.hstack([best[p[begins]], more]), axis=1)[:, : best.shape[1]]


def directions(segments: DataFrame) -> tuple[float, list[int]]:
    """The length of all ``segments``, and how many run in each of the intervals of direction."""
    length = A.distance(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    rows = segments.filter("x1 is not null and y1 is not null and x2 is not null and y2 is not null").groupBy(_direction().alias("d")).agg(F.count(F.lit(1)), F.sum(length)).collect()
    count = [0] * DIRECTIONS
    for d, n, _ in rows:
        count[d] = n
    return sum(x[2] for x in rows), count


def _direction() -> Column:
    c = lambda n: F.col(n).cast("double")
    return F.least(F.lit(DIRECTIONS - 1), F.floor(F.pmod(F.atan2(c("y2") - c("y1"), c("x2") - c("x1")), F.lit(math.pi)) * (DIRECTIONS / math.pi))).cast("int")


def passing(points: DataFrame, segments: DataFrame, radius: float, cell: float, n: int, box: tuple[float, float, float, float], counts: list[int] | None = None, many: int = 1, far=_to_segment) -> DataFrame:
    """Pairs of points (id, x, y, ..) and segments (line, seg, x1 .. y2, ..): the ``many`` nearest to each point within ``radius``, and few more.

    Both go to blocks, segments to one of a block's shares, which have some of the directions each, and points to all. ``n``
    points lie in ``box`` (l, r, b, t), whose blocks are no smaller than ``cell``; ``counts`` has the segments by direction. ``far`` gives the distances of pairs in
    arrays, which pairs may count but for rounding, and which do for sure; the nearest of a share go on, for the caller to compare.
    """
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    l, r, b, t = box
    across = max(1, min(math.ceil(math.sqrt(n / BLOCK_POINTS)), 1000, math.floor(max(r - l, t - b) / cell)))
    shares = min(max(1, math.ceil(2 * parts / across**2)), DIRECTIONS)
    over, up = max(r - l, HAIR) / across, max(t - b, HAIR) / across
    # of directions with many segments, several shares have a part each
    counts = directions(segments)[1] if counts is None else counts
    total, until, first, several = max(sum(counts), 1), 0, [], []
    for c in counts:
        first.append(min(until * shares // total, shares - 1))
        until += c
        several.append(max(1, math.ceil(until * shares / total) - first[-1]))
    block = lambda i, j, k: ((i * across + j) * shares + k).cast("int").alias("block")
    number = lambda v, low, size: F.floor((v - low) / size).cast("long")
    within = lambda v: F.greatest(F.lit(0), F.least(F.lit(across - 1), v))
    p = points.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    p = p.select(*points.columns, block(within(number(F.col("x"), l, over)), within(number(F.col("y"), b, up)), F.col("_k"))).repartition(2 * parts, "block")

    # the code of each step is kept small, or the JVM leaves it uncompiled: one projection a step, no nulls, segments that run
    # from left to right along y = _y + _m * (x - _l) with _up more at the top, where one that goes straight up has its length
    ends = ("x1", "y1", "x2", "y2")
    s = segments.filter("x1 is not null and y1 is not null and x2 is not null and y2 is not null")
    x1, y1, x2, y2 = (F.col(c).cast("double") for c in ends)
    more = radius + HAIR  # a hair more, as slopes are rounded

    def spread(s: DataFrame, name: str, lo: Column, hi: Column) -> DataFrame:
        s = s.withColumns({"_lo": F.greatest(F.lit(0), lo), "_hi": F.least(F.lit(across - 1), hi)})
        return s.withColumn(name, F.explode(F.when(F.col("_lo") <= F.col("_hi"), F.sequence("_lo", "_hi")))).drop("_lo", "_hi")

    at = lambda v: F.col("_y") + (F.greatest(F.least(v, F.col("_r")), F.col("_l")) - F.col("_l")) * F.col("_m")
    s = s.withColumns({"_l": F.least(x1, x2), "_r": F.greatest(x1, x2), "_m": F.coalesce((y2 - y1) / F.nullif(x2 - x1, F.lit(0.0)), F.lit(0.0))})
    s = s.withColumns({"_y": F.when(x1 < x2, y1).when(x1 > x2, y2).otherwise(F.least(y1, y2)), "_up": F.when(x1 == x2, F.abs(y2 - y1)).otherwise(F.lit(0.0)) + more})
    s = spread(s, "_i", number(F.col("_l") - more, l, over), number(F.col("_r") + more, l, over))
    s = s.withColumns({"_a": at(F.col("_i") * over + (l - more)), "_b": at(F.col("_i") * over + (l + over + more))})
    s = s.withColumns({"_a": F.least("_a", "_b") - more, "_b": F.greatest("_a", "_b") + F.col("_up")})
    s = spread(s, "_j", number(F.col("_a"), b, up), number(F.col("_b"), b, up)).withColumn("_d", _direction())
    share = F.get(F.lit(first), F.col("_d")) + F.pmod(F.xxhash64("line", "seg"), F.get(F.lit(several), F.col("_d")))
    s = s.select(*segments.columns, block(F.col("_i"), F.col("_j"), share)).repartition(2 * parts, "block")
    schema = StructType([*points.schema, *segments.schema])
    kinds = [f.name for f in schema if isinstance(f.dataType, NumericType)]

    def nearest(points: pa.Table, segments: pa.Table) -> pa.Table:
        points, segments = points.drop_columns("block"), segments.drop_columns("block")
        arrays = lambda t: {n: t.column(n).to_numpy().astype(float) for n in kinds if n in t.column_names}
        kept, best = [], np.full((len(points), many), more)
        if len(points) and len(segments):
            p, s = arrays(points), arrays(segments)
            for i, j in met_pairs(p["x"], p["y"], tuple(s[c] for c in ends), more):
                d, may, sure = far({n: a[i] for n, a in p.items()}, {n: s[n][j] for n in ends})
                some = np.flatnonzero(may & (d <= best[i, -1] + HAIR))
                if len(some):
                    i, j, d, sure = i[some], j[some], d[some], sure[some]
                    _least(best, i[sure], d[sure])
                    kept.append((i, j, d))
        i, j, d = (np.concatenate(c) for c in zip(*kept, strict=True)) if kept else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        some = d <= best[i, -1] + HAIR
        points, segments = points.take(pa.array(i[some])), segments.take(pa.array(j[some]))
        return pa.Table.from_arrays([*points.columns, *segments.columns], [*points.column_names, *segments.column_names])

    return p.groupBy("block").cogroup(s.groupBy("block")).applyInArrow(nearest, schema)


def _extent(points: DataFrame) -> tuple[int, tuple[float, ...]]:
    """How many ``points`` there are, and their box (l, r, b, t)."""
    n, *box = points.agg(F.count(F.lit(1)), *[f(F.col(c).cast("double")) for c in "xy" for f in (F.min, F.max)]).first()
    return n, tuple(box)


def nearest_line(points: DataFrame, segments: DataFrame, reach: float, size: float, first: float | None = None, settled: bool = False) -> DataFrame:
    """Rows (id, line, seg, share, fx, fy, dist): the nearest segment to each point (id, x, y) within ``reach``.

    Ties go to the smaller (line, seg). A ladder of radii: points solved within a small radius leave before the next, wider
    one. The first rung follows the density of the lines, so dense places never see the candidates of the widest search. The
    rungs end with the points. ``settled``: the segments are columns of a table, which needs not be made again.
    """
    left, out = settle(points.select("id", "x", "y").filter("x is not null and y is not null")), None
    segments = segments.select("line", "seg", "x1", "y1", "x2", "y2")
    segments = segments if settled else settle(segments)
    total, counts = directions(segments)
    start, radius = first or min(reach, size), None
    while True:
        n, box = _extent(left)
        if not n:
            return left.select("id").join(segments.limit(0), F.lit(True)).select("id", "line", "seg", *[F.lit(None).cast("double").alias(c) for c in ("share", "fx", "fy", "dist")]) if out is None else out
        if radius is None:
            # all but a few points have a line within some times the mean distance
            area = max(box[1] - box[0], size) * max(box[3] - box[2], size)
            radius = min(reach, start, max(size / 100_000, 10 * area / total if total else start))
        else:
            radius = min(reach, radius * 16 if radius < start else radius * 4)
        # the radius is tested on the nearest only: a filter ahead would be moved into the join and repeat all steps
        found = with_foot(passing(left, segments, radius, 4 * radius, n, box, counts))
        best = found.groupBy("id").agg(F.min(F.struct("dist", "line", "seg", "share", "fx", "fy")).alias("m")).select("id", "m.line", "m.seg", "m.share", "m.fx", "m.fy", "m.dist").filter(F.col("dist") < radius)
        best = settle(best)
        out = best if out is None else out.union(best)
        if radius >= reach:
            return out
        left = settle(left.join(best.select("id"), "id", "left_anti"))


def nearest_point(points: DataFrame, others: DataFrame, reach: float) -> DataFrame:
    """Rows (id, other, dist): the nearest of ``others`` (other, x, y) within ``reach``; ties go to the smaller number."""
    near = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    asked = hash_points(points.select("id", "x", "y"), reach).withColumn("n", near).withColumns({"cx": F.col("cx") + F.col("n.i"), "cy": F.col("cy") + F.col("n.j")})
    there = hash_points(others.select("other", F.col("x"), F.col("y")), reach).withColumnsRenamed({"x": "ox", "y": "oy"})
    d = A.distance(F.col("x"), F.col("y"), F.col("ox"), F.col("oy"))
    found = asked.join(there, ["cx", "cy"]).withColumn("dist", d).filter(F.col("dist") < reach)
    return found.groupBy("id").agg(F.min(F.struct("dist", "other")).alias("m")).select("id", "m.other", "m.dist")


def pairs_within(points: DataFrame, reach: float) -> DataFrame:
    """Pairs (a, b), a < b, of points (id, x, y) closer than ``reach``."""
    left = hash_points(points, reach).withColumnsRenamed({"id": "a", "x": "ax", "y": "ay"})
    near = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    left = left.withColumn("n", near).withColumns({"cx": F.col("cx") + F.col("n.i"), "cy": F.col("cy") + F.col("n.j")}).drop("n")
    right = hash_points(points, reach).withColumnsRenamed({"id": "b", "x": "bx", "y": "by"})
    d = A.distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    return left.join(right, ["cx", "cy"]).filter((F.col("a") < F.col("b")) & (d < reach)).select("a", "b", d.alias("dist"))


def sample_lines(segments: DataFrame, step: float, line: str = "line", centred: bool = False) -> DataFrame:
    """Rows (line, k, pos, x, y, gap) at equal steps along each line.

    Plain: ceil(length / step) equal gaps with both ends included. Centred: gaps of exactly ``step``, the remainder shared
    by both ends.
    """
    parts = along(segments, line)
    whole = W.partitionBy(line)
    parts = parts.withColumns({"total": F.sum("len").over(whole), "last": F.max("seg").over(whole)})
    if centred:
        n = F.floor(F.col("total") / step).cast("long")
        start, gap = F.pmod(F.col("total"), F.lit(float(step))) / 2, F.lit(float(step))
    else:
        n = F.greatest(F.ceil(F.col("total") / step).cast("long"), F.lit(1))
        start, gap = F.lit(0.0), F.col("total") / n
    parts = parts.withColumns({"n": n, "start": start, "gap": gap})
    # each segment makes the samples that fall on it: from its beginning up to, not including, its end; the last has its end
    ks = F.filter(
        F.sequence(F.greatest(F.ceil((F.col("before") - F.col("start")) / F.col("gap") - 1e-9).cast("long"), F.lit(0)), F.least(F.floor((F.col("before") + F.col("len") - F.col("start")) / F.col("gap") + 1e-9).cast("long") + 1, F.col("n"))),
        lambda k: (k * F.col("gap") + F.col("start") >= F.col("before") - 1e-9)
        & ((k * F.col("gap") + F.col("start") < F.col("before") + F.col("len") - 1e-9) | ((F.col("seg") == F.col("last")) & (k * F.col("gap") + F.col("start") <= F.col("before") + F.col("len") + 1e-6))),
    )
    ok = F.greatest(F.ceil((F.col("before") - F.col("start")) / F.col("gap") - 1e-9).cast("long"), F.lit(0)) <= F.least(F.floor((F.col("before") + F.col("len") - F.col("start")) / F.col("gap") + 1e-9).cast("long") + 1, F.col("n"))
    rows = parts.filter((F.col("total") > 0) & ok).withColumn("k", F.explode(ks))
    pos = F.col("k") * F.col("gap") + F.col("start")
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce((pos - F.col("before")) / F.nullif(F.col("len"), F.lit(0.0)), F.lit(0.0))))
    return rows.select(line, "k", pos.alias("pos"), (F.col("x1") + t * (F.col("x2") - F.col("x1"))).alias("x"), (F.col("y1") + t * (F.col("y2") - F.col("y1"))).alias("y"), "gap")


def hex_grid(spark, left: float, right: float, low: float, high: float, radius: float) -> DataFrame:
    """Pointy-top hexagons over a box: rows (cell, col, row, half, cx, cy). Two interleaved lattices of centres."""
    xs, ys = radius * 3**0.5, 3 * radius
    nx, ny = int((right - left) // xs) + 2, int((high - low) // ys) + 2
    grid = spark.range(nx * ny * 2).select(F.col("id").alias("cell"), (F.floor(F.col("id") / 2) % nx).alias("col"), F.floor(F.col("id") / (2 * nx)).alias("row"), (F.col("id") % 2).alias("half"))
    return grid.withColumns({"cx": left + (F.col("col") + F.col("half") / 2) * xs, "cy": low + (F.col("row") + F.col("half") / 2) * ys})


def hex_cell(x: Column, y: Column, left: float, low: float, radius: float) -> tuple[Column, Column, Column]:
    """(col, row, half) of the hexagon that holds a point: the nearer of the nearest centres of both lattices."""
    xs, ys = radius * 3**0.5, 3 * radius
    u, v = (x - left) / xs, (y - low) / ys
    c0, r0 = F.floor(u + 0.5), F.floor(v + 0.5)
    c1, r1 = F.floor(u), F.floor(v)
    d0 = F.pow((u - c0) * xs, 2) + F.pow((v - r0) * ys, 2)
    d1 = F.pow((u - c1 - 0.5) * xs, 2) + F.pow((v - r1 - 0.5) * ys, 2)
    odd = d1 < d0
    return F.when(odd, c1).otherwise(c0), F.when(odd, r1).otherwise(r0), F.when(odd, 1).otherwise(0)


def hex_population(points: DataFrame, weight: str, left: float, low: float, radius: float) -> DataFrame:
    """Sum of weights by hexagon."""
    c, r, h = hex_cell(F.col("x"), F.col("y"), left, low, radius)
    return points.groupBy(c.cast("long").alias("col"), r.cast("long").alias("row"), h.cast("long").alias("half")).agg(F.sum(weight).alias("pop"))


def cubic_weight(d: Column, k: Column) -> Column:
    """Weight of the cell k = -1, 0, 1 or 2 places on, at a share d of the way to the next one: cubic convolution."""
    return (
        F.when(k == -1, ((-0.5 * d + 1.0) * d - 0.5) * d)
        .when(k == 0, (1.5 * d - 2.5) * d * d + 1.0)
        .when(k == 1, ((-1.5 * d + 2.0) * d + 0.5) * d)
        .otherwise((0.5 * d - 0.5) * d * d)
    )


def spline_weight(d: Column, k: Column) -> Column:
    """The same for a cubic spline, whose cells are coefficients."""
    return (
        F.when(k == -1, (1 - d) * (1 - d) * (1 - d) / 6)
        .when(k == 0, ((3 * d - 6) * d * d + 4) / 6)
        .when(k == 1, (((-3 * d + 3) * d + 3) * d + 1) / 6)
        .otherwise(d * d * d / 6)
    )


#: Cells on each side that a spline coefficient sums up. What is left out weighs 1e-11 of the heights.
SPLINE_REACH = 20


def spline_coefficients(cells: DataFrame) -> DataFrame:
    """Coefficients (col, row, h) of the cubic spline that passes through the cells (col, row, h) of a full raster.

    The raster goes on mirrored at its border. A coefficient is the sum of its neighbours by powers of sqrt(3) - 2, along the
    rows and then along the columns; SPLINE_REACH of them hold it to rounding, so a row or column may be cut into pieces
    with a halo as wide. Voids (-500 and less) leave no coefficients within that reach. A raster of one row or column is as it is
    along the other axis.
    """
    out = cells.select("col", "row", F.when(F.col("h") > -500, F.col("h").cast("double")).alias("h"))
    for axis, other in (("col", "row"), ("row", "col")):
        line = W.partitionBy(other)
        at = out.withColumns({"lo": F.min(axis).over(line), "hi": F.max(axis).over(line)}).withColumn("period", 2 * (F.col("hi") - F.col("lo")))
        turns = F.when(F.col("period") > 0, F.ceil(SPLINE_REACH / F.greatest(F.col("period"), F.lit(1))) + 1).otherwise(0).cast("long")
        from_lo = F.col(axis) - F.col("lo")
        places = F.flatten(F.transform(F.sequence(-turns, turns), lambda m: F.array(F.col("lo") + from_lo + m * F.col("period"), F.col("lo") - from_lo + m * F.col("period"))))
        near = F.filter(F.array_distinct(places), lambda p: p.between(F.col("lo") - SPLINE_REACH, F.col("hi") + SPLINE_REACH))
        at = at.withColumn("place", F.explode(near))
        w = line.orderBy("place")
        pole, total = 3**0.5 - 2, F.col("h")
        for k in range(1, SPLINE_REACH + 1):
            total = total + (F.lag("h", k).over(w) + F.lead("h", k).over(w)) * pole**k
        at = at.withColumn("sum", 3**0.5 * total).filter(F.col("place") == F.col(axis))
        out = at.select("col", "row", F.when(F.col("period") > 0, F.col("sum")).otherwise(F.col("h")).alias("h"))
    return out


def raster_sample(points: DataFrame, cells: DataFrame, left: float, top: float, size: float, unknown: bool = False, spline: bool = False) -> DataFrame:
    """Heights (id, h) of points by bicubic interpolation of raster cells (col, row, h); none at the border or near voids.

    The sixteen cells around a point decide, by cubic convolution or, with ``spline``, by the spline through all cells; so
    tiles of any number are joined by cell. With ``unknown`` the points without a height stay, with null.
    """
    cells, weight = (spline_coefficients(cells), spline_weight) if spline else (cells.withColumn("h", F.when(F.col("h") > -500, F.col("h"))), cubic_weight)
    u, v = (F.col("x") - left) / size - 0.5, (top - F.col("y")) / size - 0.5
    at = points.withColumns({"c0": F.floor(u).cast("long"), "r0": F.floor(v).cast("long"), "du": u - F.floor(u), "dv": v - F.floor(v)})
    corner = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1, 2) for j in (-1, 0, 1, 2)]))
    asked = at.withColumn("k", corner).withColumns({"col": F.col("c0") + F.col("k.i"), "row": F.col("r0") + F.col("k.j")})
    got = asked.join(cells, ["col", "row"], "left" if unknown else "inner")
    got = got.withColumn("part", weight(F.col("du"), F.col("k.i")) * weight(F.col("dv"), F.col("k.j")) * F.col("h"))
    out = got.groupBy("id").agg(F.sum("part").alias("h"), F.count("h").alias("n")).select("id", F.when(F.col("n") == 16, F.col("h")).alias("h"))
    return out if unknown else out.filter("h is not null")


def slopes(heights: DataFrame, table: list[float]) -> DataFrame:
    """Codes of the flattest, steepest and mean slope of lines, and the mean slowdown either way.

    ``heights`` has (line, k, gap, h, passage): samples in order of k, ``gap`` metres apart. Bridges and tunnels are
    level. A line with an unknown slope has the code -127; such a step counts as level in the slowdown. A line of one
    sample has no row.
    """
    rise = F.when(F.col("passage"), 0.0).otherwise(F.lead("h").over(W.partitionBy("line").orderBy("k")) - F.col("h"))
    last = F.lead("k").over(W.partitionBy("line").orderBy("k")).isNull()
    steps = heights.withColumns({"rise": rise, "last": last}).filter("not last").withColumn("grade", F.abs("rise") / F.col("gap"))
    known = F.coalesce(F.col("rise"), F.lit(0.0))
    steps = steps.withColumns({"fwd": A.slope_penalty(known, F.col("gap"), table), "bwd": A.slope_penalty(-known, F.col("gap"), table)})
    whole = F.count("grade") == F.count(F.lit(1))
    code = lambda v: A.slope_percent(F.when(whole, v), F.lit(1.0))
    return steps.groupBy("line").agg(code(F.min("grade")).alias("abs_slope_min"), code(F.max("grade")).alias("abs_slope_max"), code(F.avg("grade")).alias("abs_slope_avg"), F.avg("fwd").alias("fwd_climb"), F.avg("bwd").alias("bwd_climb"))


def heat(points: DataFrame, weight: str, sigma: float, cell: float) -> DataFrame:
    """Gaussian heat by grid cell (cx, cy, heat), cut off at four sigma and scaled to a maximum of 1."""
    k = int(4 * sigma / cell + 0.999)
    base = hash_points(points, cell).groupBy("cx", "cy").agg(F.sum(weight).alias("w"))
    span = lambda: F.explode(F.sequence(F.lit(-k), F.lit(k)))
    spread = base.withColumn("i", span()).withColumn("j", span())
    d2 = (F.col("i") * F.col("i") + F.col("j") * F.col("j")) * (cell * cell)
    spread = spread.filter(d2 <= 16 * sigma * sigma).select((F.col("cx") + F.col("i")).alias("cx"), (F.col("cy") + F.col("j")).alias("cy"), (F.col("w") * F.exp(-d2 / (2 * sigma * sigma))).alias("h"))
    total = spread.groupBy("cx", "cy").agg(F.sum("h").alias("h"))
    most = total.agg(F.max("h").alias("most"))
    return total.crossJoin(F.broadcast(most)).select("cx", "cy", (F.col("h") / F.col("most")).alias("heat"))  # one row


def split_parts(parts: DataFrame) -> DataFrame:
    """Parts (parcel, part, area, pop) of parcels: the parcel's population shared by area, with the density."""
    w = W.partitionBy("parcel")
    share = F.col("pop") * F.col("area") / F.nullif(F.sum("area").over(w), F.lit(0.0))
    return parts.select("parcel", "part", "area", share.alias("pop"), (share / F.nullif(F.col("area"), F.lit(0.0))).alias("density"))


def conflate(lines: DataFrame, streets: DataFrame, step: float = 5.0, reach: float = 40.0, angle: float = 30.0) -> DataFrame:
    """Rows (line, infra): external bikeway segments (line, seg, x1.., infra) carried over to street segments (line, .., one_way).

    Bikeways are sampled every ``step`` metres; a sample goes to the nearest street segment within ``reach`` whose
    direction differs by less than ``angle`` degrees and that its perpendicular meets, or to the two nearest if both are
    one-way. Streets are cut into bins of ``step``; a bin takes the highest value, a street the most frequent value of
    its bins, of equals the larger, and nothing (0) only if at least half of its bins are empty.
    """
    src = along(lines).filter("len > 0")
    w = W.partitionBy("line")
    # direction of the bikeway as a unit vector, so that the tests below are products only
    src = src.withColumns({"total": F.sum("len").over(w), "sx": (F.col("x2") - F.col("x1")) / F.col("len"), "sy": (F.col("y2") - F.col("y1")) / F.col("len")})
    start = F.pmod(F.col("total"), F.lit(step)) / 2
    lo, hi = F.ceil((F.col("before") - start) / step).cast("long"), F.ceil((F.col("before") + F.col("len") - start) / step).cast("long") - 1
    src = src.filter(lo <= hi).withColumn("k", F.explode(F.sequence(lo, hi)))
    t = (F.col("k") * step + start - F.col("before")) / F.col("len")
    samples = src.select(F.struct("line", "k").alias("id"), (F.col("x1") + t * (F.col("x2") - F.col("x1"))).alias("x"), (F.col("y1") + t * (F.col("y2") - F.col("y1"))).alias("y"), "sx", "sy", "infra")
    there = settle(along(dealt_out(streets)).filter("len > 0").select("line", "seg", "x1", "y1", "x2", "y2", "before", "len", "one_way"))
    least = math.cos(math.radians(angle))

    def far(p: dict[str, np.ndarray], s: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
        """Distances along the perpendiculars (direction -sy, sx) of samples, and where they meet segments of alike direction."""
        dx, dy, x, y = s["x2"] - s["x1"], s["y2"] - s["y1"], p["x"] - s["x1"], p["y"] - s["y1"]
        det = -p["sy"] * dy - p["sx"] * dx
        safe, turned = np.where(det == 0, 1, det), np.abs(det) - least * np.hypot(dx, dy)
        u, edge = (-p["sy"] * y - p["sx"] * x) / safe, HAIR * np.hypot(dx, dy)
        counts = lambda hair: (det != 0) & (turned > hair * edge) & (u >= hair * HAIR) & (u <= 1 - hair * HAIR)
        return np.abs((x * dy - y * dx) / safe), counts(-1), counts(1)

    # most samples find their two within a small radius; the others climb on, up to the reach
    total, counts = directions(there)
    left, radius, two = settle(samples), None, None
    while True:
        n, box = _extent(left)
        if not n and two is not None:
            break
        if radius is None:
            area = max(box[1] - box[0], reach) * max(box[3] - box[2], reach) if n else 0.0
            radius = min(reach, max(reach / 10_000, 30 * area / total)) if total else reach
        else:
            radius = min(reach, 8 * radius)
        found = passing(left, there, radius, 4 * radius, n, box if n else (0.0,) * 4, counts, 2, far)
        dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
        found = found.filter(F.abs(F.col("sx") * dx + F.col("sy") * dy) > least * F.col("len"))
        # where the perpendicular (direction -sy, sx) through the sample meets the segment, and how far along it
        px, py, det = F.col("x") - F.col("x1"), F.col("y") - F.col("y1"), A.cross(-F.col("sy"), F.col("sx"), dx, dy)
        found = found.withColumns({"u": A.cross(-F.col("sy"), F.col("sx"), px, py) / F.nullif(det, F.lit(0.0)), "dist": F.abs(A.cross(px, py, dx, dy) / F.nullif(det, F.lit(0.0)))})
        found = found.filter("u between 0 and 1").filter(F.col("dist") <= radius)
        order, whole = W.partitionBy("id").orderBy("dist", "line", "seg"), W.partitionBy("id")
        # the two nearest of each task go to the shuffle, no more
        near = found.select("id", "dist", "line", "seg", "u", "before", "len", "one_way", "infra").withColumn("rank", F.row_number().over(order)).filter("rank <= 2")
        near = near.withColumns({"top": F.max(F.when(F.col("rank") == 1, F.col("one_way"))).over(whole), "last": F.max("rank").over(whole)})
        near = settle(near if radius >= reach else near.filter("last = 2 or top <> 1"))
        two = near if two is None else two.union(near)
        if radius >= reach:
            break
        left = settle(left.join(near.select("id").distinct(), "id", "left_anti"))
    kept = two.filter((F.col("rank") == 1) | ((F.col("rank") == 2) & (F.col("one_way") == 1) & (F.col("top") == 1)))
    bins = kept.groupBy("line", F.floor((F.col("before") + F.col("u") * F.col("len")) / step).cast("long").alias("bin")).agg(F.max("infra").alias("infra"))
    size = streets.groupBy("line").agg(F.greatest(F.ceil(F.sum("len") / step).cast("long"), F.lit(1)).alias("bins"))
    votes = bins.groupBy("line", "infra").agg(F.count(F.lit(1)).alias("n"))
    hit = votes.groupBy("line").agg(F.sum("n").alias("hit"), F.max(F.struct("n", "infra")).alias("best"))
    empty = F.greatest(F.col("bins") - F.col("hit"), F.lit(0))
    return hit.join(size, "line").select("line", F.when(2 * empty >= F.col("bins"), 0).otherwise(F.col("best.infra")).alias("infra"))


def touches_both(segments: DataFrame, circles: DataFrame) -> DataFrame:
    """Lines that come within both circles of ``circles`` (one row: ax, ay, ar, bx, by, br), as (line)."""
    near = lambda p: foot(F.col(f"{p}x"), F.col(f"{p}y"))[3] <= F.col(f"{p}r")
    all_ = segments.crossJoin(F.broadcast(circles.limit(1)))  # one row
    return all_.groupBy("line").agg(F.max(near("a").cast("int")).alias("a"), F.max(near("b").cast("int")).alias("b")).filter("a = 1 and b = 1").select("line")
