"""Assembly of a city from census parcels: its own parcels, its largest connected part, and the parcels around that."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velonet.functions import arrays as A

from . import network as N
from . import rings as R
from . import spatial as S


def edges(polygons: DataFrame, *keys: str) -> DataFrame:
    """Edges (keys, poly, x1, y1, x2, y2) of polygons (keys, poly, xs, ys); the ring closes itself, empty rings have none."""
    at = polygons.filter("size(xs) > 0").select(*keys, "poly", "xs", "ys", F.explode(F.sequence(F.lit(0), F.size("xs") - 1)).alias("i"))
    j = (F.col("i") + 1) % F.size("xs")
    get = lambda c, i: F.get(F.col(c), i).cast("double")
    return at.select(*keys, "poly", get("xs", F.col("i")).alias("x1"), get("ys", F.col("i")).alias("y1"), get("xs", j).alias("x2"), get("ys", j).alias("y2"))


def polygons_within(these: DataFrame, those: DataFrame, reach: float, size: float, by: str | None = None) -> DataFrame:
    """Pairs (a, b) of polygons (poly, xs, ys) at most ``reach`` apart; 0 for those that touch, overlap or contain.

    Edges meet by grid cell, only those of the first side in all cells within reach; a polygon inside another one is
    found by a corner. With ``by``, a column of both sides, only polygons that agree in it meet, as (by, a, b).
    """
    key = [by] if by else []
    met = edges_met(S.hash_segments(S.dealt_out(edges(these, *key), "poly"), size, reach), S.hash_segments(S.dealt_out(edges(those, *key), "poly"), size), reach, *key)
    full = lambda df: df.filter("size(xs) > 0").select(*key, "poly", "xs", "ys")
    held = S.points_in_polygons(corners(those, *key), full(these), size, *key).select(*key, F.col("poly").alias("a"), F.col("id").alias("b"))
    holds = S.points_in_polygons(corners(these, *key), full(those), size, *key).select(*key, F.col("id").alias("a"), F.col("poly").alias("b"))
    return met.union(held).union(holds).distinct()


def corners(polygons: DataFrame, *keys: str) -> DataFrame:
    """The first corner (keys, id, x, y) of each polygon."""
    return polygons.filter("size(xs) > 0").select(*keys, F.col("poly").alias("id"), F.get("xs", F.lit(0)).cast("double").alias("x"), F.get("ys", F.lit(0)).cast("double").alias("y"))


def edges_met(left: DataFrame, right: DataFrame, reach: float, *key: str) -> DataFrame:
    """Pairs (key, a, b) of polygons with edges (key, poly, x1, y1, x2, y2, cx, cy) at most ``reach`` apart that share a cell."""
    names = ("x1", "y1", "x2", "y2")
    left, right = left.withColumnRenamed("poly", "a"), right.withColumnsRenamed({"poly": "b", **{c: f"o{c}" for c in names}})
    x1, y1, x2, y2, u1, v1, u2, v2 = (F.col(c) for c in (*names, *(f"o{c}" for c in names)))
    # boxes of edges further apart than reach spare the exact test
    apart = lambda p, q, s, t: (F.greatest(p, q) + reach < F.least(s, t)) | (F.greatest(s, t) + reach < F.least(p, q))
    met = left.join(right, [*key, "cx", "cy"]).filter(~(apart(x1, x2, u1, u2) | apart(y1, y2, v1, v2)))
    # from each end to the other edge, and on which side of it: one projection for each step, so that none is repeated, and
    # the test behind an aggregate, as a filter ahead would be moved into the join and repeat all steps
    ends = ((x1, y1, u1, v1, u2, v2), (x2, y2, u1, v1, u2, v2), (u1, v1, x1, y1, x2, y2), (u2, v2, x1, y1, x2, y2))
    met = met.withColumns({f"{n}{i}": c for i, (px, py, ax, ay, bx, by_) in enumerate(ends) for n, c in (("_ex", bx - ax), ("_ey", by_ - ay), ("_px", px - ax), ("_py", py - ay))})
    of = lambda i: tuple(F.col(f"_{n}{i}") for n in ("ex", "ey", "px", "py"))
    met = met.withColumns({f"_t{i}": F.coalesce(A.dot(px, py, ex, ey) / F.nullif(A.dot(ex, ey, ex, ey), F.lit(0.0)), F.lit(0.0)) for i in range(4) for ex, ey, px, py in [of(i)]})
    met = met.withColumns({f"_t{i}": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(f"_t{i}"))) for i in range(4)} | {f"_s{i}": F.signum(A.cross(ex, ey, px, py)) for i in range(4) for ex, ey, px, py in [of(i)]})
    far = F.least(*[A.distance(px, py, ax + F.col(f"_t{i}") * F.col(f"_ex{i}"), ay + F.col(f"_t{i}") * F.col(f"_ey{i}")) for i, (px, py, ax, ay, _, _) in enumerate(ends)])
    crossing = (F.col("_s0") * F.col("_s1") < 0) & (F.col("_s2") * F.col("_s3") < 0)
    return met.groupBy(*key, "a", "b").agg(F.max(crossing | (far <= reach)).alias("near")).filter("near").select(*key, "a", "b")


def touching(polygons: DataFrame, size: float, *keys: str) -> DataFrame:
    """Links (a, b) of polygons (keys, poly, xs, ys) that agree in the ``keys`` and touch, overlap or contain: enough to join their groups.

    ``poly`` is unique. What meets a cell inside a polygon touches that polygon, so each polygon there has one link; pairs are
    made in the other cells only.
    """
    fine, cell = size * S.FINE, [*keys, "cx", "cy"]
    some = polygons.filter("size(xs) > 0").select(*keys, "poly", "xs", "ys")
    whole, touched, covered = S.covered_by(some, fine, *keys)
    there = N.settle(S.hash_segments(S.dealt_out(edges(some, *keys), "poly"), fine))
    linked = whole.select(*cell, "poly").union(there.select(*cell, "poly")).join(covered, cell).filter("poly <> first").select(F.col("poly").alias("a"), F.col("first").alias("b")).distinct()
    shown = N.settle(there.join(covered, cell, "left_anti"))
    met = edges_met(shown, shown, 0.0, *keys).filter("a < b").select("a", "b")
    at = S.hash_points(corners(some, *keys), fine).join(covered, cell, "left_anti")
    held = at.join(touched, cell).filter((F.col("id") != F.col("poly")) & S.inside(F.col("x"), F.col("y"), F.col("xs"), F.col("ys"))).select(F.col("id").alias("a"), F.col("poly").alias("b"))
    return linked.union(met).union(held)


def groups_within(these: DataFrame, those: DataFrame, reach: float, size: float) -> DataFrame:
    """Pairs (city, poly) of polygons ``those`` (poly, xs, ys) at most ``reach`` from any of a city's in ``these`` (city, poly, xs, ys).

    Two corners in one cell whose diagonal is ``reach`` settle a pair, however many polygons lie there. What such cells leave
    open, but cells of the boxes allow, is tested by edges: pairs of city and polygon, not of polygons, go on.
    """
    boxed = lambda df: S.with_boxes(df.filter("size(xs) > 0"))
    cells = lambda df, key, grow: S.hash_boxes(boxed(df), size, grow).select(key, "cx", "cy").distinct()
    may = cells(these, "city", reach).join(cells(those, "poly", 0.0), ["cx", "cy"]).select("city", "poly").distinct()
    if reach > 0:
        small = reach / 1.4142136  # just over the root of 2, so that the diagonal stays within reach
        corners = lambda df, key: S.hash_points(df.select(key, F.explode(F.arrays_zip("xs", "ys")).alias("p")).select(key, F.col("p.xs").alias("x"), F.col("p.ys").alias("y")), small).select(key, "cx", "cy").distinct()
        sure = N.settle(corners(these, "city").join(corners(those, "poly"), ["cx", "cy"]).select("city", "poly").distinct())
        may = may.join(sure, ["city", "poly"], "left_anti")
    rest = N.settle(may.join(those.select("poly", "xs", "ys"), "poly").select("city", "poly", "xs", "ys"))
    found = polygons_within(these, rest, reach, size, "city").select("city", F.col("b").alias("poly")).distinct()
    return found.union(sure) if reach > 0 else found


def city_parcels(parcels: DataFrame, buffer_m: float, size: float) -> DataFrame:
    """Rows (city, poly, role) of parcels (poly, city, xs, ys): each city's own and those around it, all cities at once.

    A city's parcels that touch form parts; the largest by summed area (of equals the one with the smallest parcel) is
    its boundary: role ``main``, its other parcels ``detached``. Any further parcel at most ``buffer_m`` from the boundary
    is ``around``, and may stand with several cities. A parcel without a city belongs to none but can lie around one;
    parcels are expected not to overlap, and ``poly`` to be unique.
    """
    own = parcels.filter("city is not null and size(xs) > 0").select("poly", "city", "xs", "ys")
    of = own.select("poly", "city")
    touch = touching(own, size, "city")
    parts = own.join(N.components(touch).withColumnRenamed("node", "poly"), "poly", "left").withColumn("root", F.coalesce("root", "poly"))
    area = parts.groupBy("city", "root").agg(F.sum(A.shoelace(F.col("xs").cast("array<double>"), F.col("ys").cast("array<double>"))).alias("area"))
    most = area.groupBy("city").agg(F.max(F.struct("area", (-F.col("root")).alias("first"))).alias("m")).select("city", (-F.col("m.first")).alias("most"))
    rated = parts.join(most, "city").withColumn("role", F.when(F.col("root") == F.col("most"), "main").otherwise("detached"))
    rated = N.settle(rated.select("city", "poly", "role", "xs", "ys"))
    near = groups_within(rated.filter("role = 'main'"), parcels, buffer_m, size)
    return rated.select("city", "poly", "role").union(near.join(of, ["city", "poly"], "left_anti").select("city", "poly", F.lit("around")))


def outlines(parcels: DataFrame, roles: DataFrame, size: float) -> DataFrame:
    """Rows (city, xs, ys, area, l, r, b, t, cx, cy): the dissolved outline of each city's main parcels, its extent and centre.

    ``parcels`` (poly, xs, ys), ``roles`` (city, poly, role) as city_parcels gives them. Of several outlines the largest
    stays, holes are left out; ``area`` is what the outline encloses.
    """
    main = roles.filter("role = 'main'").join(parcels.select("poly", "xs", "ys"), "poly").select(F.col("city").alias("grp"), "poly", "xs", "ys")
    # a filter on the area would move down to the corners and sum them up anew for each of them
    ring = N.settle(R.union(main, size)).filter("area > 0")
    most = ring.groupBy("grp").agg(F.max_by(F.struct("xs", "ys", "area"), F.struct("area", -F.col("ring"))).alias("m")).select(F.col("grp").alias("city"), "m.*")
    boxed = S.with_boxes(most)
    return boxed.select("city", "xs", "ys", "area", "l", "r", "b", "t", ((F.col("l") + F.col("r")) / 2).alias("cx"), ((F.col("b") + F.col("t")) / 2).alias("cy"))
