"""Array and arithmetic column builders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the earth's circumference in metres: along the equator and over the poles.
EQUATOR_M, MERIDIAN_M = 40075017.0, 40007860.0
EARTH_RADIUS_M = 6371000.0


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fold(array: Column, zero: Column, step: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(array, zero, step)


def total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + x)


def circular(array: Column, shift: Column | int) -> Column:
    """Rotate left by ``shift``."""
    n = F.size(array)
    k = F.when(n > 0, F.pmod(F.lit(shift) if isinstance(shift, int) else shift, n)).otherwise(0)
    return F.concat(F.slice(array, k + 1, n - k), F.slice(array, F.lit(1), k))


def sorted_unique(array: Column) -> Column:
    return F.array_sort(F.array_distinct(array))


def without_repeats(array: Column) -> Column:
    """Consecutive equal elements once."""
    return F.filter(array, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(array, i - 1)))


def dot(ax, ay, bx, by) -> Column:
    return ax * bx + ay * by


def cross(ax, ay, bx, by) -> Column:
    return ax * by - ay * bx


def distance(ax, ay, bx, by) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def to_metres(lon: Column, lat: Column, lon0: float, lat0: float) -> tuple[Column, Column]:
    """Local metres around a centre; the width of a degree is that at the point's own latitude."""
    return (lon - lon0) * (EQUATOR_M / 360) * F.cos(F.radians(lat)), (lat - lat0) * (MERIDIAN_M / 360)


def to_degrees(x: Column, y: Column, lon0: float, lat0: float) -> tuple[Column, Column]:
    """Inverse of to_metres()."""
    lat = lat0 + y / (MERIDIAN_M / 360)
    return lon0 + x / (EQUATOR_M / 360) / F.cos(F.radians(lat)), lat


def mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Unit square of the web map: x from 0 to 1 eastwards, y from 0 to 1 southwards."""
    return (lon + 180) / 360, F.lit(0.5) - F.log(F.tan(F.lit(0.25) * F.pi() + F.radians(lat) / 2)) / (2 * F.pi())


def mercator_inverse(x: Column, y: Column) -> tuple[Column, Column]:
    return x * 360 - 180, F.degrees(2 * F.atan(F.exp((F.lit(0.5) - y) * 2 * F.pi())) - F.pi() / 2)


def earth_distance(lon1, lat1, lon2, lat2) -> Column:
    """Great-circle metres by the haversine formula."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def boxes_overlap(l1, r1, b1, t1, l2, r2, b2, t2) -> Column:
    """Whether two boxes share more than their edges."""
    return (F.greatest(l1, l2) < F.least(r1, r2)) & (F.greatest(b1, b2) < F.least(t1, t2))


def circumscribed(xs: Column, ys: Column) -> tuple[Column, Column, Column]:
    """Centre of the bounding box and the distance of the farthest point from it."""
    cx, cy = (F.array_min(xs) + F.array_max(xs)) / 2, (F.array_min(ys) + F.array_max(ys)) / 2
    return cx, cy, F.array_max(F.zip_with(xs, ys, lambda x, y: distance(x, y, cx, cy)))


def line_angle(dx: Column, dy: Column) -> Column:
    """Direction of a line modulo a half turn; upright lines are pi / 2."""
    return F.when(dx == 0, F.pi() / 2).otherwise(F.atan(dy / F.nullif(dx, F.lit(0))))


def angle_between(a: Column, b: Column) -> Column:
    """Smallest difference of two line directions."""
    return F.least(F.abs(a - b), F.abs(F.pi() + a - b), F.abs(-F.pi() + a - b))


def shoelace(xs: Column, ys: Column) -> Column:
    """Area of a closed ring of points (the first need not be repeated)."""
    n = F.size(xs)
    return F.abs(F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda a, i: a + cross(F.get(xs, i), F.get(ys, i), F.get(xs, (i + 1) % n), F.get(ys, (i + 1) % n)))) / 2


def finite(x: Column) -> Column:
    """The value, or null for NaN and the infinities."""
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), x)


def slope_percent(rise: Column, run: Column) -> Column:
    """Whole percent within 6.5 either way, cut towards zero; -127 where the heights are unknown."""
    s = F.greatest(F.lit(-6.5), F.least(F.lit(6.5), 100 * rise / run))
    return F.when(rise.isNull() | F.isnan(rise), -127).otherwise(s.cast("int"))


def slope_penalty(rise: Column, run: Column, table: list[float]) -> Column:
    """Relative slowdown of a slope, from a table for -11 to 11 percent."""
    i = F.lit(11) + F.greatest(F.lit(-11.0), F.least(F.lit(11.0), 100 * rise / run)).cast("int")
    return F.get(F.array(*[F.lit(float(v)) for v in table]), i)


def clock_seconds(col: Column) -> Column:
    """Seconds of H:M:S; hours may exceed 24."""
    p = F.split(F.trim(col), ":")
    return 3600 * F.get(p, 0).try_cast("int") + 60 * F.get(p, 1).try_cast("int") + F.get(p, 2).try_cast("int")


def heat_colour(v: Column) -> Column:
    """Blue over green to red for 0 to 1, as an array of three bytes."""
    x = F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
    ramp = lambda c: (F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)) * 255).cast("int")
    return F.array(ramp(2 * x - 1), ramp(1 - F.abs(2 * x - 1)), ramp(1 - 2 * x))
