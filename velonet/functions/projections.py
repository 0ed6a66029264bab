"""Map projections in closed form: transverse Mercator zones, Lambert's conformal conic, and the web map, both ways."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Semi-major axis and flattening of the GRS 80 ellipsoid, radius of the web map's sphere.
AXIS, FLAT, SPHERE = 6378137.0, 1 / 298.257222101, 6378137.0
E2 = FLAT * (2 - FLAT)
ECC = math.sqrt(E2)


def web_inverse(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / SPHERE), F.degrees(2 * F.atan(F.exp(y / SPHERE)) - math.pi / 2)


def web_forward(lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.radians(lon) * SPHERE, SPHERE * F.log(F.tan(math.pi / 4 + F.radians(lat) / 2))


def _series() -> tuple[float, tuple[float, ...], tuple[float, ...], tuple[float, ...]]:
    """Rectifying radius and the series of the transverse Mercator projection in the third flattening, to its third power."""
    n = FLAT / (2 - FLAT)
    radius = AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    ahead = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    back = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    lat = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    return radius, ahead, back, lat


RADIUS, AHEAD, BACK, LAT = _series()
SCALE, EAST = 0.9996, 500000.0


def utm_forward(lon: Column, lat: Column, zone: int) -> tuple[Column, Column]:
    """Easting and northing (northern hemisphere)."""
    p, d = F.radians(lat), F.radians(lon - (6 * zone - 183))
    s = F.sin(p)
    t = F.sinh(F.atanh(s) - ECC * F.atanh(ECC * s))
    xi, eta = F.atan2(t, F.cos(d)), F.atanh(F.sin(d) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for k, a in enumerate(AHEAD, 1):
        x = x + a * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
        y = y + a * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
    return EAST + SCALE * RADIUS * x, SCALE * RADIUS * y


def utm_inverse(x: Column, y: Column, zone: int) -> tuple[Column, Column]:
    """Degrees of an easting and northing (northern hemisphere)."""
    xi, eta = y / (SCALE * RADIUS), (x - EAST) / (SCALE * RADIUS)
    a, b = xi, eta
    for k, c in enumerate(BACK, 1):
        a = a - c * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
        b = b - c * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
    chi = F.asin(F.sin(a) / F.cosh(b))
    lat = chi
    for k, c in enumerate(LAT, 1):
        lat = lat + c * F.sin(2 * k * chi)
    return F.lit(6 * zone - 183) + F.degrees(F.atan2(F.sinh(b), F.cos(a))), F.degrees(lat)


@dataclass(frozen=True)
class Conic:
    """A Lambert conformal conic: standard parallels, origin, false easting and northing (degrees and metres)."""

    first: float
    second: float
    lat0: float
    lon0: float
    east: float
    north: float

    @staticmethod
    def _m(p: float) -> float:
        return math.cos(p) / math.sqrt(1 - E2 * math.sin(p) ** 2)

    @staticmethod
    def _t(p: float) -> float:
        return math.tan(math.pi / 4 - p / 2) / ((1 - ECC * math.sin(p)) / (1 + ECC * math.sin(p))) ** (ECC / 2)

    def cone(self) -> tuple[float, float, float]:
        a, b, c = (math.radians(v) for v in (self.first, self.second, self.lat0))
        n = (math.log(self._m(a)) - math.log(self._m(b))) / (math.log(self._t(a)) - math.log(self._t(b)))
        f = self._m(a) / (n * self._t(a) ** n)
        return n, f, AXIS * f * self._t(c) ** n

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        n, f, r0 = self.cone()
        s = F.sin(F.radians(lat))
        t = F.tan(math.pi / 4 - F.radians(lat) / 2) / F.pow((1 - ECC * s) / (1 + ECC * s), F.lit(ECC / 2))
        r, a = AXIS * f * F.pow(t, F.lit(n)), n * F.radians(lon - self.lon0)
        return self.east + r * F.sin(a), self.north + r0 - r * F.cos(a)

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        """The latitude comes from the conformal latitude by its series in the eccentricity, good to a millimetre."""
        n, f, r0 = self.cone()
        dx, dy = x - self.east, r0 - (y - self.north)
        t = F.pow(F.sqrt(dx * dx + dy * dy) / (AXIS * f), F.lit(1 / n))
        chi = math.pi / 2 - 2 * F.atan(t)
        lat = chi
        for k, c in enumerate(LAT, 1):
            lat = lat + c * F.sin(2 * k * chi)
        return F.degrees(F.atan2(dx, dy) / n) + self.lon0, F.degrees(lat)


#: Coordinate systems by number.
STATISTICS = Conic(49.0, 77.0, 63.390675, -91.86666666666666, 6200000.0, 3000000.0)
UTM_ZONES = {26910: 10, 26917: 17}


def to_degrees(x: Column, y: Column, system: int) -> tuple[Column, Column]:
    """Longitude and latitude from a coordinate system known by its number."""
    if system in (4269, 4326):
        return x, y
    if system == 3857:
        return web_inverse(x, y)
    if system == 3347:
        return STATISTICS.inverse(x, y)
    return utm_inverse(x, y, UTM_ZONES[system])
