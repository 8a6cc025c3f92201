"""Transverse Mercator zones and conformal conics, as column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import TRANSFORMS, vertex

#: Greater half axis and flattening of GRS 80 (fixed values).
GRS80 = (6378137.0, 1 / 298.257222101)
#: WGS 84; scale and false origin of the universal zones (fixed values).
WGS84 = (6378137.0, 1 / 298.257223563)
ZONE_SCALE, ZONE_EAST, ZONE_SOUTH = 0.9996, 500000.0, 10000000.0


def _series(f: float) -> tuple[float, float, list[float], list[float], list[float]]:
    """Third flattening, rectifying radius of a unit ellipsoid, and the
    coefficients to the plane, from it, and of latitude, to its third power."""
    n = f / (2 - f)
    radius = (1 + n**2 / 4 + n**4 / 64) / (1 + n)
    there = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    back = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480]
    latitude = [2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15]
    return n, radius, there, back, latitude


def _sum(terms: list[Column]) -> Column:
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def to_zone(v: Column, zone: int, south: bool = False, ellipsoid: tuple[float, float] = WGS84) -> Column:
    """Longitude and latitude to metres east and north (Krüger's series, exact
    to a millimetre within a zone)."""
    a, f = ellipsoid
    n, radius, there, _, _ = _series(f)
    e = 2 * math.sqrt(n) / (1 + n)
    sin = F.sin(F.radians(v["y"]))
    dl = F.radians(v["x"] - F.lit(6.0 * zone - 183))
    t = F.sinh(F.atanh(sin) - F.atanh(sin * e) * e)
    xi, eta = F.atan2(t, F.cos(dl)), F.atanh(F.sin(dl) / F.sqrt(t * t + 1))
    east = eta + _sum([F.cos(xi * 2 * j) * F.sinh(eta * 2 * j) * c for j, c in enumerate(there, 1)])
    north = xi + _sum([F.sin(xi * 2 * j) * F.cosh(eta * 2 * j) * c for j, c in enumerate(there, 1)])
    size = ZONE_SCALE * a * radius
    return vertex(east * size + ZONE_EAST, north * size + (ZONE_SOUTH if south else 0.0))


def from_zone(v: Column, zone: int, south: bool = False, ellipsoid: tuple[float, float] = WGS84) -> Column:
    """Metres east and north to longitude and latitude."""
    a, f = ellipsoid
    _, radius, _, back, latitude = _series(f)
    size = ZONE_SCALE * a * radius
    xi, eta = (v["y"] - (ZONE_SOUTH if south else 0.0)) / size, (v["x"] - ZONE_EAST) / size
    x = xi - _sum([F.sin(xi * 2 * j) * F.cosh(eta * 2 * j) * c for j, c in enumerate(back, 1)])
    y = eta - _sum([F.cos(xi * 2 * j) * F.sinh(eta * 2 * j) * c for j, c in enumerate(back, 1)])
    chi = F.asin(F.sin(x) / F.cosh(y))
    lat = chi + _sum([F.sin(chi * 2 * j) * c for j, c in enumerate(latitude, 1)])
    return vertex(F.degrees(F.atan2(F.sinh(y), F.cos(x))) + F.lit(6.0 * zone - 183), F.degrees(lat))


@dataclass(frozen=True)
class Conic:
    """A conformal conic: origin, standard parallels (equal ones for a cone that
    touches), false origin in metres, metres in a unit, ellipsoid."""

    lat0: float
    lon0: float
    lat1: float
    lat2: float
    x0: float = 0.0
    y0: float = 0.0
    unit: float = 1.0
    ellipsoid: tuple[float, float] = GRS80

    @property
    def shape(self) -> tuple[float, float, float, float]:
        """Eccentricity, the cone's constant, its scale and the origin's radius
        (the last two below 0 for cones of the south)."""
        a, f = self.ellipsoid
        e = math.sqrt(2 * f - f * f)
        shrink = lambda lat: math.tan(math.pi / 4 - lat / 2) / ((1 - e * math.sin(lat)) / (1 + e * math.sin(lat))) ** (e / 2)
        girth = lambda lat: math.cos(lat) / math.sqrt(1 - (e * math.sin(lat)) ** 2)
        origin, first, second = (math.radians(v) for v in (self.lat0, self.lat1, self.lat2))
        if abs(first - second) < 1e-10:
            n = math.sin(first)
        else:
            n = math.log(girth(first) / girth(second)) / math.log(shrink(first) / shrink(second))
        scale = a * girth(first) / (n * shrink(first) ** n)
        return e, n, scale, scale * shrink(origin) ** n


#: New York (Long Island, in US survey feet), France, Europe, Statistics Canada,
#: and the atlas of Canada.  Fixed values.
CONICS = {
    "epsg:2263": Conic(40.16666666666666, -74.0, 41.03333333333333, 40.66666666666666, 300000.0, 0.0, 0.3048006096012192),
    "epsg:2154": Conic(46.5, 3.0, 49.0, 44.0, 700000.0, 6600000.0),
    "epsg:3034": Conic(52.0, 10.0, 35.0, 65.0, 4000000.0, 2800000.0),
    "epsg:3347": Conic(63.390675, -91.86666666666666, 49.0, 77.0, 6200000.0, 3000000.0),
    "epsg:3978": Conic(49.0, -95.0, 49.0, 77.0),
}


def to_conic(v: Column, conic: Conic) -> Column:
    """Longitude and latitude to the conic's plane."""
    e, n, scale, rho0 = conic.shape
    lat = F.radians(v["y"])
    s = F.sin(lat) * e
    t = F.tan(F.lit(math.pi / 4) - lat / 2) / F.pow((1 - s) / (1 + s), F.lit(e / 2))
    # the shorter way round from the middle meridian
    turn = F.pmod(v["x"] - F.lit(conic.lon0) + 180, F.lit(360.0)) - 180
    rho, theta = F.pow(t, F.lit(n)) * scale, F.radians(turn) * n
    east, north = rho * F.sin(theta) + conic.x0, F.lit(rho0) - rho * F.cos(theta) + conic.y0
    return vertex(east / conic.unit, north / conic.unit)


def from_conic(v: Column, conic: Conic) -> Column:
    """The conic's plane to longitude and latitude (by five fixed-point steps)."""
    e, n, scale, rho0 = conic.shape
    side = math.copysign(1.0, n)
    x, y = (v["x"] * conic.unit - conic.x0) * side, (F.lit(rho0 + conic.y0) - v["y"] * conic.unit) * side
    t = F.pow(F.sqrt(x * x + y * y) / abs(scale), F.lit(1 / n))
    lat = F.lit(math.pi / 2) - 2 * F.atan(t)
    for _ in range(5):
        s = F.sin(lat) * e
        lat = F.lit(math.pi / 2) - 2 * F.atan(t * F.pow((1 - s) / (1 + s), F.lit(e / 2)))
    lon = F.degrees(F.atan2(x, y) / n) + F.lit(conic.lon0)
    return vertex(F.pmod(lon + 180, F.lit(360.0)) - 180, F.degrees(lat))


def to_new_york_feet(v: Column) -> Column:
    """Longitude and latitude to EPSG:2263."""
    return to_conic(v, CONICS["epsg:2263"])


def _zone(code: str) -> tuple[int, bool, tuple[float, float]] | None:
    """Zone, southern half and ellipsoid of a code such as ``epsg:32618``."""
    digits = code.removeprefix("epsg:")
    if len(digits) != 5 or not digits.isdigit():
        return None
    kind, zone = digits[:3], int(digits[3:])
    if kind in ("326", "327") and 1 <= zone <= 60:
        return zone, kind == "327", WGS84
    return (zone, False, GRS80) if kind == "269" and 1 <= zone <= 23 else None


def _conic(system: str | Conic) -> Conic | None:
    return system if isinstance(system, Conic) else CONICS.get(system)


def degrees_of(system: str | Conic) -> Callable[[Column], Column] | None:
    """The transform of a reference system to longitude and latitude."""
    if conic := _conic(system):
        return lambda v: from_conic(v, conic)
    if system in ("epsg:4326", "epsg:4269"):
        return lambda v: v
    zone = _zone(system)
    return (lambda v: from_zone(v, *zone)) if zone else TRANSFORMS.get((system, "epsg:4326"))


def of_degrees(system: str | Conic) -> Callable[[Column], Column] | None:
    """The transform of longitude and latitude to a reference system."""
    if conic := _conic(system):
        return lambda v: to_conic(v, conic)
    if system in ("epsg:4326", "epsg:4269"):
        return lambda v: v
    zone = _zone(system)
    return (lambda v: to_zone(v, *zone)) if zone else TRANSFORMS.get(("epsg:4326", system))
