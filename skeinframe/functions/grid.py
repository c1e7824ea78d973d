"""Ellipsoidal areas and places on the British grid as column expressions (survey P-23, P-30)."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import grid_letters_british, ring_edges

# Ellipsoids (half axes in metres), and the shift from WGS 84 to the grid's datum (metres, seconds of arc, parts in a million)
WGS84 = (6378137.0, 6356752.314245)


@dataclass(frozen=True)
class Grid:
    """A transverse Mercator grid: half axes, origin (degrees), scale, false east and north, and the datum shift from WGS 84."""

    a: float
    b: float
    lat0: float
    lng0: float
    scale: float
    east0: float
    north0: float
    shift: tuple[float, float, float, float, float, float, float]


BRITISH = Grid(6377563.396, 6356256.909, 49.0, -2.0, 0.9996012717, 400000.0, -100000.0, (-446.448, 125.157, -542.060, -0.1502, -0.2470, -0.8421, 20.4894))


def ellipsoid_km2(ring: Column, axes: tuple[float, float] = WGS84) -> Column:
    """Area of a ring of degrees (x: longitude, y: latitude) on an ellipsoid. Each vertex counts by the exact area between its latitude and the equator; edges are straight in longitude and that area, so only long slanting edges differ from geodesics."""
    a, b = axes
    e2 = 1 - (b / a) ** 2
    e = math.sqrt(e2)

    def zone(lat: Column) -> Column:
        s = F.sin(F.radians(lat))
        return (1 - e2) * (s / (1 - e2 * s * s) - F.log((1 - e * s) / (1 + e * s)) / (2 * e))

    total = F.aggregate(ring_edges(ring), F.lit(0.0), lambda acc, x: acc + F.radians(x["b"]["x"] - x["a"]["x"]) * (zone(x["a"]["y"]) + zone(x["b"]["y"])))
    return F.when(F.size(ring) < 3, 0.0).otherwise(F.abs(total) * a * a / 4 / 1e6)


def shifted(lat: Column, lng: Column, grid: Grid) -> tuple[Column, Column]:
    """Latitude and longitude (radians) on a grid's datum of a place on WGS 84 at height 0, by seven parameters."""
    a, b = WGS84
    e2 = 1 - (b / a) ** 2
    p, l = F.radians(lat), F.radians(lng)  # noqa: E741
    nu = a / F.sqrt(1 - e2 * F.sin(p) ** 2)
    x, y, z = nu * F.cos(p) * F.cos(l), nu * F.cos(p) * F.sin(l), nu * (1 - e2) * F.sin(p)
    tx, ty, tz, *turn, ppm = grid.shift
    rx, ry, rz = (math.radians(r / 3600) for r in turn)
    k = 1 + ppm / 1e6
    x2, y2, z2 = tx + k * x - rz * y + ry * z, ty + rz * x + k * y - rx * z, tz - ry * x + rx * y + k * z
    f2 = 1 - (grid.b / grid.a) ** 2
    # Bowring's formula: exact to a tenth of a millimetre near the surface
    r = F.sqrt(x2 * x2 + y2 * y2)
    u = F.atan2(z2 * grid.a, r * grid.b)
    second = f2 / (1 - f2)
    return F.atan2(z2 + second * grid.b * F.sin(u) ** 3, r - f2 * grid.a * F.cos(u) ** 3), F.atan2(y2, x2)


def projected(lat: Column, lng: Column, grid: Grid) -> Column:
    """(east, north) in metres of a latitude and longitude in radians on a grid's own datum, by the series of the transverse Mercator projection."""
    a, b, f0 = grid.a, grid.b, grid.scale
    e2, n = 1 - (b / a) ** 2, (a - b) / (a + b)
    lat0, lng0 = math.radians(grid.lat0), math.radians(grid.lng0)
    s, c, t2 = F.sin(lat), F.cos(lat), F.tan(lat) ** 2
    nu = a * f0 / F.sqrt(1 - e2 * s * s)
    rho = a * f0 * (1 - e2) * (1 - e2 * s * s) ** -1.5
    eta2 = nu / rho - 1
    d, m = lat - lat0, lat + lat0
    arc = b * f0 * ((1 + n + 5 / 4 * n**2 + 5 / 4 * n**3) * d - (3 * n + 3 * n**2 + 21 / 8 * n**3) * F.sin(d) * F.cos(m) + (15 / 8 * n**2 + 15 / 8 * n**3) * F.sin(2 * d) * F.cos(2 * m) - 35 / 24 * n**3 * F.sin(3 * d) * F.cos(3 * m))
    w = lng - lng0
    north = arc + grid.north0 + nu / 2 * s * c * w**2 + nu / 24 * s * c**3 * (5 - t2 + 9 * eta2) * w**4 + nu / 720 * s * c**5 * (61 - 58 * t2 + t2 * t2) * w**6
    east = grid.east0 + nu * c * w + nu / 6 * c**3 * (nu / rho - t2) * w**3 + nu / 120 * c**5 * (5 - 18 * t2 + t2 * t2 + 14 * eta2 - 58 * t2 * eta2) * w**5
    return F.struct(east.alias("east"), north.alias("north"))


def grid_place(lat: Column, lng: Column, grid: Grid = BRITISH) -> Column:
    """(east, north) in metres on a national grid of a place on WGS 84, within some metres; null for null coordinates."""
    return F.when(lat.isNotNull() & lng.isNotNull(), projected(*shifted(lat, lng, grid), grid))


def grid_reference(lat: Column, lng: Column) -> Column:
    """The reference of a place on WGS 84 on the British grid: two letters and three digits each way; null outside it."""
    at = grid_place(lat, lng)
    return grid_letters_british(at["east"], at["north"])
