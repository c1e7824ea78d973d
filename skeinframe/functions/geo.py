"""Distances, boxes, cells, rings and tiles as column expressions (survey P-17 to P-30)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean radii of the earth in kilometres.
RADIUS_KM, RADIUS_FINE_KM = 6371.0, 6371.0088
KM_A_DEGREE = 111.32


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column, radius: float = RADIUS_KM) -> Column:
    half = lambda x: F.pow(F.sin(F.radians(x) / 2), F.lit(2.0))
    h = half(lat2 - lat1) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lng2 - lng1)
    return 2 * radius * F.asin(F.sqrt(F.when(h > 1, 1.0).otherwise(h)))


def flat_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Metres on a plane touching at the middle latitude."""
    x = (lng2 - lng1) * F.cos(F.radians((lat1 + lat2) / 2))
    return F.sqrt(F.pow(lat2 - lat1, F.lit(2.0)) + F.pow(x, F.lit(2.0))) * (KM_A_DEGREE * 1000)


def in_box(lat: Column, lng: Column, box: tuple[float, float, float, float]) -> Column:
    s, w, n, e = box
    return lat.between(s, n) & lng.between(w, e)


def first_box(lat: Column, lng: Column, boxes, other: str | None = None) -> Column:
    """The name of the first of ``boxes`` (name, (south, west, north, east)) that holds a point."""
    out = F.lit(other)
    for name, box in reversed(list(boxes)):
        out = F.when(in_box(lat, lng, box), F.lit(name)).otherwise(out)
    return out


def equal_area_radius_m(area_km2: Column) -> Column:
    return F.when(area_km2 > 0, F.sqrt(area_km2 / math.pi) * 1000).otherwise(0.0)


def cell(x: Column, width: float) -> Column:
    return F.floor(x / width).cast("int")


def ring_edges(ring: Column) -> Column:
    """(a, b) of each edge, the last one closing the ring. ring: array of (x, y)."""
    return F.zip_with(ring, F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(1))), F.slice(ring, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def shoelace(ring: Column) -> Column:
    """Unsigned area in the ring's units; 0 for fewer than three points."""
    twice = F.aggregate(ring_edges(ring), F.lit(0.0), lambda s, e: s + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])
    return F.when(F.size(ring) < 3, 0.0).otherwise(F.abs(twice) / 2)


def planar_km2(ring: Column) -> Column:
    """Area of a ring of degrees (x: longitude, y: latitude) on a plane at its mean latitude."""
    mid = F.aggregate(ring, F.lit(0.0), lambda s, p: s + p["y"]) / F.greatest(F.size(ring), F.lit(1))
    return shoelace(ring) * F.cos(F.radians(mid)) * (KM_A_DEGREE**2)


def spherical_km2(ring: Column, radius: float = RADIUS_FINE_KM) -> Column:
    """Area on the sphere by the sum of (longitude step) * (2 + sines); ellipsoids differ by half a per cent."""
    s = F.aggregate(ring_edges(ring), F.lit(0.0), lambda acc, e: acc + F.radians(e["b"]["x"] - e["a"]["x"]) * (2 + F.sin(F.radians(e["a"]["y"])) + F.sin(F.radians(e["b"]["y"]))))
    return F.when(F.size(ring) < 3, 0.0).otherwise(F.abs(s) * radius * radius / 2)


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd rule: whether a ray from the point crosses an odd number of edges."""

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        at = (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]
        return ((a["y"] > y) != (b["y"] > y)) & (x < at)

    return F.size(F.filter(ring_edges(ring), crosses)) % 2 == 1


def in_polygon(x: Column, y: Column, outers: Column, inners: Column) -> Column:
    return F.exists(outers, lambda r: in_ring(x, y, r)) & ~F.exists(inners, lambda r: in_ring(x, y, r))


def ring_box(ring: Column) -> Column:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(ys).alias("south"), F.array_min(xs).alias("west"), F.array_max(ys).alias("north"), F.array_max(xs).alias("east"))


def centroid(ring: Column) -> Column:
    """Mean of the vertices."""
    n = F.greatest(F.size(ring), F.lit(1))
    mean = lambda k: F.aggregate(ring, F.lit(0.0), lambda s, p: s + p[k]) / n
    return F.struct(mean("x").alias("x"), mean("y").alias("y"))


def segment_distance_m(lat: Column, lng: Column, a: Column, b: Column) -> Column:
    """Metres from a point to the segment between two (x: longitude, y: latitude) points, on a plane at the point."""
    kx, ky = F.cos(F.radians(lat)) * (KM_A_DEGREE * 1000), F.lit(KM_A_DEGREE * 1000)
    ax, ay, bx, by = (a["x"] - lng) * kx, (a["y"] - lat) * ky, (b["x"] - lng) * kx, (b["y"] - lat) * ky
    dx, dy = bx - ax, by - ay
    t = F.coalesce(F.try_divide(-(ax * dx + ay * dy), dx * dx + dy * dy), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return F.sqrt(F.pow(ax + t * dx, F.lit(2.0)) + F.pow(ay + t * dy, F.lit(2.0)))


def tile(lat: Column, lng: Column, zoom: int) -> Column:
    """Web-Mercator tile (x, y)."""
    n = float(1 << zoom)
    r = F.radians(lat)
    return F.struct(F.floor((lng + 180) / 360 * n).cast("int").alias("x"), F.floor((1 - F.log(F.tan(r) + 1 / F.cos(r)) / math.pi) / 2 * n).cast("int").alias("y"))


def terrain_m(red: Column, green: Column, blue: Column) -> Column:
    """Elevation that a terrain tile's colour stands for."""
    return red * 256 + green + blue / 256 - 32768


def irish_grid(letter: Column, east: Column, north: Column) -> Column:
    """(x, y) metres of an Irish grid letter and five-digit offsets: the letters run from A, without I, in rows of five from the north-west."""
    at = F.position(F.upper(letter), F.lit("ABCDEFGHJKLMNOPQRSTUVWXYZ"))
    return F.struct((F.pmod(at - 1, F.lit(5)) * 100_000 + east).alias("x"), ((4 - F.floor((at - 1) / 5)) * 100_000 + north).alias("y"))


def grid_letter_irish(east: Column, north: Column) -> Column:
    """Letter and three digits each way of a place on the Irish grid; null outside it."""
    col, row = F.floor((east - 20_000) / 100_000), F.floor(north / 100_000)
    letter = F.substring(F.lit("VWXYZQRSTULMNOPFGHJKABCDE"), ((4 - row) * 5 + col + 1).cast("int"), F.lit(1))
    ref = F.concat(letter, F.format_string("%03d%03d", F.floor(F.pmod(F.floor(east), F.lit(100_000)) / 1000), F.floor(F.pmod(F.floor(north), F.lit(100_000)) / 1000)))
    return F.when((east >= 20_000) & (col <= 4) & (north >= 0) & (row <= 4), ref)


def grid_letters_british(east: Column, north: Column) -> Column:
    """Two letters and three digits each way of a place on the British grid: letters run from A, without I, in rows of five from the north-west; null outside it."""
    e, n = F.floor(east / 100_000), F.floor(north / 100_000)
    first = (19 - n) - F.pmod(19 - n, F.lit(5)) + F.floor((e + 10) / 5)
    second = F.pmod((19 - n) * 5, F.lit(25)) + F.pmod(e, F.lit(5))
    letter = lambda k: F.substring(F.lit("ABCDEFGHJKLMNOPQRSTUVWXYZ"), (k + 1).cast("int"), F.lit(1))
    ref = F.concat(letter(first), letter(second), F.format_string("%03d%03d", F.floor(F.pmod(F.floor(east), F.lit(100_000)) / 100), F.floor(F.pmod(F.floor(north), F.lit(100_000)) / 100)))
    return F.when((east >= 0) & (east < 700_000) & (north >= 0) & (north < 1_300_000), ref)


def polygon_km2(outers: Column, inners: Column, of=spherical_km2) -> Column:
    """Area of a polygon: that of its outer rings less that of its holes."""
    total = lambda rings: F.aggregate(F.coalesce(rings, F.array()), F.lit(0.0), lambda s, r: s + of(r))
    return total(outers) - total(inners)


def padded_box(box: tuple[float, float, float, float], zoom: float) -> tuple[float, float, float, float]:
    """A viewport (south, west, north, east) widened for drawing: by 0.15 of its sides up to zoom 6, 0.10 up to 9, else 0.06."""
    s, w, n, e = box
    pad = 0.15 if zoom <= 6 else 0.10 if zoom <= 9 else 0.06
    return s - (n - s) * pad, w - (e - w) * pad, n + (n - s) * pad, e + (e - w) * pad


def ring_distance_m(lat: Column, lng: Column, ring: Column) -> Column:
    """Metres from a point to the nearest edge of a ring."""
    return F.array_min(F.transform(ring_edges(ring), lambda e: segment_distance_m(lat, lng, e["a"], e["b"])))


def polygon_distance_m(lat: Column, lng: Column, outers: Column, inners: Column) -> Column:
    """Metres from a point to a polygon, 0 inside it."""
    edge = F.array_min(F.transform(F.concat(outers, F.coalesce(inners, F.array())), lambda r: ring_distance_m(lat, lng, r)))
    return F.when(in_polygon(lng, lat, outers, inners), 0.0).otherwise(edge)
