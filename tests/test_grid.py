"""Areas on the ellipsoid and places on the British grid against published values."""

import math

import pytest
from pyspark.sql import functions as F

from skeinframe.functions import grid


def one(spark, *columns):
    return spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()


def ring(*points):
    return F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points))


def test_areas_on_the_ellipsoid(spark):
    eighth = ring((0, 0), (90, 0), (90, 90), (0, 90))
    n = 400  # a small circle of 20 km around 57 N, in the metric of the ellipsoid there
    a, b = grid.WGS84
    e2 = 1 - (b / a) ** 2
    s = math.sin(math.radians(57))
    nu, rho = a / math.sqrt(1 - e2 * s * s), a * (1 - e2) / (1 - e2 * s * s) ** 1.5
    circle = ring(*((math.degrees(20_000 * math.cos(2 * math.pi * i / n) / (nu * math.cos(math.radians(57)))), 57 + math.degrees(20_000 * math.sin(2 * math.pi * i / n) / rho)) for i in range(n)))
    got = one(spark, grid.ellipsoid_km2(eighth), grid.ellipsoid_km2(circle), grid.ellipsoid_km2(ring((0, 0), (1, 1))), grid.ellipsoid_km2(ring((0, 50), (0, 51), (1, 51), (1, 50))))
    assert got.c0 == pytest.approx(510_065_621.724 / 8, rel=1e-9)  # the ellipsoid's surface
    assert got.c1 == pytest.approx(math.pi * 400, rel=1e-4)
    assert got.c2 == 0
    assert got.c3 == pytest.approx(7889.5, rel=1e-3)


def test_british_grid(spark):
    # the projection alone, on the grid's datum; then a place on WGS 84 with its published place on the grid
    lat, lng = math.radians(52 + 39 / 60 + 27.2531 / 3600), math.radians(1 + 43 / 60 + 4.5177 / 3600)
    alone = grid.projected(F.lit(lat), F.lit(lng), grid.BRITISH)
    there = grid.grid_place(F.lit(52 + 39 / 60 + 28.8282 / 3600), F.lit(1 + 42 / 60 + 57.8663 / 3600))
    got = one(spark, alone, there, grid.grid_reference(F.lit(52 + 39 / 60 + 28.8282 / 3600), F.lit(1 + 42 / 60 + 57.8663 / 3600)), grid.grid_place(F.lit(None).cast("double"), F.lit(1.0)), grid.grid_reference(F.lit(20.0), F.lit(1.0)))
    assert (got.c0.east, got.c0.north) == (pytest.approx(651409.903, abs=0.002), pytest.approx(313177.270, abs=0.002))
    assert (got.c1.east, got.c1.north) == (pytest.approx(651409.792, abs=5), pytest.approx(313177.448, abs=5))
    assert got.c2 == "TG514131" and got.c3 is None and got.c4 is None
