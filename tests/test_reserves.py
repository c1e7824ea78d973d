"""Reserves and places of one name or near each other, against all pairs."""

import math
import random

from skeinframe.operators import inland, joins


def _km(a, b):
    (p, q), (r, s) = a, b
    h = math.sin(math.radians(r - p) / 2) ** 2 + math.cos(math.radians(p)) * math.cos(math.radians(r)) * math.sin(math.radians(s - q) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(h))


def _want(reserves, places, key, most):
    near = lambda a, b: None not in (*a, *b) and _km(a, b) <= most
    return sorted({(r, p) for r, n, *a in reserves for p, m, *b in places if (key(n) and key(n) == key(m)) or near(a, b)}, key=str)


def _key(name):
    return (name or "").lower().replace("isle of", "").replace("island", "").strip()


def test_a_name_with_many_rows_on_both_sides(spark, monkeypatch):
    monkeypatch.setattr(joins, "LISTED", 3)
    monkeypatch.setattr(joins, "PARTED", 4)
    random.seed(9)
    at = lambda: (50 + random.random(), random.random())
    places = [(i, random.choice(["Tolm", "Isle of Tolm", "tolm Island", "", None, "Hesker"]), *at()) for i in range(60)] + [(60, "Tolm", None, None), (None, "Tolm", *at())]
    reserves = [(i, random.choice(["Tolm", "Isle of Tolm", "Nowhere", None, ""]), *at()) for i in range(40)] + [(40, "Hesker", None, 0.5)]
    r = lambda rows: spark.createDataFrame(rows, "reserve int, name string, lat double, lng double")
    p = lambda rows: spark.createDataFrame(rows, "place int, name string, lat double, lng double")
    found = inland.reserves_of_places(r(reserves), p(places), 20)
    # pairs are not brought together once more
    assert found._jdf.queryExecution().optimizedPlan().nodeName() == "Union"
    assert sorted(map(tuple, found.collect()), key=str) == _want(reserves, places, _key, 20)
    # ids with several rows, and rows that repeat
    places += [(3, "Hesker", *at()), (4, "Tolm", *at()), places[5]]
    reserves += [(7, "Tolm", *at()), (8, "Hesker", *at()), reserves[2]]
    found = inland.reserves_of_places(r(reserves), p(places), 20)
    assert sorted(map(tuple, found.collect()), key=str) == _want(reserves, places, _key, 20)
