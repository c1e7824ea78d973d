"""The nearest row by rounds of growing distance, against each pair."""

import math
import random

from skeinframe.operators import imports, joins


def km(a, b):
    h = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371 * math.asin(math.sqrt(min(1.0, h)))


def test_nearest_of_a_crowd(spark, monkeypatch):
    random.seed(3)
    left = [(i, random.uniform(54, 57), random.uniform(-6, -3), i % 2) for i in range(60)] + [(60, 56.9, 2.0, 0), (61, None, 1.0, 1)]
    right = [(1000 + i, random.gauss(55.5, 0.4), random.gauss(-4.5, 0.4), i % 2) for i in range(900)]
    right += [(i + 5000, a, b, k) for i, a, b, k in right[:40]] + [(9000, 56.8, 0.5, 0)]
    l, r = spark.createDataFrame(left, "a int, lat double, lng double, key int"), spark.createDataFrame(right, "b int, lat double, lng double, key int")  # noqa: E741
    met = []
    within = joins.within_km
    monkeypatch.setattr(joins, "within_km", lambda *a: met.append(a[2]) or within(*a))
    for keys in ([], ["key"]):
        want = {}
        for i, a, b, k in left:
            near = min(((km((a, b), (c, d)), j) for j, c, d, q in right if not keys or q == k), default=None) if a is not None else None
            if near and near[0] <= 150:
                want[i] = near[1]
        assert {x.a: x.b for x in joins.nearest(l, r, "a", "b", 150, keys).collect()} == want
    # what is close is looked for first
    assert min(met) < 40
    got = imports.import_duplicates(l.withColumnRenamed("a", "imported"), r.withColumnRenamed("b", "place"), 150)
    assert {x.imported: x.place for x in got.collect()} == want


def test_rows_of_cells_are_not_broadcast(spark):
    a = spark.range(50).selectExpr("id as a", "55.0 + id / 100 as lat", "-4.0 as lng")
    found = joins.within_km(a, a.withColumnRenamed("a", "b"), 5)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() > 50
