"""Walks in order that take what nothing taken before conflicts with, against the plain walk."""

import random

from skeinframe.operators import graph, imports


def plain(edges):
    nodes, lost = sorted({x for e in edges for x in e}), set()
    for n in nodes:
        if any(u == n and v not in lost for u, v in edges):
            lost.add(n)
    return lost


def test_first_come_equals_the_plain_walk(spark):
    random.seed(8)
    edges = [(b, a) for a, b in (sorted(random.sample(range(60), 2)) for _ in range(90))] + [(100 + i + 1, 100 + i) for i in range(9)] + [(300, k) for k in range(200, 240)]
    df = spark.createDataFrame([*edges, *edges[:5], (7, 7), (None, 4)], "u long, v long")
    assert {r.node for r in graph.first_come(df).collect()} == plain(edges)
    assert graph.first_come(df.limit(0)).count() == 0


def test_a_chain_of_candidates(spark):
    kinds = "candidate int, name string, lat double, lng double, map_type string, map_id long, entity string, review boolean"
    rows = [(i, "Orran" if i < 8 else "Tolm", 56.0 + 0.00396 * i, -6.0, None, None, None, i == 2) for i in range(10)]
    places = spark.createDataFrame([], "place int, name string, lat double, lng double, map_type string, map_id long, entity string, source string")
    c = spark.createDataFrame(rows, kinds)
    got = lambda **k: {r.candidate: r.outcome for r in imports.site_update(c, places, c.limit(0), **k).collect()}
    # 0.44 km apart: each is compared with those that were added, not with all before it
    assert got() == {i: {2: "needs review"}.get(i, "added" if i in (0, 3, 5, 7, 8) else "duplicate") for i in range(10)}
    assert got(include_uncertain=True) == {i: {2: "added unconfirmed"}.get(i, "added" if i % 2 == 0 else "duplicate") for i in range(10)}
