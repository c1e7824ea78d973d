"""Polygon joins over whole and cut cells, against each pair of a point and a polygon."""

import math
import random

from skeinframe.operators import joins

RING = "array<array<struct<x:double,y:double>>>"


def edges(rings):
    return [(r[i], r[(i + 1) % len(r)]) for r in rings for i in range(len(r))]


def holds(p, outers, inners):
    def ring(r):
        hits = 0
        for a, b in edges([r]):
            if (a[1] > p[1]) != (b[1] > p[1]) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0]:
                hits += 1
        return hits % 2 == 1

    return any(map(ring, outers)) and not any(map(ring, inners))


def metres(p, outers, inners):
    if holds(p, outers, inners):
        return 0.0
    kx, best = math.cos(math.radians(p[1])) * 111320, math.inf
    for a, b in edges(outers + inners):
        ax, ay, bx, by = (a[0] - p[0]) * kx, (a[1] - p[1]) * 111320, (b[0] - p[0]) * kx, (b[1] - p[1]) * 111320
        dx, dy = bx - ax, by - ay
        t = max(0.0, min(1.0, -(ax * dx + ay * dy) / (dx * dx + dy * dy)))
        best = min(best, math.hypot(ax + t * dx, ay + t * dy))
    return best


def blob(x, y, r, n):
    turns = sorted(random.uniform(0, 2 * math.pi) for _ in range(n))
    return [(x + r * math.cos(t), y + r * math.sin(t)) for t in turns]


def frames(spark, shapes, points):
    rings = lambda rs: [[{"x": x, "y": y} for x, y in r] for r in rs]
    polygons = spark.createDataFrame([(i, float(a), rings(o), rings(n)) for i, a, o, n in shapes], f"body int, area double, outers {RING}, inners {RING}")
    return polygons, spark.createDataFrame([(k, y, x) for k, (x, y) in enumerate(points)], "id int, lat double, lng double")


def test_polygon_joins_equal_every_pair(spark):
    random.seed(5)
    shapes = []
    for i in range(40):
        x, y, r = random.uniform(-2, 1), random.uniform(54, 56), random.choice((0.02, 0.3, 1.3))
        outers = [blob(x, y, r, random.randint(3, 9))] + ([blob(x + 0.7, y, r / 2, 5)] if i % 5 == 0 else [])
        shapes.append((i, i % 3, outers, [blob(x, y, r / 4, 6)] if i % 4 == 0 else []))
    shapes += [(100 + i, i % 2, o, n) for i, (_, _, o, n) in enumerate(shapes[:10])]
    points = [(random.uniform(-3, 2), random.uniform(53, 57)) for _ in range(250)] + [(x + 0.01, y) for _, _, o, _ in shapes[:20] for x, y in o[0][:2]]
    polygons, p = frames(spark, shapes, points)
    inside = {(k, i) for k, c in enumerate(points) for i, _, o, n in shapes if holds(c, o, n)}
    assert {(r.id, r.body) for r in joins.points_in_polygons(p, polygons, "body").collect()} == inside
    area = {i: a for i, a, _, _ in shapes}
    want = {k: min((area[i], i) for q, i in inside if q == k)[1] for k in {k for k, _ in inside}}
    assert {r.id: r.body for r in joins.smallest_polygon(p, polygons, "id", "body").collect()} == want
    for most in (500, 20_000):
        near = {k: min((metres(c, o, n), a, i) for i, a, o, n in shapes) for k, c in enumerate(points)}
        got = {r.id: (r.body, round(r.metres, 3)) for r in joins.nearest_polygon(p, polygons, "id", "body", most).collect()}
        assert got == {k: (i, round(m, 3)) for k, (m, _, i) in near.items() if m <= most}
    peaks = {r.body: sorted(r.points) for r in joins.polygon_points(polygons, p.selectExpr("*", "double(id % 7) as height"), "body", "id", "height").collect()}
    assert peaks == {i: sorted(k for k, j in inside if j == i) for i in {i for _, i in inside}}


def test_whole_cells_stand_for_their_points(spark):
    # 30 squares over one another: inner cells are theirs as a whole, so only parts at their edges are to be tested
    square = lambda d: [[(-1 - d, 54 - d), (1 + d, 54 - d), (1 + d, 56 + d), (-1 - d, 56 + d)]]
    polygons, _ = frames(spark, [(i, 1.0, square((i + 1) / 1000), []) for i in range(30)], [(0.0, 0.0)])
    whole, cut, _ = joins.shape_cells(polygons, ["body"])
    assert whole.count() == 30 * 16
    assert cut.filter("not _all").count() <= 30 * 4 * 45
