"""Distance joins near the poles and across the date line, fuzzy names, picks and parsing of sources."""

import math
import random

from pyspark.sql import functions as F

from skeinframe.functions import text
from skeinframe.operators import ferries, joins, merge, topk
from skeinframe.sources import readers


def km(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, h)))


def test_pairs_anywhere_on_the_globe_equal_brute_force(spark):
    random.seed(3)
    spots = [(random.uniform(-90, 90), random.uniform(-180, 180)) for _ in range(150)]
    spots += [(64.0, 10.0), (64.0004, 10.0), (89.99, 0.0), (89.99, 180.0), (-90.0, 5.0), (-89.9, 100.0), (10.0, 179.99), (10.0, -179.99), (0.0, 0.0), (0.0, 360.0)]
    spots += [(a + random.uniform(-0.5, 0.5), o + random.uniform(-1, 1)) for a, o in spots[:80] if abs(a) < 89]
    df = spark.createDataFrame([(i, float(a), float(o)) for i, (a, o) in enumerate(spots)] + [(9999, None, 1.0)], "id int, lat double, lng double")
    for most in (0.2, 60.0, 900.0):
        got = {(r.a, r.b) for r in joins.proximity_pairs(df, "id", most).collect()}
        assert got == {(i, j) for j in range(len(spots)) for i in range(j) if km(spots[i], spots[j]) <= most}


def test_fuzzy_tier_of_names(spark):
    left = spark.createDataFrame([(1, "n", "great skarvo"), (2, "n", "xx"), (3, "m", "great skarvo")], "id int, nation string, key string")
    right = spark.createDataFrame([(10, "n", "great skarva"), (11, "n", "great scarp")], "rid int, nation string, key string")
    assert [tuple(r) for r in joins.name_cascade(left, right, "id", "rid").collect()] == [(1, 10, "fuzzy")]


def test_keys_with_accents_and_templates(spark):
    r = spark.range(1).select(text.name_key(F.lit("Oileán Mór")).alias("a"), text.name_key(F.lit("Oiléan Beag (South)")).alias("b"), text.coordinate_template(F.lit("57|30|15|S|6|15|0|E")).alias("c")).first()
    assert (r.a, r.b) == ("mór", "beag") and (round(r.c.lat, 5), r.c.lng) == (-57.50417, 6.25)


def test_picks_and_rings_of_routes(spark):
    df = spark.range(10)
    assert topk.weekly_pick(df, F.lit(13 * 604800), "id").first().id == 3
    assert topk.random_pick(df, df, "id", 0, 0.0, "id").first().id == 1
    nodes = "array<struct<ref:bigint,lat:double,lng:double>>"
    e = spark.createDataFrame([("way", 5, {"route": "ferry", "name": "A", "motor_vehicle": "no"}, [(1, 57.0, -6.0), (2, 57.1, -6.1)]), ("way", 6, {"route": "road"}, [(1, 57.0, -6.0), (2, 57.1, -6.1)])], f"type string, id long, tags map<string,string>, nodes {nodes}")
    routes, stops = ferries.parse_ferries(e)
    assert [(r.route, r.kind) for r in routes.collect()] == [("osm-way-5", "foot-only")]
    assert sorted((r.end, r.node) for r in stops.collect()) == [("end", 2), ("start", 1)]


def test_promotion_leaves_the_old_table_if_a_test_fails(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    merge.promote(spark.range(3), path, [("some", F.col("id") >= 0)])
    try:
        merge.promote(spark.range(9), path, [("small", F.col("id") < 5)])
        raise AssertionError
    except ValueError:
        assert merge.promoted(spark, path).count() == 3
    assert readers.percent is not None
