"""Duplicate resolution, evidence, interest scores and grouped functions."""

import pytest
from pyspark.sql import functions as F

from skeinframe.functions.geo import shoelace
from skeinframe.functions.grouped import assemble_rings
from skeinframe.operators import evidence, interest, resolve

PLACE = "id string, name string, nation string, area double, map_type string, map_id long, parent string, lat double, lng double, curated boolean, wikidata string, wikipedia string, has_photo boolean, source string, description string"


def place(id, name, lat, lng, area=None, **more):
    row = {"id": id, "name": name, "nation": "Scotland", "area": area, "lat": lat, "lng": lng} | more
    return tuple(row.get(c.split(" ")[0]) for c in PLACE.split(", "))


def test_duplicates_are_found_kept_and_aliased(spark):
    df = spark.createDataFrame(
        [
            place("a", "Mull", 56.0, -6.0, 1.0), place("b", "Isle of Mull", 56.0005, -6.0, 1.1, wikidata="Q1"), place("c", "Iona", 56.0003, -6.0, 1.05), place("d", "Coll", 57.0, -6.0), place("e", "Coll", 57.0002, -6.0, 0.01),
            place("f", "Little Coll", 57.0002, -6.0, 0.5), place("g", None, 58.0, -6.0, 2.0, map_type="way", map_id=7), place("h", "Far", 58.003, -6.0, 9.0, map_type="way", map_id=7),
        ],
        PLACE,
    )
    got = {(r.u, r.v): r.reason for r in resolve.duplicate_pairs(df).collect()}
    assert got == {("a", "b"): "same-name", ("d", "e"): "point-and-outline", ("g", "h"): "same-osm-object"}
    stay, gone = resolve.resolve(df)
    assert {(r.old, r.new) for r in gone.collect()} == {("a", "b"), ("d", "e"), ("g", "h")}
    assert "c" in {r.id for r in stay.collect()}


def test_location_sentences(spark):
    name = F.lit("Jura")
    says = lambda s: spark.range(1).select(evidence.location_sentence(F.lit(s), name)).first()[0]
    assert says("He wrote it on Jura.")
    assert says("A house. On the Isle of Jura, opposite Jura pier.")
    assert not says("The hotel lies opposite Jura.")
    assert not says("He liked Juran wine.")
    assert spark.range(1).select(evidence.mentions(F.lit("isle of jura festival"), name)).first()[0]


def test_reach_by_size(spark):
    pts = spark.createDataFrame([(1, 56.0, -6.0)], "pt int, lat double, lng double")
    places = spark.createDataFrame([("big", 56.1, -6.0, 300.0), ("tiny", 56.0, -6.004, 0.001), ("none", 56.01, -6.0, None)], "place string, lat double, lng double, area double")
    assert {r.place for r in evidence.in_reach(pts, places, "pt", "place").collect()} == {"big", "tiny"}


def test_first_evidence_and_agreement(spark):
    df = lambda rows: spark.createDataFrame(rows, "item int, place string")
    got = {r.item: (r.place, r.reason) for r in evidence.first_evidence([("declared", df([(1, "a")])), ("named", df([(1, "b"), (2, "c"), (3, "d"), (3, "e")]))], "item", "place").collect()}
    assert got == {1: ("a", "declared"), 2: ("c", "named")}
    phrases = spark.createDataFrame([(1, "mull", "m"), (1, "isle of mull", "m"), (2, "bute", "b"), (2, "holy", "h"), (3, "holy", "h")], "item int, phrase string, place string")
    denied = spark.createDataFrame([("holy",)], "phrase string")
    assert {tuple(r) for r in evidence.one_place_only(phrases, denied, "item", "phrase", "place").select("item", "place", "phrase").collect()} == {(1, "m", "isle of mull"), (2, "b", "bute")}


def test_longest_alias(spark):
    t = spark.createDataFrame([(1, "Calvan Ferries to Orran"), (2, "nobody")], "id int, body string")
    a = spark.createDataFrame([("calvan", "c"), ("Calvan Ferries", "cf")], "alias string, owner string")
    assert {r.id: r.owner for r in evidence.longest_alias(t, a, "id", "body").collect()} == {1: "cf"}


def test_interest_scores(spark):
    rows = [(1, "a", "unusual-news", "King crowned", "", None, "subject"), (2, "a", "unusual-news", "plain", "", None, None), (3, "a", "island-books", "x", "a novel", None, None), (4, "b", "film-art-music", "in the musicbrainz area", "", "film", None)]
    items = spark.createDataFrame(rows, "item int, place string, slug string, title string, summary string, facet string, picture string")
    places = spark.createDataFrame([("a", "Ay", "sea", 1.0, 5, None, True), ("b", "Bee", "sea", 9000.0, None, None, False), ("c", "", "lake", None, None, None, False)], "place string, name string, type string, area double, population int, elevation double, has_image boolean")
    got = {(r.place, r.slug): r.score for r in interest.place_scores(items, places).collect()}
    assert got == {("a", "unusual-news"): pytest.approx(36.75), ("a", "island-books"): pytest.approx(3.07), ("b", "film-art-music"): pytest.approx(1.0)}
    rank = {r.place: r.score for r in interest.atlas_ranking(items, places).collect()}
    assert rank["a"] == pytest.approx(36.75 / 48 * 18 + 0.08 * 3.07 / 24 * 18 + 3)
    assert rank["b"] == pytest.approx(-50 + 1 / 32 * 18 - 3)
    assert rank["c"] == pytest.approx(-3)


def test_rings(spark):
    seg = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    df = spark.createDataFrame([("a", 0, seg((0, 0), (1, 0))), ("a", 1, seg((1, 1), (1, 0))), ("a", 2, seg((1, 1), (0, 1), (0, 0))), ("a", 3, seg((5, 5), (6, 6)))], "k string, ord int, segment array<struct<x:double,y:double>>")
    rows = assemble_rings(df, "k").select(shoelace(F.col("ring")).alias("area")).collect()
    assert [r.area for r in rows] == [1.0]


def test_only_titles_of_offers_are_collected(spark):
    """Titles of other items were collected for each place and interest, and none of them was looked at."""
    items = spark.createDataFrame([(1, 1, "for-sale", "whole island", "", None, None), (2, 1, "unusual-news", "fire", "", None, None)], "item int, place int, slug string, title string, summary string, facet string, picture string")
    places = spark.createDataFrame([(1, "Muck", "island", 1.0, 10, 5.0, True)], "place int, name string, type string, area double, population int, elevation double, has_image boolean")
    plan = interest.place_scores(items, places)._jdf.queryExecution().optimizedPlan().toString()
    collected = [x for x in plan.split("collect_list")[1:]]
    assert collected and all(x.startswith("(CASE WHEN") or x.startswith("(if") for x in collected)
