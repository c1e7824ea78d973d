"""Functions against hand-computed values, and properties of the measures."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skeinframe.functions import geo, parse, text


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def S(x):
    return F.lit(x).cast("string")


def test_text(spark):
    got = one(
        spark, text.fold(S("Éilean Mòr")), text.search_norm(S("  St. Kilda—Hirta! ")), text.name_key(S("Isle of Mull (north)")), text.simplify(S("Little Bernera Island")),
        text.slugify(S("Inch & Kenneth")), text.slugify(S(None)), text.ascii_slug(S("Ynys Môn / Anglesey")), text.canonical_id(S("way"), F.lit(7), S(None), S("x")),
        text.canonical_id(S(None), F.lit(7), S("Q1"), S("x")), text.clip(S("abcdef"), 4), text.first_sentence(S("One. Two.")), text.escape_pattern(S("a.b")), text.format_minutes(F.lit(125)),
    )
    assert got == ("eilean mor", "st kilda hirta", "mull", "little bernera", "inch-kenneth", "place", "ynys-mon-anglesey", "osm-way-7", "wd-Q1", "abc…", "One.", "a\\.b", "2 h 5 min")


def test_areas_have_the_digits_of_the_number_itself(spark):
    got = one(spark, *(text.format_area(F.lit(x)) for x in (9.0 / 120, 8286.0 / 120, 0.125, 99.96, 1234.5)))
    assert got == tuple(f"{x:.2f} km²" if x < 1 else f"{x:.1f} km²" if x < 100 else f"{x:,.0f} km²" for x in (9.0 / 120, 8286.0 / 120, 0.125, 99.96, 1234.5))


def test_words_end_at_letters_of_other_scripts(spark):
    label = lambda s: text.classify(S(s), [(r"\bund\b", "german")], "other")
    assert one(spark, label("я und да"), label("яund"), label("\u4e2dund\u4e2d"), label("rund"), label("und_")) == ("german", "german", "german", "other", "other")


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [("Mull", None, "unnamed"), ("Isle of Mull", "Mull Island", "exact"), ("Little Mull", "Great Mull", None), ("Hildasay", "Hildasey", "close"), ("Mull", "Iona", None), ("Northbay", "Bay", None), ("Papa Stour Rocks", "Papa Stour", "exact")],
)
def test_name_relation(spark, a, b, want):
    assert one(spark, text.name_relation(S(a), S(b)))[0] == want


def test_words_and_sets(spark):
    got = one(spark, text.whole_word(S("On Coll, not Colla"), S("coll")), text.whole_word(S("Colla"), S("coll")), text.banded_distance(S("abc"), S("xyz")), text.jaccard(F.array(S("a"), S("b")), F.array(S("b"))), text.jaccard(F.array().cast("array<string>"), F.array(S("b"))))
    assert got == (True, False, 3, 0.5, 0.0)


def test_contacts_and_licences(spark):
    got = one(spark, text.has_contact(S("mail a@b.org")), text.has_contact(S("+44 1234 567 890")), text.has_contact(S("year 1999")), text.open_licence(S("CC BY-SA 4.0"), ["cc by"]), text.open_licence(S("unknown"), ["unknown"]), text.strip_html(S("<p>a&amp;b<script>x</script> c</p>")))
    assert got == (True, True, False, True, False, "a&b c")


def test_parse(spark):
    got = one(
        spark, parse.dms(S("57°30'36\"S")), parse.area_km2(S("about 250 ha")), parse.area_km2(S("1,234.5 km²")), parse.population(S("Population: 1,200")), parse.elevation_m(S("400 ft")), parse.elevation_m(S("9000 m")),
        parse.lenient_int(S("..")), parse.lenient_int(S("1,002")), parse.clock_minutes(S("25:10:00")), parse.compact_date(S("20240230")).cast("string"), parse.compact_date(S("20240229")).cast("string"), parse.stale(F.lit(None).cast("date"), F.current_date()),
    )
    assert got == (pytest.approx(-57.51), 2.5, 1234.5, 1200, pytest.approx(121.92), None, None, 1002, 70, None, "2024-02-29", True)


def test_geo(spark):
    ring = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (2, 0), (2, 2), (0, 2))))
    none = F.array().cast("array<array<struct<x:double,y:double>>>")
    got = one(spark, geo.shoelace(ring), geo.in_polygon(F.lit(1.0), F.lit(1.0), F.array(ring), none), geo.in_polygon(F.lit(3.0), F.lit(1.0), F.array(ring), none), geo.in_polygon(F.lit(1.0), F.lit(1.0), F.array(ring), F.array(ring)), geo.equal_area_radius_m(F.lit(math.pi)), geo.terrain_m(F.lit(128), F.lit(10), F.lit(128)))
    assert got == (4.0, True, False, False, pytest.approx(1000), 10.5)
    sphere, plane = one(spark, geo.spherical_km2(ring), geo.planar_km2(ring))
    assert sphere == pytest.approx(plane, rel=0.01)
    assert one(spark, geo.segment_distance_m(F.lit(1.0), F.lit(1.0), F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), F.struct(F.lit(2.0).alias("x"), F.lit(0.0).alias("y"))))[0] == pytest.approx(111_320, rel=1e-3)


point = st.tuples(st.floats(-60, 60), st.floats(-179, 179))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(point, point), min_size=1, max_size=20))
def test_distance_is_a_metric(spark, pairs):
    df = spark.createDataFrame([(*a, *b) for a, b in pairs], "a double, b double, c double, d double")
    c = F.col
    for r in df.select(geo.haversine_km(c("a"), c("b"), c("c"), c("d")).alias("x"), geo.haversine_km(c("c"), c("d"), c("a"), c("b")).alias("y"), geo.haversine_km(c("a"), c("b"), c("a"), c("b")).alias("z")).collect():
        assert r.x == pytest.approx(r.y, abs=1e-6)
        assert r.z == pytest.approx(0, abs=1e-6)
        assert 0 <= r.x <= 20_016
