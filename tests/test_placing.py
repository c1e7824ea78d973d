"""Castles placed by each kind of evidence."""

import pytest

from skeinframe.operators import placing

#: two large places whose circles overlap, islets in the first, a skerry far off
PLACES = [
    ("mull", "Isle of Mull", 875.0, 56.45, -6.0, "Q1"), ("ulva", "Ulva", 20.0, 56.48, -6.2, "Q2"), ("calve", "Calve Island", 1.0, 56.62, -6.04, "Q3"), ("rock", "Sgeir", 0.01, 56.6205, -6.04, None), ("duart", "Duart Islet", 0.02, 56.40, -5.70, "Q5"),
    ("twin", "Twin Holm", 0.02, 56.4015, -5.70, None), ("far", "Far Skerry", 0.5, 58.0, -7.0, "Q6"), ("world", "Mainland", 9000.0, 56.5, -6.0, "Q9"), ("blank", None, None, 57.5, -7.0, None),
]
MULL, CALVE, DUART = (56.45, -6.1), (56.6202, -6.0401), (56.4001, -5.7)
CASES = {
    # record: title, extract, kind, context, place, declared, expected place, reason
    "declared": ("Moy Castle", "Moy Castle is a castle.", "", "", MULL, ["Q7", "Q2", "Q1"], "mull", placing.REASONS[1]),
    "text": ("Moy Castle", "Moy Castle is a ruined castle on the southern shore of the Isle of Mull.", "", "", MULL, [], "mull", placing.REASONS[2]),
    "water": ("Dun Castle", "It is a castle on the Sound of Mull.", "", "", MULL, [], None, "no source names one place"),
    "view": ("Dun Castle", "It is a castle opposite Mull.", "", "", MULL, [], None, "no source names one place"),
    "two": ("Ulva Castle", "It was a castle on Mull. A tower stood on Calve Island.", "", "", CALVE, [], "calve", placing.REASONS[2]),
    "islet": ("Duart Tower Castle", "It is a castle on a small island, on Mull.", "", "", DUART, [], "duart", placing.REASONS[2]),
    "alone": ("Old Castle", "It is a castle on a tiny island.", "", "", (58.0001, -7.0), [], "far", placing.REASONS[4]),
    "title": ("Castle of Mull", "It is a castle.", "", "", MULL, [], "mull", placing.REASONS[3]),
    "small": ("Old Castle", "It is a castle, held long ago. Calve island, it is said.", "", "", CALVE, [], "calve", placing.REASONS[2]),
    "register small": ("Old Castle", "", "", "stands on Calve Island", CALVE, [], "calve", placing.REASONS[4]),
    "too near": ("Old Castle", "It is a castle on an island.", "", "", (56.4007, -5.7), [], None, "no source names one place"),
    "register": ("Old Castle", "It is a castle.", "", "stands on Mull", MULL, [], "mull", placing.REASONS[5]),
    "edge": ("Old Castle", "It is a castle.", "", "stands on Mull", (56.45, -6.36), [], None, "no source names one place"),
    "broch": ("Dun Castle", "Dun Castle is a broch on Mull.", "", "", MULL, ["Q1"], None, "no castle"),
    "house": ("Moy House", "", "tower house", "", MULL, ["Q1"], None, "no castle"),
    "tower": ("Moy", "", "Tower House (ruin)", "", MULL, ["Q1"], "mull", placing.REASONS[1]),
    "entity": ("Q123", "It is a castle.", "", "", MULL, ["Q1"], None, "no castle"),
    "sea": ("Sea Castle", "It is a castle.", "", "", (60.0, -9.0), [], None, "not on a known place"),
    "nowhere": ("Sea Castle", "It is a castle.", "", "", (None, None), [], None, "no coordinates"),
    "smaller": ("Lost Castle", "It is a castle on a tiny islet. It stood on Mull. It stood on Ulva.", "", "", (56.47, -6.18), [], None, "the text puts it on a smaller place"),
}


@pytest.fixture(scope="module")
def placed(spark):
    places = spark.createDataFrame(PLACES, "place string, name string, area double, lat double, lng double, entity string")
    rows = [(k, *c[:4], *c[4], c[5]) for k, c in CASES.items()] + [("none", None, None, None, None, 56.45, -6.1, None)]
    records = spark.createDataFrame([*rows, rows[0]], "record string, title string, extract string, kind string, context string, lat double, lng double, declared array<string>")
    return {r.record: (r.place, r.reason) for r in placing.castle_places(records, places).collect()}


@pytest.mark.parametrize("case", list(CASES))
def test_each_kind_of_evidence(placed, case):
    assert placed[case] == CASES[case][6:]


def test_null_records_and_one_row_each(placed):
    assert placed["none"] == (None, "no castle") and len(placed) == len(CASES) + 1


def test_phrases(spark):
    from pyspark.sql import functions as F

    names = ["Isle of Mull", "Skarva (North Holm)", "Rock", None, "Ynys of Môr", "A+B Isle"]
    got = [sorted(r[0]) for r in spark.createDataFrame([(n,) for n in names], "n string").select(placing.place_phrases(F.col("n"))).collect()]
    assert got == [["isle of mull", "mull"], ["north holm", "skarva", "skarva (north holm)"], [], [], ["ynys of mor"], ["a+b isle"]]


def test_a_crowd_of_places_that_no_text_names_is_not_met(spark, monkeypatch):
    near = [(f"n{i}", f"Other{i}holm", 20.0, 56.45 + i * 1e-5, -6.1, None) for i in range(300)]
    places = spark.createDataFrame([*PLACES, *near], "place string, name string, area double, lat double, lng double, entity string")
    rows = [(f"r{i}", "Old Castle", "It is a castle on the Isle of Mull.", "", "", *MULL, None) for i in range(300)]
    records = spark.createDataFrame(rows, "record string, title string, extract string, kind string, context string, lat double, lng double, declared array<string>")
    met, plain = [], placing.reached
    monkeypatch.setattr(placing, "reached", lambda *a: met.append(plain(*a)) or met[-1])
    got = {(r.place, r.reason) for r in placing.castle_places(records, places).collect()}
    assert got == {("mull", placing.REASONS[2])} and sum(d.count() for d in met) == 1


def test_reach_of_every_size(spark):
    from math import asin, cos, pi, radians, sin, sqrt

    from skeinframe.operators import evidence

    def km(a, b):
        return 2 * 6371.0 * asin(sqrt(sin(radians(b[0] - a[0]) / 2) ** 2 + cos(radians(a[0])) * cos(radians(b[0])) * sin(radians(b[1] - a[1]) / 2) ** 2))

    points = [(i, 50 + i * 0.61 % 3, i * 0.77 % 4 - 2) for i in range(60)]
    sized = [(i, 50 + i * 0.43 % 3, i * 0.91 % 4 - 2, [None, 0.05, 3.0, 60.0, 900.0, 8000.0][i % 6]) for i in range(60)]
    reach = {i: max(0.35, 1.45 * sqrt(a / pi)) if a else 0.4 for i, _, _, a in sized}
    want = {(p[0], q[0]) for p in points for q in sized if km(p[1:], q[1:3]) <= reach[q[0]]}
    p = spark.createDataFrame(points, "pt int, lat double, lng double")
    found = evidence.in_reach(p, spark.createDataFrame(sized, "place int, lat double, lng double, area double"), "pt", "place")
    assert {(r.pt, r.place) for r in found.collect()} == want and len(want) > 100
    wide = spark.createDataFrame([(*q[1:3], reach[q[0]]) for q in sized], "lat double, lng double, reach double")
    assert {r.pt for r in evidence.any_reach(p, wide, "pt", 75.0).collect()} == {a for a, _ in want}
