"""What sentences ask for, and from a sentence to its answer."""

import pytest
from pyspark.sql import functions as F

from skeinframe.functions import sentences as s
from skeinframe.plans import asking

CASES = {
    "islands in northern ireland": {"nations": ["Northern Ireland"]},
    "irish islands and northern ireland": {"nations": ["Northern Ireland", "Ireland"]},
    "where is highland park": {"nations": []},
    "islands in the highlands": {"nations": ["Scotland"]},
    "islands in Loch Lomond": {"water": "loch lomond", "types": []},
    "river islands": {"water": None, "types": ["river"]},
    "Islands near Oban with photos": {"near": "oban", "near_km": 100.0, "photo": True, "features": ["photo"]},
    "Largest sea islands in Wales": {"sort": "area", "descending": True, "types": ["sea"], "nations": ["Wales"]},
    "Tidal islands in England": {"features": ["tidal"], "nations": ["England"]},
    "Scottish islands with mountains": {"features": ["mountain"], "nations": ["Scotland"]},
    "How many uninhabited islands in Scotland?": {"features": ["uninhabited"]},
    "How many crannogs are there in Ireland?": {"subtypes": ["crannog"]},
    "islands in the Hebrides": {"archipelagos": ["Inner Hebrides", "Outer Hebrides"]},
    "islands in the Western Isles": {"archipelagos": ["Outer Hebrides"]},
    "Give me five islands in Orkney": {"recommend": True, "recommend_n": 5, "types": ["sea"]},
    "Best islands": {"recommend": True, "recommend_n": None},
    "islands over 12.5 km² but under 300 sq km": {"min_area": 12.5, "max_area": 300.0},
    "big islands within 20 miles of the Port Ellen": {"min_area": 10.0, "near": "port ellen", "near_km": 20 * 1.60934},
    "car ferries from Mallaig to Rum": {"ferry": True, "ferry_kind": "car-and-foot", "ferry_port": "mallaig"},
    "CalMac winter sailings": {"ferry": True, "ferry_operator": "calmac", "ferry_season": "year-round"},
    "islands near Scotland": {"near": None},
    "Belle Isle": {"words": ["belle", "isle"], "ferry": False, "recommend": False},
    "ÉIRE islands, confirmed only": {"nations": ["Ireland"], "sure": True},
}


def test_facets_of_sentences(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(CASES)] + [(99, None)], "id int, q string")
    rows = {r.id: r for r in s.with_facets(df, "q").collect()}
    for i, (sentence, want) in enumerate(CASES.items()):
        assert {k: rows[i][k] for k in want} == want, sentence
    assert not rows[99].nations and not rows[99].ferry and rows[99].near is None and not rows[99].words


def test_tags_and_own_dictionaries(spark):
    own = s.Dictionaries(nations={"Atlantis": ("atlantis",)}, tags={"music": ("song", "folk music")})
    row = s.with_facets(spark.createDataFrame([("songs of Atlantis, not of Scotland",)], "q string"), "q", own).first()
    assert row.nations == ["Atlantis"] and row.tags == ["music"] and "scotland" in row.words


def test_near_places(spark):
    g = spark.createDataFrame([("Port Ellen", 1.0, 2.0), ("Port Askaig", 3.0, 4.0), ("Oban", 5.0, 6.0), ("Obanbeg", 7.0, 8.0), ("Tobermory", 9.0, 1.0), ("Uig", 1.0, 1.0)], "place string, lat double, lng double")
    df = spark.createDataFrame([(1, "oban"), (2, "port"), (3, "tober"), (4, "tob"), (5, None), (6, "port e"), (7, "uig")], "n int, near string")
    assert {r.n: r.place for r in s.near_places(df, "n", g).collect()} == {1: "Oban", 3: "Tobermory", 6: "Port Ellen", 7: "Uig"}


PLACE = "id int, name string, nation string, type string, subtype string, archipelago string, area double, population int, has_photo boolean, elevation double, source string, confidence string, water string, lat double, lng double, tags array<string>, description string, wikipedia string, ferry boolean, ferry_n int, ferry_kinds array<string>, ferry_seasons array<string>, ferry_operators array<string>, ferry_ports array<string>, tidal boolean, for_sale boolean"


@pytest.fixture(scope="module")
def places(spark):
    base = {"nation": "Scotland", "type": "sea", "area": 1.0, "has_photo": False, "source": "osm", "lat": 56.4, "lng": -5.6, "tags": [], "ferry": False, "ferry_n": 0, "ferry_kinds": [], "ferry_seasons": [], "ferry_operators": [], "ferry_ports": [], "tidal": False, "for_sale": False}
    rows = [
        {"id": 1, "name": "Isle of Skye", "area": 1656.0, "population": 10000, "description": "A castle keep and puffins.", "ferry": True, "ferry_n": 2, "ferry_kinds": ["car-and-foot"], "ferry_ports": ["Mallaig"], "lat": 57.3, "lng": -6.2, "has_photo": True},
        {"id": 2, "name": "Kerrera", "area": 12.0, "population": 40, "description": "A ruined castle.", "has_photo": True}, {"id": 3, "name": "Inchcailloch", "type": "lake", "water": "Loch Lomond", "area": 0.5}, {"id": 4, "name": "Skarva", "area": 3.0, "lat": 58.0, "lng": -7.0, "elevation": 700.0},
        {"id": 5, "name": "Bardsey", "nation": "Wales", "description": "Seals and a lighthouse.", "lat": 52.7, "lng": -4.8},
    ]
    return spark.createDataFrame([tuple((base | r).get(c.split(" ")[0]) for c in PLACE.split(", ")) for r in rows], PLACE).cache()


def hay():
    return F.concat_ws(" ", "name", "archipelago", "description", "water")


@pytest.mark.parametrize(
    ("sentence", "want"),
    [
        ("Islands with a castle near Oban", [2]), ("Scottish islands with puffins", [1]), ("Scottish islands with mountains", [4]), ("islands in Loch Lomond", [3]), ("Largest sea islands in Scotland", [1, 2]), ("car ferries from Mallaig", [1]), ("Skie", [1]), ("Welsh islands with a beacon", [5]),
        ("islands near Skarva with a castle", []), ("lighthouse islands in Wales", [5]), ("islands near Skye", []), ("castle islands within 300 km of Skye", [2]),
    ],
)
def test_answers(places, sentence, want):
    got = [r.id for r in asking.answered(places, sentence, hay()).collect()]
    assert got[: len(want)] == want and (want or not got)


def test_places_that_a_sentence_is_near_to(places):
    assert asking.asked(places, "islands near Oban").near == (56.4153, -5.4747, 100.0, None)
    assert asking.asked(places, "castles near the isle of Skye").near == (57.3, -6.2, 100.0, 1)
    assert asking.asked(places, "islands near obn?").suggestions == ("Oban",)
    assert asking.asked(places, "islands near port").suggestions == ("Port Askaig", "Port Ellen", "Portree")
    assert asking.place_named(places, "is").count() == 0


def test_broad_questions_are_refused(places):
    for sentence in ("islands in Scotland", "Scottish sea islands", "islands"):
        with pytest.raises(ValueError):
            asking.answered(places, sentence, hay())
