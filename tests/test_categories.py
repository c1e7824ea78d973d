"""Categories that mean one place: a row for each rejection."""

from skeinframe.operators import categories

PREFIXES = ("Musicians from", "Songs about", "Music of")
PLACES = [("skye", "Isle of Skye", 1656.0, None), ("rathlin", "Rathlin Island", 14.0, None), ("china", "China Island", 0.01, None), ("long", "Long Island", 0.5, None), ("ramsey", "Ramsey Island", 2.5, None), ("jersey", "Jersey", 118.0, None), ("malta", "Malta", 0.2, None), ("horse1", "Horse Island", 0.2, None), ("horse2", "Horse Island", 0.3, None), ("horse3", "Horse Island", 0.1, None), ("ait", "Monkey", 0.01, "thames|ait"), ("holy1", "Holy Island", 39.0, None), ("holy2", "Holy Island", 2.0, None), ("holy3", "Holy Island", 1.0, None), ("dogs", "Dogs Island", 5.0, None), ("eire", "Ireland", 7000.0, None), ("none", None, 1.0, None)]
WIDER = [("Long Island", "overseas"), ("Ramsey", "town"), ("Malta", "elsewhere"), ("Jersey", "elsewhere"), ("dogs", "topic"), ("Ireland", "nation"), (None, "town")]
CASES = {
    # category: kept place, or the reasons of what was not
    "Category:Musicians from the Isle of Skye": "skye", "Songs about Skye (island), Scotland": "skye", "Music of Skye by year": "skye", "Songs about Rathlin": "rathlin", "Songs about China Island": "china", "Musicians from Ramsey Island": "ramsey", "Songs about Long Island in Ireland": "long", "Songs about Holy Island": "holy1", "Music of the Thames island of Monkey": None,
    "Songs about Monkey, an ait": None, "Songs about Monkey": {"needs a word"}, "Songs about China": {"a common word"}, "Songs about Long Island": {"overseas"}, "Musicians from Ramsey": {"town"}, "Music of Malta": {"elsewhere"}, "Music of Jersey": {"elsewhere"}, "Songs about Horse Island": {"namesakes"},
    "Songs about dogs": {"topic"}, "Music of Ireland": {"nation"}, "Music of the 1990s": set(), "Albums about Skye": set(), "Songs about Atlantis": set(), "Songs about": set(),
}


def test_each_rejection(spark):
    cats = spark.createDataFrame([(c,) for c in CASES] + [(None,), ("Songs about Rathlin",)], "category string")
    places = spark.createDataFrame(PLACES, "place string, name string, area double, only_with string")
    wider = spark.createDataFrame(WIDER, "name string, kind string")
    judged = {}
    for r in categories.judged_categories(cats, places, wider, PREFIXES).collect():
        judged.setdefault(r.category, set()).add(r.reason)
    got = {r.category: r.place for r in categories.category_places(cats, places, wider, PREFIXES).collect()}
    assert got == {c: w for c, w in CASES.items() if isinstance(w, str)}
    for c, want in CASES.items():
        if isinstance(want, set):
            assert judged.get(c, set()) == want, c
    assert categories.category_places(cats.limit(0), places, wider, PREFIXES).count() == 0
    assert {r.category for r in categories.category_places(cats, places, wider.limit(0), PREFIXES).collect()} >= set(got) - {"Songs about Long Island in Ireland"}
