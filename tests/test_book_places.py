"""Settings of books: one case a rule."""

import pytest

from skeinframe.operators import placing

PLACES = [("jura", 367.0, ["Inner Hebrides"], "Q1", True), ("iona", 8.8, [], "Q2", True), ("sark", 5.0, ["Channel Islands"], "Q3", False), ("sark2", 0.2, ["Donegal"], "Q4", False), ("westray", 47.0, [], "Q5", False), ("papa", 9.0, [], "Q6", False), ("aran", 22.0, ["Donegal"], "Q7", False), ("group", 46.0, [], "Q8", False), ("holm", None, [], "Q9", False), ("holm2", 1.0, [], "Q10", False), ("twin", 2.0, [], "Q11", True), ("twin2", 2.0, [], "Q11", False)]
ALIASES = [("Jura", "jura", None, None), ("Iona", "iona", None, None), ("Sark", "sark", None, None), ("Sark", "sark2", None, None), ("Westray", "westray", None, None), ("Papa Westray", "papa", None, None), ("Aran", "aran", None, "aran islands"), ("Aran Islands", "group", True, None), ("Inishmaan", "iona", None, None), ("Holm", "holm", None, None), ("Holm", "holm2", None, None), ("Twin", "twin", None, None), ("Twin", "twin2", None, None), (None, "jura", None, None), ("Jura", "jura", None, None)]
CASES = {
    "A novel set on the remote isle of Jura.": "jura", "It takes place mainly on the rocky and small Jura.": "jura", "She was marooned on Iona for a year.": "iona", "A memoir of her childhood on Iona.": "iona", "He grew up on Jura.": "jura", "An account of his visit to the Isle of Jura": "jura",
    "She sails to the island of Iona.": "iona", "Iona is, in this and other books, the setting.": "iona", "The setting, as so often, is Jura": "jura", "Jurassic beasts set on nothing": None, "A book on the birds of Jura.": None, "Comparisons with a book set on Jura were made.": None,
    "He used to live on Jura, and it is set on Jura.": None, "A fictional rock, set on Jura": None, "Inspired by a voyage to the isle of Jura.": None, "Inspired by a song, it is set on Jura.": "jura", "A poem dedicated to the isle of Jura": None, "A letter to the isle of Jura": "jura",
    # the longer name, by three letters and more; names of 8 letters anywhere in a sentence with a setting
    "It is set on Papa Westray.": "papa", "A tale set on a cold shore, where Papa Westray ends.": "papa", "A tale set on a cold shore, where Jura ends.": None,
    # a group gives way; a phrase in which a name means something else
    "It is set on Inishmaan in the Aran Islands, the setting.": "iona", "It is set on Aran.": "aran", "It is set in the Aran Islands.": "group",
    # one name, several places: context, size, an area at all, one entity
    "It is set on Sark in Donegal.": "sark2", "It is set on Sark.": "sark", "It is set on Holm.": "holm2", "It is set on Twin.": "twin", "It is set on Jura and the setting is Iona.": "jura",
}


def test_settings(spark):
    docs = spark.createDataFrame([(i, c, None) for i, c in enumerate(CASES)] + [(900, None, None), (901, "Set on Jura. It rains.\nHe grew up on Iona!", None), (902, "It is set on Sark.", "sark2")], "doc int, body string, hint string")
    aliases = spark.createDataFrame(ALIASES, "alias string, place string, is_group boolean, not_in string")
    places = spark.createDataFrame(PLACES, "place string, area double, context array<string>, entity string, curated boolean")
    got = {}
    for r in placing.book_places(docs, aliases, places).collect():
        got.setdefault(r.doc, {})[r.n] = r.place
    for i, (sentence, want) in enumerate(CASES.items()):
        assert got.get(i, {}).get(0) == want, sentence
    assert 900 not in got and got[901] == {0: "jura", 2: "iona"} and got[902] == {0: "sark2"}
    assert placing.book_places(docs.limit(0), aliases, places).count() == 0
    assert placing.book_places(docs, aliases.limit(0), places).count() == 0
