"""What sentences ask for, as columns (survey Q-01 to Q-04): facets by dictionaries, and by patterns sizes, places, ferries, orders and what is left as search words.

All is done by expressions over a table of sentences, so a log of questions is read as one question is.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import fold

# The dictionaries of questions. Nations in order of precedence
NATIONS = {
    "Northern Ireland": ("northern ireland",),
    "Crown Dependency": ("crown dependency", "isle of man", "manx", "jersey", "guernsey", "channel islands", "channel isle"),
    "Scotland": ("scotland", "scottish", "scots", "alba", "caledonia"),
    "England": ("england", "english", "cornwall"),
    "Wales": ("wales", "welsh", "cymru", "cymraeg"),
    "Ireland": ("republic of ireland", "ireland", "irish", "eire"),
}
TYPES = {
    "sea": ("sea", "coastal", "offshore", "ocean", "atlantic", "saltwater", "salt water"),
    "lake": ("lake", "loch", "lough", "tarn", "reservoir", "mere", "llyn"),
    "river": ("river", "fluvial", "stream"),
}
SUBTYPES = {
    "reservoir": ("reservoir", "reservoirs"),
    "canal": ("canal", "canals"),
    "estuary": ("estuary", "estuarine", "estuaries"),
    "crannog": ("crannog", "crannogs", "artificial island", "artificial islands"),
    "oxbow": ("oxbow", "oxbows"),
}
ARCHIPELAGOS = {
    "Inner Hebrides": ("inner hebrides",),
    "Outer Hebrides": ("outer hebrides", "western isles"),
    "Orkney": ("orkney", "orcadian"),
    "Shetland": ("shetland", "shetlandic", "zetland"),
    "Isles of Scilly": ("scilly", "scillonian"),
    "Aran Islands": ("aran islands", "arainn"),
    "Channel Islands": ("channel islands",),
}
FEATURES = {
    "mountain": ("mountain", "mountains", "mountainous", "peak", "peaks", "summit", "summits", "munro", "munros", "corbett", "sgurr", "beinn", "ben ", "ridge", "cuillin"),
    "hill": ("hill", "hills", "hilltop", "fell", "moor", "moorland"),
    "castle": ("castle", "fortress", "tower house", "keep"),
    "abbey": ("abbey", "priory", "monastery", "monastic", "convent", "nunnery"),
    "broch": ("broch", "hillfort", "iron age"),
    "ferry": ("ferry", "ferries", "calmac", "passenger boat", "ferry-accessible", "ferry accessible", "ferry served", "ferry islands"),
    "photo": ("photo", "photos", "photograph", "photographs", "pictured", "with image", "has a photo", "has photo", "with photos"),
    "bridge": ("bridge",),
    "causeway": ("causeway", "tidal road", "walk across"),
    "lighthouse": ("lighthouse", "beacon"),
    "wildlife": ("wildlife", "birds", "bird", "seabird", "seabirds", "puffin", "puffins", "gannet", "gannets", "seal", "seals", "deer", "sea eagle", "white-tailed eagle", "rspb", "nature reserve"),
    "whisky": ("whisky", "whiskey", "distillery", "distilleries", "malt"),
    "beach": ("beach", "beaches", "sand", "sandy"),
    "tidal": ("tidal",),
    "uninhabited": ("uninhabited", "empty", "deserted", "abandoned", "no one", "no one lives", "nobody", "no inhabitants"),
    "inhabited": ("inhabited", "populated", "people live", "village", "villages", "community", "town", "city"),
    "walkable": ("walkable", "you can walk", "walk to"),
    "remote": ("remote", "isolated", "far", "lonely", "outermost"),
    "forsale": ("for sale", "on the market", "buy", "buying", "property", "listing", "listings", "estate agent", "for-sale"),
}
SORTS = {"largest": ("area", True), "biggest": ("area", True), "smallest": ("area", False), "tiniest": ("area", False), "most populous": ("population", True), "most populated": ("population", True), "highest": ("elevation", True), "tallest": ("elevation", True)}
OPERATORS = ("calmac", "northlink", "pentland", "wightlink", "red funnel", "hovertravel", "scillonian", "lundy", "steam packet", "condor", "stena", "irish ferries", "p&o", "dfds", "brittany", "rathlin", "aran", "doolin", "cape clear", "tory", "sark", "manche iles")
NUMBERS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve")
FILLERS = (
    "island", "islands", "show", "me", "the", "a", "an", "with", "and", "in", "of", "to", "for", "find", "i", "want", "you", "have", "are", "is", "that", "where", "which", "what", "any", "some", "all", "near", "off", "on", "from",
    "worth", "visiting", "visit", "worthwhile", "recommend", "recommendation", "recommendations", "suggestion", "suggestions", "beautiful", "famous", "interesting", "picks", "seeing", "hebrides", "hebridean", "highland", "highlands",
)
#: Places that questions name, with latitude and longitude.
PLACES = {
    "London": (51.5074, -0.1278), "Edinburgh": (55.9533, -3.1883), "Glasgow": (55.8642, -4.2518), "Aberdeen": (57.1497, -2.0943), "Inverness": (57.4778, -4.2247), "Oban": (56.4153, -5.4747), "Mallaig": (57.008, -5.829), "Ullapool": (57.895, -5.1622),
    "Stornoway": (58.209, -6.387), "Cardiff": (51.4816, -3.1791), "Holyhead": (53.3092, -4.6296), "Liverpool": (53.4084, -2.9916), "Belfast": (54.5973, -5.9301), "Derry": (54.9966, -7.3086), "Dublin": (53.3498, -6.2603), "Galway": (53.2707, -9.0568),
    "Cork": (51.8985, -8.4756), "Limerick": (52.6638, -8.6267), "Newcastle": (54.9783, -1.6178), "Plymouth": (50.3755, -4.1427), "Bristol": (51.4545, -2.5879), "Manchester": (53.4808, -2.2426), "Penzance": (50.1186, -5.5373), "Portsmouth": (50.8198, -1.088),
    "Southampton": (50.9097, -1.4044), "Douglas": (54.1509, -4.4854), "St Helier": (49.1903, -2.1093), "St Peter Port": (49.4555, -2.5368), "Kirkwall": (58.981, -2.961), "Lerwick": (60.1551, -1.1469), "Tobermory": (56.623, -6.069), "Portree": (57.412, -6.194),
    "Stromness": (58.965, -3.296), "Rothesay": (55.836, -5.056), "Tarbert": (55.866, -5.406), "Fishguard": (51.994, -4.976), "Pembroke": (51.675, -4.919), "Tralee": (52.271, -9.703), "Larne": (54.850, -5.816), "Campbeltown": (55.424, -5.604),
    "Uig": (57.586, -6.376), "Armadale": (57.064, -5.896), "Kyle of Lochalsh": (57.282, -5.713), "Scrabster": (58.611, -3.546), "Doolin": (53.016, -9.378), "Caernarfon": (53.139, -4.273), "Stranraer": (54.904, -5.027), "Ardrossan": (55.643, -4.82),
    "Kennacraig": (55.806, -5.488), "Craignure": (56.47, -5.697), "Fionnphort": (56.325, -6.369), "Leverburgh": (57.766, -7.026), "Sconser": (57.315, -6.11), "Port Askaig": (55.848, -6.107), "Port Ellen": (55.628, -6.19),
}
#: What is no place to be near to.
NOT_NEAR = r"^(?:scotland|england|wales|ireland|northern ireland|republic of ireland|crown dependency|(?:inner |outer )?(?:hebrides|orkney|shetland|scilly|channel islands))$"
STOP_AT = r"(?:\s+(?:and|with|that|which|in|on)\b|$)"
_NUMBER = r"(\d+|" + "|".join(NUMBERS) + ")"
PATTERNS = {
    "water": r"\b(?:in|on|around|of|from)\s+((?:loch|lough|lake|llyn|river)\s+[a-z][a-z'-]{1,24}(?:\s+[a-z][a-z'-]{1,24}){0,2})",
    "ferry": r"\b(?:ferry|ferries|sailings?|boat to|ferry from|ferry to|ferry route)\b|\bferry[- ]?(?:accessible|access|served)\b|\bferry\s+islands?\b",
    "by car": r"\b(?:car ferr|car-and-foot|vehicle ferry)", "on foot": r"\b(?:foot ferr|passenger ferr|foot-only|pedestrian ferry)", "in summer": r"\b(?:summer ferr|summer only|summer sailings)", "all year": r"\b(?:year-round|all year|winter ferry|winter sailings?)",
    "port": r"(?:ferry|ferries|sailings?|boat)s?\s+from\s+([a-z' -]{3,40}?)(?:\s+(?:to|and|with|that|in|on)\b|$)",
    "recommend": r"\b(?:worth\s+visiting|worth\s+a\s+visit|nice\s+to\s+visit|good\s+to\s+visit|places?\s+to\s+visit|must-?see|must\s+see|recommend(?:ations?)?|suggested\s+islands?|best\s+islands?|top\s+islands?|famous\s+islands?|great\s+islands?|interesting\s+islands?)\b",
    "smaller": r"(?:smaller|less than|under)\s+(\d+(?:\.\d+)?)\s*(?:km2|sq km|square km|km)", "larger": r"(?:larger|bigger|more than|over)\s+(\d+(?:\.\d+)?)\s*(?:km2|sq km|square km|km)", "large": r"\b(?:large|big)\s+islands?\b",
    "photo": r"\bphotos?\b|\bpictured\b", "elevation": r"\belevation\b|\bhigh\s+point\b|\bhas\s+a\s+summit\b", "curated": r"\bcurated\s+only\b|\bcanonical\s+islands?\b", "sure": r"\bhide\s+unconfirmed\b|\bconfirmed\s+only\b|\bno\s+unconfirmed\b",
    "within": r"within\s+(\d+(?:\.\d+)?)\s*(km|miles?|mi)\s+of\s+(.+?)" + STOP_AT, "near": r"(?:near|off|around|close to)\s+(.+?)" + STOP_AT,
}
COUNTS = (rf"\b{_NUMBER}\s+islands?\b", rf"\b(?:give|list|name|pick|tell)\s+(?:me\s+)?{_NUMBER}\b", rf"\b(?:top|best)\s+{_NUMBER}\b")
LARGE_KM2, NEAR_KM, KM_A_MILE = 10.0, 100.0, 1.60934


@dataclass
class Dictionaries:
    """The words by which questions name facets; tags: id to its synonyms, in lower case."""

    nations: Mapping[str, Sequence[str]] = field(default_factory=lambda: NATIONS)
    types: Mapping[str, Sequence[str]] = field(default_factory=lambda: TYPES)
    subtypes: Mapping[str, Sequence[str]] = field(default_factory=lambda: SUBTYPES)
    archipelagos: Mapping[str, Sequence[str]] = field(default_factory=lambda: ARCHIPELAGOS)
    features: Mapping[str, Sequence[str]] = field(default_factory=lambda: FEATURES)
    tags: Mapping[str, Sequence[str]] = field(default_factory=dict)

    def words(self) -> list[str]:
        """All that is no search word, in order."""
        facets = (self.nations, self.types, self.subtypes, self.archipelagos, self.features, self.tags)
        return [*(w for d in facets for ws in d.values() for w in ws), *SORTS, *FILLERS]


def _named(text: Column, facets: Mapping[str, Sequence[str]]) -> Column:
    """The facets one of whose words is in a text, in the dictionary's order."""
    table = F.array(*(F.struct(F.lit(v).alias("v"), F.array(*map(F.lit, ws)).alias("w")) for v, ws in facets.items())) if facets else None
    if table is None:
        return F.array().cast("array<string>")
    return F.transform(F.filter(table, lambda f: F.exists(f["w"], lambda w: F.contains(text, w))), lambda f: f["v"])


def _whole(text: Column, words: Sequence[str]) -> Column:
    return text.rlike(r"(?:^|[^a-z0-9])(?:" + "|".join(w.replace(".", r"\.") for w in words) + r")(?:$|[^a-z0-9])")


def _part(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def sentence_text(c: Column) -> Column:
    """A sentence folded and trimmed, with square kilometres spelt out."""
    return F.trim(F.replace(fold(c), F.lit("²"), F.lit("2")))


def with_facets(sentences: DataFrame, sentence: str, words: Dictionaries | None = None) -> DataFrame:
    """``sentences`` with what each asks for: nations, types, subtypes, archipelagos, features, tags, water, sort, descending, ferry, ferry_kind, ferry_season, ferry_operator, ferry_port, recommend, recommend_n, min_area, max_area, photo, elevation, curated, sure, near (what stands behind it), near_km and words.

    A facet is meant if one of its words stands anywhere in the folded sentence;
    nations need whole words, and a longer name is not also the shorter one in it. A
    water that is named is no kind of island. Null sentences ask for nothing.
    """
    d = words or Dictionaries()
    t = F.col("_text")
    has = lambda name: t.rlike(PATTERNS[name])
    out = sentences.withColumn("_text", sentence_text(F.col(sentence)))

    found, hidden = [], t
    for nation, names in d.nations.items():
        found.append(F.when(_whole(hidden, names), F.lit(nation)))
        longer = [w for w in names for other, ws in d.nations.items() if other != nation for x in ws if x in w and x != w]
        for w in sorted(longer, key=len, reverse=True):
            hidden = F.replace(hidden, F.lit(w), F.lit(" "))
    highland = F.when(t.rlike(r"\bhighlands?\b") & ~t.rlike(r"\bhighland park\b"), F.lit("Scotland"))
    phrase = F.trim(F.regexp_replace(F.regexp_extract(t, PATTERNS["water"], 1), r"\b(?:and|with|that|which|near|islands?|the)\b.*$", ""))
    out = out.withColumns({"nations": F.array_distinct(F.array_compact(F.array(*found, *([highland] if "Scotland" in d.nations else [])))), "water": F.when((phrase != "") & ~phrase.rlike(r"^(?:loch|lough|lake|llyn|river)(?:\s+(?:island|islands|isle|isles))?$"), phrase)})

    hebrides = t.rlike(r"\bhebrid(?:es|ean)\b") & ~t.rlike(r"\b(?:inner\s+hebrides|outer\s+hebrides|western\s+isles)\b") & F.lit("Inner Hebrides" in d.archipelagos)
    features = _named(t, d.features)
    kinds = _named(t, d.types)
    count = F.coalesce(*(_part(t, p) for p in COUNTS))
    n = F.coalesce(count.try_cast("int"), F.nullif(F.array_position(F.array(*map(F.lit, NUMBERS)), count), F.lit(0)).cast("int"))
    out = out.withColumns(
        {
            "_types": F.when(F.col("water").isNotNull(), F.array_except(kinds, F.array(F.lit("lake"), F.lit("river")))).otherwise(kinds), "subtypes": _named(t, d.subtypes),
            "archipelagos": F.array_union(_named(t, d.archipelagos), F.when(hebrides, F.array(F.lit("Inner Hebrides"), F.lit("Outer Hebrides"))).otherwise(F.array().cast("array<string>"))),
            "features": F.when(F.array_contains(features, "uninhabited"), F.array_remove(features, "inhabited")).otherwise(features), "tags": _named(t, d.tags), "_sort": F.coalesce(*(F.when(F.contains(t, F.lit(k)), F.struct(F.lit(by).alias("by"), F.lit(down).alias("down"))) for k, (by, down) in SORTS.items())),
            "ferry_kind": F.when(has("on foot"), "foot-only").when(has("by car"), "car-and-foot"), "ferry_season": F.when(has("all year"), "year-round").when(has("in summer"), "summer-only"), "ferry_operator": F.coalesce(*(F.when(F.contains(t, F.lit(o)), F.lit(o)) for o in OPERATORS)), "ferry_port": F.trim(_part(t, PATTERNS["port"])),
            "recommend_n": F.when(n.between(1, 25), n), "max_area": _part(t, PATTERNS["smaller"]).cast("double"), "_larger": _part(t, PATTERNS["larger"]).cast("double"),
            "photo": has("photo"), "elevation": has("elevation"), "curated": has("curated"), "sure": has("sure"),
            "_within": _part(t, PATTERNS["within"]).cast("double"), "_near": F.coalesce(_part(t, PATTERNS["within"], 3), F.when(~has("within"), _part(t, PATTERNS["near"]))),
        }
    )
    want = F.trim(F.regexp_replace(F.regexp_replace(F.trim("_near"), r"^the\s+", ""), r"[?.!]+$", ""))
    c = F.col
    scoped = c("recommend_n").isNotNull() & ((F.size("archipelagos") > 0) | (F.size("nations") > 0))
    rest = F.when(c("water").isNotNull(), F.replace(F.concat(F.lit(" "), t, F.lit(" ")), c("water"), F.lit(" "))).otherwise(F.concat(F.lit(" "), t, F.lit(" ")))
    rest = F.when(F.array_contains("nations", "Northern Ireland"), F.replace(rest, F.lit("northern ireland"), F.lit(" "))).otherwise(rest)
    out = out.withColumns(
        {
            "sort": c("_sort.by"), "descending": c("_sort.down"), "ferry": has("ferry") | F.coalesce(c("ferry_kind"), c("ferry_season"), c("ferry_operator"), c("ferry_port")).isNotNull(), "recommend": has("recommend") | scoped,
            "min_area": F.coalesce("_larger", F.when(has("large"), F.lit(LARGE_KM2))), "near": F.when((F.length(want) >= 3) & ~want.rlike(NOT_NEAR), want), "near_km": F.coalesce(F.when(_part(t, PATTERNS["within"], 2).startswith("mi"), c("_within") * KM_A_MILE).otherwise(c("_within")), F.lit(NEAR_KM)),
            "_rest": F.aggregate(F.array(*map(F.lit, d.words())), rest, lambda a, w: F.replace(a, F.concat(F.lit(" "), w, F.lit(" ")), F.lit(" "))),
        }
    )
    out = out.withColumns({"types": F.when(c("recommend") & (F.size("_types") == 0) & (F.size("features") == 0) & c("water").isNull(), F.array(F.lit("sea"))).otherwise(c("_types")), "words": F.filter(F.split("_rest", "[^a-z0-9'-]+"), lambda w: F.length(w) >= 3)})
    return out.drop("_text", "_types", "_sort", "_larger", "_within", "_near", "_rest")


def near_places(asked: DataFrame, key: str, gazetteer: DataFrame) -> DataFrame:
    """(key, place, lat, lng) of what stands behind ``near``: the place of that name, or the only one that begins with it, from 4 letters on. asked: key, near; gazetteer: place, lat, lng.

    Names and beginnings are met by equality, so that many sentences meet many places.
    """
    g = gazetteer.withColumn("_full", fold(F.col("place")))
    starts = g.withColumn("_w", F.explode(F.transform(F.sequence(F.lit(1), F.length("_full")), lambda i: F.substring(F.col("_full"), F.lit(1), i)))).filter("length(_w) >= 4 or _w = _full")
    hit = asked.filter("near is not null").select(key, F.col("near").alias("_w")).join(starts, "_w")
    one = hit.groupBy(key).agg(F.min(F.struct((F.col("_w") != F.col("_full")).alias("longer"), "place", "lat", "lng")).alias("_b"), F.count("*").alias("_n"))
    return one.filter("_n = 1 or not _b.longer").select(key, "_b.place", "_b.lat", "_b.lng")
