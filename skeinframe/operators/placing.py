"""Things placed on one of the places around them by ordered evidence (survey X-06), and settings of books by what a sentence says (X-14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine_km
from ..functions.text import escape_pattern, fold, name_key, squeeze
from .evidence import any_reach, circle_km, reached
from .tables import durable

# Words that are no name of a place by themselves
GENERIC = ("castle", "island", "isle", "holm", "rock", "skerry", "point", "ness", "bay", "loch", "more", "mor", "beg", "beag", "north", "south", "east", "west")
# What stands before a name that is a water's, is only looked at, or is a place to be on
WATER_OF = r"\b(?:sound|loch|lough|firth|strait|bay|point|head|ness|kyle|kyles|channel|estuary|harbour|harbor|river|water|sea) of\s*"
OFF = r"\b(?:off the coast of|opposite|overlooking|looking (?:across|towards)|across from|near|close to)\s*(?:the\s+)?(?:isle of\s+|island of\s+)?"
SIDE_OF = r"\b(?<!-)(?:west|east|north|south) of\s*(?:the\s+)?(?:isle of\s+|island of\s+)?"
VIEW = r"\b(?:takes|taking|bringing|coming|falling|set|deep|lying)\s+(?:in|on)(?: the)?\s+"
_SIDES = "northern|southern|eastern|western|north-eastern|north-western|south-eastern|south-western|north-east|north-west|south-east|south-west|northeast|northwest|southeast|southwest|north|south|east|west"
PLACED = rf"(?:\b(?:on|upon|at|in) the(?: (?:{_SIDES}))?(?: (?:part|shore|coast|end|side|tip|point|edge|grounds))? of(?: the)?(?: (?:isle|island) of)?|\b(?:on|upon|at|in) the|\b(?:isle|island) of|\bof the (?:isle|island) of|^|, )\s*|\b(?:on|upon|at|in)\s+"
# What a castle is called and what is none, and what says that it stands on a small island of its own
CASTLE = r"\bcastles?\b"
NO_CASTLE = r"\b(?:hotel|farmhouse|farm|cottage|inn|tavern|pub|school|station|railway|stables|barn|lodge|pavilion|folly|villa|apartment|terrace|street|road|lane|avenue|drive|martello|broch|hillfort|hill fort|promontory fort|ringfort|blockhouse|battery|lighthouse|gatehouse|gateway|gate piers|walls?|curtain wall|bridge|pier|chapel|church|fort|dun|installations|cist|burial|earthwork)\b"
LEAD_CASTLE = r"\b(?:is|was|stands as) (?:a |an |the )?(?:medieval |ruined |royal |tower |moated |coastal |clifftop |cliff-top )*(?:castle|tower house|fortified house)\b"
LEAD_OTHER = r"\b(?:is|was) (?:a |an )?(?:[\w-]+ ){0,5}?(?:broch|martello tower|hillfort|hill fort|promontory fort|ringfort|iron[- ]age fort|folly|country house|hunting lodge|hotel|lighthouse)\b"
OWN_ISLET = r"\bon (?:a |an |its own )(?:small |tiny |tidal |rocky |offshore )?(?:island|islet|holm|rock)\b"
SAYS_ISLAND = r"\bon (?:a |an |the )?(?:small |tiny |tidal |rocky )?(?:island|islet)\b"
#: Square kilometres from which a place is large.
LARGE = 8.0
#: Kilometres that a place reaches at most, and letters that a phrase has at least.
MOST_KM, LEAST = 75.0, 4

REASONS = {1: "declared", 2: "the text places it there", 3: "named in the title", 4: "on this small island", 5: "the register places it there"}


def place_phrases(name: Column) -> Column:
    """What a place may be called: its name, without and within brackets, without 'isle of' and the like, and its key; folded, of 4 letters and more, generic words never."""
    raw = F.coalesce(name, F.lit(""))
    pieces = F.concat(F.array(raw, F.regexp_replace(raw, r"\([^)]*\)", " ")), F.regexp_extract_all(raw, F.lit(r"\(([^)]+)\)"), F.lit(1)))
    plain = F.transform(pieces, lambda p: F.regexp_replace(fold(squeeze(p)), r"^[ ,;]+|[ ,;]+$", ""))
    short = F.transform(plain, lambda p: F.regexp_replace(p, r"^(?:isle|island|ynys|eilean|inis|inch) of\s+", ""))
    return F.array_distinct(F.filter(F.concat(plain, short, F.array(fold(name_key(raw)))), lambda p: (F.length(p) >= 4) & ~p.isin(*GENERIC)))


def phrase_pattern(phrases: Column) -> Column:
    """A pattern for any of some phrases; null without one."""
    return F.when(F.size(phrases) > 0, F.array_join(F.transform(phrases, escape_pattern), "|"))


def sentences(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+|\n+")


def set_on(text: Column, pattern: Column) -> Column:
    """Whether a sentence of a folded text puts something on a place: 'on X', 'on the shore of X', 'isle of X', ', X', 'X castle'; the sound of X is not X, nor is what lies off it or looks at it."""
    name = F.concat(F.lit("(?:"), pattern, F.lit(")"))
    looked_at = F.concat(F.lit(f"(?:{WATER_OF}|{OFF}|{SIDE_OF}|{VIEW})"), name, F.lit(r"\b"))
    there = F.concat(F.lit(f"(?:{PLACED})"), F.lit(r"\b"), name, F.lit(r"\b|\b"), name, F.lit(r" (?:castle|island|islet)\b"))
    return F.coalesce(F.exists(sentences(text), lambda s: F.regexp_like(F.regexp_replace(s, looked_at, F.lit(" # ")), there)), F.lit(False))


def is_castle(title: Column, extract: Column, kind: Column) -> Column:
    """Whether the first three sentences say that it is a castle, or else its name or register does; other buildings, houses and bare entity ids are none."""
    t, head, k = fold(title), F.array_join(F.slice(sentences(fold(extract)), 1, 3), " "), fold(kind)
    named = t.rlike(CASTLE) & ~t.rlike(NO_CASTLE)
    house = t.rlike(r"\bhouse\b") & ~t.rlike(r"\btower house\b")
    lead = head.rlike(LEAD_CASTLE)
    other = head.rlike(LEAD_OTHER) | head.rlike(r"\b(?:martello|broch)\b")
    return F.when(t.rlike(r"^q\d+$") | house, False).when(lead, True).when(other, False).otherwise((F.contains(k, F.lit("tower house")) & ~t.rlike(NO_CASTLE)) | named)


def castle_places(records: DataFrame, places: DataFrame, most_area: float = 8000.0) -> DataFrame:
    """(record, place, reason) for each record; without a place the reason says why.

    Candidates are the places whose widened circle holds the record. The first kind
    of evidence that names one of them counts: a declared entity; a text that sets it
    there (of several the smallest); a title with the place's name, not too near the
    circle's edge; a small place that is named, or the nearest by 200 m if the text
    says it stands on an island; a register that sets it on a large place, well within
    the circle. A text that puts it on an islet of its own rules out large places.

    records: record, title, extract, kind, context, lat, lng, declared (entities in
    order); places: place, name, area, lat, lng, entity. Null texts are empty, null
    coordinates and names match nothing; equal distances and sizes go to the least
    place. Each record has one row; a record id that repeats is one record.
    """
    r = records.dropDuplicates(["record"]).withColumns({c: F.coalesce(c, F.lit("")) for c in ("title", "extract", "kind", "context")})
    r = durable(r.withColumn("_t", F.sha2(F.to_json(F.struct("title", "extract", "context")), 256)), "castles")
    kinds = dict(places.dtypes)
    area = F.coalesce("area", F.lit(0.0))
    real = F.col("lat").between(-90, 90) & F.col("lng").isNotNull() & ~F.isnan("lng")
    radius = F.when(area <= 0, 0.4).otherwise(F.greatest(F.lit(0.35), 1.45 * F.sqrt(area / F.pi())))
    p = places.filter((area <= most_area) & real).select("place", "lat", "lng", area.alias("area"), "entity", radius.alias("radius"), circle_km(area).alias("reach"), place_phrases(F.col("name")).alias("_f"))
    p = durable(p.withColumn("_p", phrase_pattern(F.col("_f"))), "castle-places")
    spot = F.struct("lat", "lng").alias("spot")
    at = r.filter(real)
    spots = at.select("lat", "lng").distinct().withColumn("spot", spot)
    around = any_reach(spots, p.select("lat", "lng", "reach"), "spot", MOST_KM)

    # equal texts meet the names that stand in them once, and equal spots the places of such a name once
    told = durable(_told(at.select("_t", "title", "extract", "context").dropDuplicates(["_t"]), p.select("_p", "_f").dropDuplicates(["_p"])), "told")
    named = at.select("record", "_t", "lat", "lng", (F.trim("extract") == "").alias("bare"), fold(F.concat_ws("\n", "title", "extract")).rlike(OWN_ISLET).alias("islet")).join(told, "_t")
    named = durable(named.withColumn("spot", spot), "named")
    met = reached(named.select("lat", "lng", "spot", "_p").distinct(), p.select("lat", "lng", "reach", "radius", "place", "area", "_p"), MOST_KM, ["_p"])
    km, size, radius = F.col("km"), F.col("area"), F.col("radius")
    inside = km <= F.greatest(F.lit(1.5), radius * 0.95)
    islet = (size < LARGE) & (km <= F.greatest(F.lit(0.8), F.least(radius, F.lit(1.2))))
    least = lambda test, *by: F.min(F.when(test, F.struct(*by, "place")))
    found = met.groupBy("spot", "_p").agg(
        F.count("*").alias("n"), F.min(F.struct("area", "km", "place")).alias("m"), F.count_if(inside).alias("n_in"), least(inside, "area").alias("m_in"),
        F.count_if(islet).alias("n_small"), least(islet).alias("m_small"), least((size >= LARGE) & (km <= radius * 0.7), "km", "area").alias("m_large"),
    )
    said, small = F.col("set"), F.col("titled") | F.col("told") | (F.col("bare") & F.col("listed"))
    both = named.join(found, ["spot", "_p"]).groupBy("record").agg(
        F.sum(F.when(said, F.col("n"))).alias("n_said"), F.min(F.when(said, F.col("m"))).alias("said"), F.sum(F.when(F.col("titled"), F.col("n_in"))).alias("n_titled"), F.min(F.when(F.col("titled"), F.col("m_in"))).alias("titled"),
        F.sum(F.when(small, F.col("n_small"))).alias("n_small"), F.min(F.when(small, F.col("m_small"))).alias("small"), F.min(F.when(F.col("listed") & ~F.col("islet"), F.col("m_large"))).alias("listed"),
    )

    says = fold(F.col("extract")).rlike(SAYS_ISLAND)
    lone = spots.join(at.filter(says).select(spot).distinct(), "spot", "left_semi")
    islets = p.filter(F.col("area") < LARGE).select("lat", "lng", "place", "area", F.least("reach", F.greatest(F.lit(0.8), F.least("radius", F.lit(1.2)))).alias("reach"))
    order = Window.partitionBy("spot").orderBy("km", "area", "place")
    two = reached(lone, islets, 1.2).select("spot", "km", "area", "place").withColumn("i", F.row_number().over(order)).filter("i <= 2")
    two = two.groupBy("spot").agg(F.min(F.struct("i", "km", "place")).alias("a"), F.max(F.when(F.col("i") == 2, F.col("km"))).alias("b"))
    alone = two.filter("b is null or a.km + 0.2 < b").select("spot", F.col("a.place").alias("alone"))

    # distances between a record and what it declares, as the other distances are measured
    owned = at.select("record", F.col("lat").alias("_a"), F.col("lng").alias("_b"), fold(F.concat_ws("\n", "title", "extract")).rlike(OWN_ISLET).alias("islet"), F.posexplode("declared").alias("o", "entity")).join(p, "entity")
    owned = owned.filter((haversine_km(F.col("_a"), F.col("_b"), F.col("lat"), F.col("lng")) <= F.col("reach")) & (F.col("reach") <= MOST_KM) & ~((F.col("area") >= LARGE) & F.col("islet")))
    owned = owned.groupBy("record").agg(F.min(F.struct("o", "place"))["place"].alias("declared"))

    c = F.col
    judged = r.select("record", "title", "extract", "kind", "lat", "lng", spot).join(around.withColumn("hit", F.lit(True)), "spot", "left").join(alone, "spot", "left")
    judged = judged.join(owned, "record", "left").join(both, "record", "left")
    off = lambda h: (c(f"{h}.area") >= LARGE) & fold(F.concat_ws("\n", "title", "extract")).rlike(OWN_ISLET)
    # of several named places the smallest; if the text rules that out, they are all large
    texted = F.when(~off("said"), c("said.place"))
    titled = F.when((c("n_titled") == 1) & ~off("titled"), c("titled.place"))
    smallish = F.coalesce(F.when(c("n_small") == 1, c("small.place")), F.when(says, c("alone")))
    castle = is_castle(c("title"), c("extract"), c("kind"))
    elsewhere = c("declared").isNull() & F.coalesce(c("n_said") > 1, F.lit(False)) & texted.isNull()
    tiers = [c("declared"), texted, *(F.when(~elsewhere, t) for t in (titled, smallish, c("listed.place")))]
    tier = F.coalesce(*(F.when(t.isNotNull(), F.lit(i + 1)) for i, t in enumerate(tiers)))
    reason = F.when(c("lat").isNull() | c("lng").isNull(), "no coordinates").when(c("hit").isNull(), "not on a known place").when(~castle, "no castle")
    for i, why in REASONS.items():
        reason = reason.when(tier == i, why)
    reason = reason.when(elsewhere, "the text puts it on a smaller place").otherwise("no source names one place")
    placed = F.when(c("hit").isNotNull() & castle, F.coalesce(*tiers))
    return judged.select("record", placed.cast(kinds["place"]).alias("place"), reason.alias("reason"))


def _told(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(_t, _p, set, titled, told, listed) of texts (_t, title, extract, context) and patterns (_p, and the phrases _f in it) that say something of each other.

    They meet over the first LEAST letters of phrases, wherever a phrase may begin: not between two plain letters.
    """
    text = lambda *c: fold(F.concat_ws("\n", *c))
    whole = F.concat_ws("\n", text("title", "extract"), text("context"))
    t = texts.select("_t", "title", "extract", "context", whole.alias("_w"))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("_w") - LEAST + 1))
    inner = lambda i: F.regexp_like(F.substring(F.col("_w"), i - 1, F.lit(2)), F.lit(r"^[A-Za-z0-9_]{2}"))
    borders = F.filter(starts, lambda i: (i == 1) | ~inner(i))
    grams = F.array_distinct(F.transform(borders, lambda i: F.substring(F.col("_w"), i, F.lit(LEAST))))
    phrases = patterns.select("_p", F.explode("_f").alias("_f"))
    near = t.withColumn("_g", F.explode(grams)).select("_t", "_w", "_g").join(phrases.withColumn("_g", F.substring("_f", 1, LEAST)), "_g").filter(F.contains("_w", F.col("_f"))).select("_t", "_p").distinct()
    p = F.col("_p")
    flags = near.join(t.drop("_w"), "_t").select(
        "_t", "_p", set_on(text("title", "extract"), p).alias("set"), F.regexp_like(text("title"), F.concat(F.lit(r"\b(?:"), p, F.lit(r")\b"))).alias("titled"), set_on(text("extract"), p).alias("told"), set_on(text("context"), p).alias("listed"),
    )
    return flags.filter(F.col("set") | F.col("titled") | F.col("told") | F.col("listed"))


_KIND = "remote|small|tiny|little|rocky|distant|northern|southern|western|eastern|outer|inner|main|largest|wild|lonely|uninhabited"
_ISLE, _ISLES = "(?:isle of |island of )?", "(?:isle of |island of |islands of )?"
# How a sentence sets a book on a place ({n}), and what rules a setting out
SETTINGS = (
    rf"\bset (?:mainly |largely |mostly |partly |primarily |briefly )?(?:on|in|at|upon) (?:the )?(?:(?:{_KIND}|nearby|neighbouring|neighboring|scottish|irish|welsh|occupied) )?{_ISLES}{{n}}\b",
    rf"\btakes place (?:mainly |largely |mostly |partly )?(?:on|in|at) (?:the )?(?:(?:{_KIND}|weather-beaten)(?: and (?:remote|small|tiny|little|rocky|weather-beaten))? )?{_ISLES}{{n}}\b",
    rf"\b(?:shipwrecked|marooned|stranded) on (?:the )?{_ISLE}{{n}}\b",
    rf"\b(?:life|childhood|youth|years|time|stay) (?:living |spent )?(?:on|in) (?:the )?{_ISLE}{{n}}\b",
    rf"\bgrew up (?:on|in) (?:the )?{_ISLE}{{n}}\b",
    rf"\baccount of (?:(?:his|her|their) )?(?:life|years|time|stay|visit|journey) (?:on|in|to) (?:the )?{_ISLES}{{n}}\b",
    rf"\b(?:describes|recounts) (?:his|her|their) (?:time|stay|life|years) (?:on|in) (?:the )?{_ISLE}{{n}}\b",
    rf"\bdescribes (?:his|her|their) visit (?:on|in) (?:the )?{_ISLE}{{n}}\b",
    rf"\b(?:live|lives) on (?:the )?{_ISLES}{{n}}\b",
    rf"\b(?:held|wash(?:ed)? ashore) on (?:the )?{_ISLE}{{n}}\b",
    rf"\barrives? in (?:the )?{_ISLE}{{n}}\b",
    r"\bturn the (?:isle|island) of {n} into\b",
    rf"\b(?:story|novel|book|memoir) begins on (?:the )?{_ISLE}{{n}}\b",
    r"\b(?:returns|sails|goes|comes|travels|travelled|journeys) to the (?:isle|island) of {n}\b",
    r"(?<!\w){n}(?!\w).{{0,90}}\bsetting\b",
    r"\bsetting\b.{{0,70}}(?<!\w){n}(?!\w)",
)
TO_THE_ISLE = r"\bto the (?:[\w'-]+ ){{0,2}}(?:isle|island) of {n}\b"
COMPARED = r"\b(?:comparisons?|compared to|in popular culture)\b"
INSPIRED = r"\b(?:inspired by|based on|loosely based|modell?ed on|thought to be based|filmed on|shot on|patterned after|draws on)\b"
SET_ON = rf"\bset (?:on|in|at|upon) (?:the )?{_ISLE}{{n}}\b"
LOOSE = r"\b(?:set|takes place|setting) (?:on|in|at|upon)\b"
#: Letters from which a name may stand anywhere in a sentence that sets something somewhere; letters before a name in which 'fictional' rules it out.
LONG_NAME, FICTIONAL = 8, 55
#: Letters by which a longer name wins; what a token of context and a hint add; how much larger a place must be.
LEAD, CONTEXT, HINT, LARGER = 3, 3, 5, 5.0


def _with_name(pattern: str, name: Column) -> Column:
    """A pattern with a (quoted) name in place of {n}."""
    parts = pattern.replace("{{", "{").replace("}}", "}").split("{n}")
    out = [F.lit(parts[0])]
    for p in parts[1:]:
        out += [name, F.lit(p)]
    return F.concat(*out)


def sets_on(sentence: Column, alias: Column) -> Column:
    """Whether a folded sentence sets a book on a place of that folded name; not in a comparison, of someone who used to live there, of a fictional place, or if the place only inspired it."""
    n = escape_pattern(alias)
    found = F.regexp_like(sentence, F.concat(F.lit("(?:"), F.concat_ws("|", *(_with_name(p, n) for p in SETTINGS)), F.lit(")")))
    to_it = ~sentence.rlike(r"\bdedicated to\b") & F.regexp_like(sentence, _with_name(TO_THE_ISLE, n))
    loose = (F.length(alias) >= LONG_NAME) & sentence.rlike(LOOSE)
    at = F.position(alias, sentence)
    ahead = F.substring(sentence, F.greatest(F.lit(1), at - FICTIONAL), F.least(F.lit(FICTIONAL), at - 1))
    out = sentence.rlike(COMPARED) | F.regexp_like(sentence, _with_name(r"\bused to live\b.{{0,30}}(?<!\w){n}(?!\w)", n)) | F.contains(ahead, F.lit("fictional"))
    whole = F.regexp_like(sentence, _with_name(r"(?<!\w){n}(?!\w)", n))
    return whole & ~out & (found | to_it | loose) & (~sentence.rlike(INSPIRED) | F.regexp_like(sentence, _with_name(SET_ON, n)))


def _word_runs(words: Column, counts: list[int]) -> Column:
    starts = lambda k: F.when(F.size(words) >= k, F.sequence(F.lit(1), F.size(words) - k + 1)).otherwise(F.array().cast("array<int>"))
    runs = [_runs(words, starts(k), k) for k in counts]
    return F.array_distinct(F.flatten(F.array(*runs))) if runs else F.array().cast("array<string>")


def _runs(words: Column, starts: Column, k: int) -> Column:
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(k)), " "))


def book_places(docs: DataFrame, aliases: DataFrame, places: DataFrame) -> DataFrame:
    """(doc, n, place, alias): the place on which sentence n of a book's text is set, for the sentences that name one.

    Aliases meet sentences over runs of as many words as some alias has, an
    equi-join; then the sentence must set something there. Names of groups give way
    to names of places in them. Of several places those whose names are within two
    letters of the longest remain; each token of a place's context that stands in the
    sentence adds 3 letters, the place that the text is hinted at 5. A lead of 3
    letters decides, else an area five times as large (and 1 km2 larger), else that
    only one has an area, else that they are one entity of which one is curated.

    docs: doc, body, hint (place); aliases: alias, place, is_group, not_in (a phrase
    in which the alias means something else); places: place, area, context (array),
    entity, curated. Null texts have no sentences, null aliases match nothing;
    repeated aliases and rows count once. Of equal leads
    nothing is named.
    """
    from ..functions.text import search_norm

    a = aliases.select(fold(F.trim("alias")).alias("_a"), "place", F.coalesce("is_group", F.lit(False)).alias("group"), fold(F.col("not_in")).alias("not_in")).filter("_a <> ''").dropDuplicates(["_a", "place"]).withColumn("_r", search_norm(F.col("_a"))).filter("_r <> ''")
    counts = sorted(r[0] for r in a.select(F.size(F.split("_r", " "))).distinct().collect())  # numbers of words in names
    # a hint counts only if some alias means it; equal texts, and equal sentences, with equal hints say the same: they are judged once
    meant = a.select(F.col("place").alias("hint")).distinct().withColumn("_meant", F.lit(True))
    d = docs.join(meant, "hint", "left").select("doc", "body", F.when(F.col("_meant"), F.col("hint")).alias("hint"))
    s = d.filter("body is not null").select("body", "hint").distinct().select("body", "hint", F.posexplode_outer(sentences(fold(F.col("body")))).alias("n", "_s")).withColumn("_s", squeeze(F.col("_s"))).filter("_s <> ''")
    s = durable(s, "sentences")
    met = s.select("_s", "hint").distinct().withColumn("_r", F.explode(_word_runs(F.split(search_norm(F.col("_s")), " "), counts))).join(a, "_r")
    met = met.filter(((F.col("not_in") == "") | ~F.contains("_s", F.col("not_in"))) & sets_on(F.col("_s"), F.col("_a")))
    known = places.select("place", F.coalesce("area", F.lit(0.0)).alias("area"), F.filter(F.transform(F.coalesce("context", F.array().cast("array<string>")), fold), lambda t: F.length(t) >= 4).alias("_t"), "entity", F.coalesce("curated", F.lit(False)).alias("curated"))
    bonus = CONTEXT * F.size(F.filter(F.array_distinct("_t"), lambda t: F.contains(F.col("_s"), t))) + F.when(F.coalesce(F.col("hint") == F.col("place"), F.lit(False)), HINT).otherwise(0)
    rated = met.join(known, "place").select("_s", "hint", F.struct(F.length("_a").alias("score"), bonus.alias("bonus"), "area", "place", F.col("_a").alias("alias"), "group", "entity", "curated").alias("h"))
    # of a place's aliases the longest
    one = rated.groupBy("_s", "hint", "h.place").agg(F.max("h").alias("h"))
    sets = one.groupBy("_s", "hint").agg(F.collect_list("h").alias("hits"))
    alone = F.filter("hits", lambda h: ~h["group"])
    sets = sets.withColumn("hits", F.when(F.size(alone) > 0, alone).otherwise(F.col("hits")))
    best = F.array_max(F.transform("hits", lambda h: h["score"]))
    near = sets.select("_s", "hint", F.filter("hits", lambda h: h["score"] >= best - (LEAD - 1)).alias("near"))
    ranked = near.select("_s", "hint", F.sort_array(F.transform("near", lambda h: F.struct((h["score"] + h["bonus"]).alias("points"), h["area"].alias("area"), h["place"].alias("place"), h["alias"].alias("alias"), h["entity"].alias("entity"), h["curated"].alias("curated"))), False).alias("r"))
    first, second = F.col("r")[0], F.get("r", F.lit(1))
    sized = F.filter("r", lambda h: h["area"] > 0)
    entities = F.array_distinct(F.filter(F.transform("r", lambda h: h["entity"]), lambda e: e.isNotNull()))
    chosen_ones = F.filter("r", lambda h: h["curated"])
    choice = (
        F.when(F.size("r") == 1, first)
        .when(first["points"] >= second["points"] + LEAD, first)
        .when((first["area"] > F.greatest(second["area"], F.lit(0.01)) * LARGER) & (first["area"] >= second["area"] + 1), first)
        .when(F.size(sized) == 1, F.get(sized, F.lit(0)))
        .when((F.size(entities) == 1) & (F.size(chosen_ones) == 1), F.get(chosen_ones, F.lit(0)))
    )
    judged = ranked.select(F.col("_s").alias("_said"), F.col("hint").alias("_hint"), choice.alias("c")).filter("c is not null").select("_said", "_hint", "c.place", "c.alias")
    judged = durable(judged, "settings")
    told = s.join(judged, (F.col("_s") == F.col("_said")) & F.col("hint").eqNullSafe(F.col("_hint"))).select(F.col("body").alias("_body"), "_hint", "n", "place", "alias")
    told = durable(told, "told")
    return d.join(told, (F.col("body") == F.col("_body")) & F.col("hint").eqNullSafe(F.col("_hint"))).select("doc", "n", "place", "alias").distinct()
