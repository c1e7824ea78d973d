"""Open questions: hard facets, a score, a relevance cutoff and a fallback for misspelt names (survey R-02, Q-04, Q-08, Q-12, J-27, A-04, F-33)."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.geo import haversine_km
from ..functions.sentences import PLACES, Dictionaries, near_places, with_facets
from ..operators import filters, joins, resolve, scores, topk
from ..operators.tables import durable
from .base import ITEMS_SQL, PLACES_SQL, items, places
from .questions import collections, compare, folded, lookup, parse
from .registry import query

# Points of a question's facets, and floors of what is relevant
FEATURE_POINTS = {"forsale": 5, "photo": 4}
FLOORS = {"recommend": (9, 0.78), "specific": (7, 0.65), "scope": (6, 0.5), "none": (5, 0.0)}
#: Capitals from which remoteness is measured.
ANCHORS = ((51.5074, -0.1278), (55.9533, -3.1883), (53.3498, -6.2603), (51.4816, -3.1791))


@dataclass
class Ask:
    """What a question asks for; what is empty asks for nothing. near: lat, lng, km and the id that is left out."""

    nations: tuple[str, ...] = ()
    types: tuple[str, ...] = ()
    subtypes: tuple[str, ...] = ()
    archipelagos: tuple[str, ...] = ()
    min_area: float | None = None
    max_area: float | None = None
    photo: bool = False
    elevation: bool = False
    curated: bool = False
    sure: bool = False
    recommend: bool = False
    water: str | None = None
    near: tuple[float, float, float, int | None] | None = None
    ferry: bool = False
    ferry_kind: str | None = None
    ferry_season: str | None = None
    ferry_operator: str | None = None
    ferry_port: str | None = None
    tags: Mapping[str, Sequence[str]] | None = None
    features: tuple[str, ...] = ()
    words: tuple[str, ...] = ()
    sort: tuple[str, bool] | None = None
    name: str | None = None
    #: rows that are asked for, and places that a misspelt one may mean
    limit: int | None = None
    suggestions: tuple[str, ...] = ()

    def broad(self) -> bool:
        """Whether it would list nearly everything."""
        return filters.too_broad({"recommend": self.recommend, "sort": self.sort, "near": self.near, "water": self.water, "ferry": self.ferry, "features": self.features, "tags": self.tags, "words": self.words, "min_area": self.min_area is not None, "max_area": self.max_area is not None, "photo": self.photo, "elevation": self.elevation, "curated": self.curated, "archipelago": self.archipelagos, "nation": self.nations, "type": self.types, "subtype": self.subtypes})

    def floor(self) -> tuple[float, float]:
        specific = self.features or self.tags or self.words or self.ferry or self.near
        kind = "recommend" if self.recommend else "specific" if specific else "scope" if self.nations or self.archipelagos or self.types else "none"
        return FLOORS[kind]


def question_score(q: Ask, haystack: Column) -> Column:
    """A place's score for a question, or null if a hard facet fails. Columns: id, name, nation, type, subtype, archipelago, area, population, has_photo, elevation, source, confidence, water, lat, lng, tags, description, wikipedia, and of its routes ferry_n, ferry_kinds, ferry_seasons, ferry_operators, ferry_ports."""
    c, yes = F.col, lambda t: F.coalesce(t, F.lit(False))
    area, people = F.coalesce(c("area"), F.lit(0.0)), F.coalesce(c("population"), F.lit(0))
    hard: list[Column] = []
    score = F.lit(0.0)
    plus = lambda test, points: F.when(test, float(points)).otherwise(0.0)
    for column, wanted, points in (("nation", q.nations, 6), ("type", q.types, 6), ("subtype", q.subtypes, 5), ("archipelago", q.archipelagos, 4)):
        if wanted:
            hard.append(yes(c(column).isin(*wanted)))
            score = score + points
    if q.min_area is not None:
        hard.append(area >= q.min_area)
    if q.max_area is not None:
        hard.append(area <= q.max_area)
    if q.photo:
        hard.append(yes(c("has_photo")))
    if q.elevation:
        hard.append(filters.elevation_known(c("elevation"), c("confidence")))
    if q.curated:
        hard.append(yes(c("source") == "curated"))
    if q.sure:
        hard.append(~c("confidence").eqNullSafe("unconfirmed"))
    if q.recommend and (q.archipelagos or q.nations):
        hard.append((area >= 3) | (people > 0) | yes(c("source") == "curated") | (yes(c("has_photo")) & (area >= 0.8)))
    if q.water:
        hard.append(F.contains(F.lower(F.coalesce("water", F.lit(""))), F.lit(q.water.lower())))
        score = score + 8
    if q.near:
        lat, lng, km, leave = q.near
        far = haversine_km(F.lit(lat), F.lit(lng), c("lat"), c("lng"))
        hard.append(yes(far <= km))
        if leave is not None:
            hard.append(c("id") != leave)
        score = score + 6 * (1 - far / km)
    if q.ferry:
        hard.append(c("ferry_n") > 0)
        if q.ferry_kind:
            hard.append(F.array_contains("ferry_kinds", q.ferry_kind))
        if q.ferry_season:
            hard.append(F.array_contains("ferry_seasons", q.ferry_season))
        if q.ferry_operator:
            hard.append(F.exists("ferry_operators", lambda x: F.contains(F.lower(x), F.lit(q.ferry_operator))))
        if q.ferry_port:
            hard.append(F.exists("ferry_ports", lambda x: F.contains(F.lower(x), F.lit(q.ferry_port))))
        score = score + 6 + F.least(F.lit(4), c("ferry_n")) + plus(F.array_contains("ferry_kinds", "car-and-foot"), 1) + plus(F.array_contains("ferry_seasons", "year-round"), 1)
    for tag, synonyms in (q.tags or {}).items():
        hits = sum((F.contains(haystack, F.lit(w)).cast("int") for w in synonyms), F.lit(0))
        tagged = yes(F.array_contains("tags", tag))
        hard.append(tagged | (hits > 0))
        score = score + F.when(tagged, 7).otherwise(3 + F.least(F.lit(3), hits))
    for f in q.features:
        hard.append(filters.has_feature(f, haystack))
        score = score + FEATURE_POINTS.get(f, 3)
    if q.words:
        long = [w for w in q.words if len(w) >= 3]
        named = [text.whole_word(c("name"), F.lit(w)) for w in long]
        told = [text.whole_word(haystack, F.lit(w)) for w in long]
        n = sum((x.cast("int") for x in named), F.lit(0))
        score = score + sum((F.when(a, 5).when(b, 1).otherwise(0) for a, b in zip(named, told)), F.lit(0)) + F.when(n == len(q.words), 4).otherwise(0)
        if not (q.nations or q.archipelagos or q.near or q.features or q.tags or q.ferry):
            any_ = F.lit(False)
            for x in (*named, *told):
                any_ = any_ | x
            hard.append(any_)
    photo = yes(c("has_photo"))
    if q.recommend:
        told_length = F.length(F.coalesce("description", F.lit("")))
        score = score + F.when(people > 500, 2.2).when(people > 50, 1.6).when(people > 0, 1.1).otherwise(0.0) + F.when(told_length > 100, 1.8).when(told_length > 50, 1.0).otherwise(0.0) + plus(photo, 1.8) + F.when(area > 200, 1.6).when(area > 30, 0.9).otherwise(0.0) + plus(c("wikipedia").isNotNull(), 0.5)
    score = score + plus(photo, 0.6) + plus(people != 0, 0.3) + F.when(area != 0, F.least(F.lit(1.0), F.log10(1 + area))).otherwise(0.0)
    fits = F.lit(True)
    for t in hard:
        fits = fits & t
    return F.when(fits, score)


def search_asked(df: DataFrame, q: Ask, limit: int, haystack: Column) -> DataFrame:
    """The places that answer a question best: scored, in order (by the sort if there is one, without rows that lack it), cut where they get irrelevant; a misspelt name if nothing fits. A question that nearly every place answers is refused."""
    if q.broad():
        raise ValueError("too broad: ask for a feature, a place, a size or an order as well")
    # scored once; the lead and the rest are taken from the hits
    hits = durable(df.withColumn("score", question_score(q, haystack)).filter("score > 0"), "hits")
    order = [F.desc("score"), F.lower("name"), F.col("id")]
    if q.sort:
        by, down = q.sort
        hits = hits.filter(F.col(by) > 0)
        order = [F.col(by).desc() if down else F.col(by).asc(), F.col("id")]
    floor, share = q.floor()
    found = topk.relevance_cutoff(hits, "score", order, floor, share, 7, limit)
    if q.name and not found.limit(1).count():
        one = df.sparkSession.createDataFrame([(q.name,)], "target string")
        return df.join(joins.fuzzy_name(one, df, "target", "id").select("id"), "id", "left_semi").withColumn("score", F.lit(1.0))
    return found


def place_named(places: DataFrame, name: str) -> DataFrame:
    """The place of a name: the same 100, or one begins the other 40, plus its size on a log scale; without an article or 'isle of'. Names of 3 letters and more."""
    target = " ".join(w for w in re.sub(r"\b(?:the|isle of|island of)\b", " ", folded(name)).split())
    if len(target) < 3:
        return places.limit(0)
    bare = places.withColumn("_bare", text.squeeze(F.regexp_replace(text.fold(F.col("name")), r"\b(?:the|isle of|island of)\b", " ")))
    n, t = F.col("_bare"), F.lit(target)
    fit = F.when(n == t, 100).when(n.startswith(target) | (t.startswith(n) & (F.length(n) >= 4)), 40)
    rated = bare.withColumn("_fit", F.when(n != "", fit + F.least(F.lit(8.0), F.log10(1 + F.coalesce("area", F.lit(0.0))))))
    return topk.top(rated, [F.desc("_fit"), F.col("id")], 1).filter("_fit is not null").drop("_bare", "_fit")


def asked(places: DataFrame, sentence: str, words: Dictionaries | None = None, gazetteer: Mapping[str, tuple[float, float]] = PLACES) -> Ask:
    """What one sentence asks for. A place that it is near to is one of the gazetteer by name or as the only one that begins so, else a place of ``places``, which is then left out; else known ones are suggested. One row comes to the driver, and at most one place."""
    spark = places.sparkSession
    one = with_facets(spark.createDataFrame([(0, sentence)], "n int, sentence string"), "sentence", words)
    row = one.first()
    near, suggestions = None, ()
    if row["near"]:
        known = spark.createDataFrame([(k, *v) for k, v in gazetteer.items()], "place string, lat double, lng double")
        hit = near_places(one.select("n", "near"), "n", known).first()
        if hit is not None:
            near = (hit["lat"], hit["lng"], row["near_km"], None)
        else:
            starting = sorted(k for k in gazetteer if folded(k).startswith(row["near"])) if len(row["near"]) >= 4 else []
            island = place_named(places.filter("lat is not null and lng is not null"), row["near"]).first() if not starting else None
            if island is not None:
                near = (island["lat"], island["lng"], row["near_km"], island["id"])
            else:
                suggestions = tuple(starting[:3]) or tuple(r["place"] for r in suggestions_for(one.select(F.col("near").alias("target")), known, "target", "place").orderBy("rank").collect())
    d = words or Dictionaries()
    q = Ask(
        nations=tuple(row["nations"]), types=tuple(row["types"]), subtypes=tuple(row["subtypes"]), archipelagos=tuple(row["archipelagos"]), min_area=row["min_area"], max_area=row["max_area"], photo=row["photo"], elevation=row["elevation"], curated=row["curated"], sure=row["sure"], recommend=row["recommend"], water=row["water"],
        near=near, ferry=row["ferry"], ferry_kind=row["ferry_kind"], ferry_season=row["ferry_season"], ferry_operator=row["ferry_operator"], ferry_port=row["ferry_port"], tags={k: d.tags[k] for k in row["tags"]} or None, features=tuple(row["features"]), words=tuple(row["words"]), sort=(row["sort"], row["descending"]) if row["sort"] else None,
        limit=(row["recommend_n"] or 8) if row["recommend"] else None, suggestions=suggestions,
    )
    scoped = q.features or q.near or suggestions or q.nations or q.water or q.archipelagos or q.recommend or q.ferry or q.types or q.subtypes or q.sort
    if not scoped and 4 <= len(sentence.strip()) <= 48 and 0 < len(q.words) <= 4:
        q.name = sentence.strip()
    return q


def answered(places: DataFrame, sentence: str, haystack: Column, words: Dictionaries | None = None, limit: int = 4, gazetteer: Mapping[str, tuple[float, float]] = PLACES) -> DataFrame:
    """The places that answer a sentence: what it asks for, scored, in order, and cut where they get irrelevant. A recommendation has as many as are asked for, or 8."""
    q = asked(places, sentence, words, gazetteer)
    return search_asked(places, q, q.limit or limit, haystack)


def water_in_question(sentence: str) -> str | None:
    """The water that a question names: 'in Loch Varn', 'on Lough Tolm'; not a mere kind of island."""
    m = re.search(r"\b(?:in|on|around|of|from) ((?:loch|lough|lake|llyn|river) [a-z][a-z'-]{1,24}(?: [a-z][a-z'-]{1,24}){0,2})", folded(sentence))
    if not m:
        return None
    phrase = re.sub(r"\b(?:and|with|that|which|near|islands?|the)\b.*$", "", m[1]).strip()
    return phrase if phrase and not re.fullmatch(r"(?:loch|lough|lake|llyn|river)(?: (?:isle|isles))?", phrase) else None


def suggestions_for(targets: DataFrame, gazetteer: DataFrame, target: str, place: str, most: int = 3) -> DataFrame:
    """(target, place, edits, rank): known places for a misspelt one, within two edits, or one of which begins the other (counted as one edit at most). Both are short lists of names; targets of 3 letters and more."""
    near = joins.small(gazetteer.select(place, text.fold(F.col(place)).alias("_g")))
    t = targets.select(target, text.fold(F.col(target)).alias("_t")).filter(F.length("_t") >= 3)
    # places meet targets over the first letter of either, or the rest of one without its first
    keys = lambda c: F.array_distinct(F.array(F.substring(c, 1, 1), F.substring(c, 2, 1), F.substring(c, 3, 1)))
    pairs = t.withColumn("_k", F.explode(keys("_t"))).join(near.withColumn("_k", F.explode(keys("_g"))), "_k").select(target, place, "_t", "_g").distinct()
    edits = text.banded_distance(F.col("_t"), F.col("_g"))
    begins = F.col("_g").startswith(F.col("_t")) | F.col("_t").startswith(F.col("_g"))
    rated = pairs.select(target, place, F.when(begins, F.least(edits, F.lit(1))).otherwise(edits).alias("edits")).filter("edits <= 2")
    return topk.per_group(rated, [target], [F.col("edits"), F.col(place)], most, "rank")


def superlatives(df: DataFrame, limit: int = 1) -> DataFrame:
    """(which, rank, id, value) of every superlative: largest, smallest, highest, lowest, most populous, most remote, and the four ends of the compass. Each is a top-k of its own."""
    km = F.least(*(haversine_km(F.lit(a), F.lit(b), F.col("lat"), F.col("lng")) for a, b in ANCHORS))
    c = F.col
    kinds = {
        "largest": (c("area"), True, c("area") > 0), "smallest": (c("area"), False, c("area") > 0), "highest": (c("elevation"), True, c("elevation").isNotNull()), "lowest": (c("elevation"), False, c("elevation") > 0),
        "most populous": (c("population").cast("double"), True, c("population") > 0), "most remote": (km, True, c("lat").isNotNull()), "northernmost": (c("lat"), True, c("lat").isNotNull()), "southernmost": (c("lat"), False, c("lat").isNotNull()), "easternmost": (c("lng"), True, c("lng").isNotNull()), "westernmost": (c("lng"), False, c("lng").isNotNull()),
    }
    out = None
    for which, (value, down, known) in kinds.items():
        best = df.filter(known).select("id", value.alias("value"))
        best = best.orderBy(c("value").desc() if down else c("value").asc(), "id").limit(limit).withColumn("which", F.lit(which))
        out = best if out is None else out.unionByName(best)
    return topk.per_group(out.withColumn("_v", F.when(F.col("which").isin(*[w for w, (_, down, _k) in kinds.items() if down]), -F.col("value")).otherwise(F.col("value"))), ["which"], [F.col("_v"), F.col("id")], limit, "rank").select("which", "rank", "id", "value")


def record_json(cited: DataFrame, most: int = 8, story: int = 600) -> DataFrame:
    """(id, record): a place and its cited stories as JSON without blank fields: numbers rounded, texts cut, and a note on what a missing population means."""
    blank = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    c = F.col
    stories = F.transform(F.slice("stories", 1, most), lambda s: F.struct(s["slug"].alias("collection"), s["title"].alias("title"), text.clip(blank(s["summary"]), story).alias("summary")))
    note = F.when(F.coalesce(c("population"), F.lit(0)) <= 0, "No population figure is recorded. That is not proof the island is uninhabited.")
    record = F.struct("id", blank(c("name")).alias("name"), "nation", "type", F.round("lat", 3).alias("lat"), F.round("lng", 3).alias("lng"), F.when(c("area") > 0, F.round("area", 2)).alias("area"), F.when(c("population") > 0, c("population")).alias("population"), note.alias("note"), text.clip(blank(c("description")), 40).alias("description"), F.when(F.size("stories") > 0, stories).alias("cited"), F.when(F.size("stories") > most, F.size("stories")).alias("citedTotal"))
    return cited.select("id", F.to_json(record).alias("record"))


_P, _I = PLACES_SQL, ITEMS_SQL
_EXTRA = "CAST(id % 4 AS INTEGER) AS ferry_n, id % 8 = 1 AS by_car, id % 4 IN (1, 2) AS all_year, id % 5 = 0 AS tagged"


def _asked(t):
    i = F.col("id")
    kinds = F.when(i % 8 == 1, F.array(F.lit("car-and-foot"))).otherwise(F.array(F.lit("foot-only")))
    return places(t).withColumns({"ferry_n": (i % 4).cast("int"), "ferry_kinds": kinds, "ferry_seasons": F.when((i % 4).isin(1, 2), F.array(F.lit("year-round"))).otherwise(F.array(F.lit("summer-only"))), "tags": F.when(i % 5 == 0, F.array(F.lit("castles"))).otherwise(F.array().cast("array<string>"))})


def _hay() -> Column:
    return F.concat_ws(" ", "name", "description", "archipelago", "water")


_HAY_SQL = "trim(regexp_replace(lower(strip_accents(concat_ws(' ', name, description, archipelago, water))), '[^a-z0-9]+', ' ', 'g'))"
_REST = "CASE WHEN has_photo THEN 0.6 ELSE 0 END + CASE WHEN coalesce(population, 0) <> 0 THEN 0.3 ELSE 0 END + CASE WHEN coalesce(area, 0) <> 0 THEN least(1.0, log10(1 + area)) ELSE 0 END"
_FROM = f"(SELECT *, {_HAY_SQL} AS hay, {_EXTRA} FROM {_P} x) p"


def _word(w: str, c: str = "hay") -> str:
    return f"contains(' ' || {c} || ' ', ' {w} ')"


@query(
    f"""SELECT id, round(CAST(6 + 6 + CASE WHEN tagged THEN 7 ELSE 3 + least(3, CAST(contains(hay, 'castle') AS INTEGER) + CAST(contains(hay, 'fort') AS INTEGER)) END + 3 + 6 + least(4, ferry_n) + CASE WHEN by_car THEN 1 ELSE 0 END + CASE WHEN all_year THEN 1 ELSE 0 END + {_REST} AS DOUBLE), 6) AS score
 FROM {_FROM} WHERE nation IN ('NATION_3', 'NATION_4', 'NATION_5', 'NATION_6', 'NATION_7') AND type IN ('sea', 'lake') AND ferry_n > 0 AND (tagged OR contains(hay, 'castle') OR contains(hay, 'fort')) AND ({_word('lighthouse')} OR {_word('beacon')}) AND coalesce(area, 0) >= 1"""
)
def question_scores(t):
    """Scores of every place for a question of facets, ferries, tags and features (R-02)."""
    q = Ask(nations=tuple(f"NATION_{i}" for i in range(3, 8)), types=("sea", "lake"), ferry=True, tags={"castles": ("castle", "fort")}, features=("lighthouse",), min_area=1)
    return _asked(t).select("id", F.round(question_score(q, _hay()), 6).alias("score")).filter("score is not null")


_KM = "2 * 6371.0 * asin(sqrt(pow(sin(radians(lat - 56.0) / 2), 2) + cos(radians(56.0)) * cos(radians(lat)) * pow(sin(radians(lng + 4.0) / 2), 2)))"
_RECOMMEND = "CASE WHEN coalesce(population, 0) > 500 THEN 2.2 WHEN coalesce(population, 0) > 50 THEN 1.6 WHEN coalesce(population, 0) > 0 THEN 1.1 ELSE 0 END + CASE WHEN length(coalesce(description, '')) > 100 THEN 1.8 WHEN length(coalesce(description, '')) > 50 THEN 1.0 ELSE 0 END + CASE WHEN has_photo THEN 1.8 ELSE 0 END + CASE WHEN coalesce(area, 0) > 200 THEN 1.6 WHEN coalesce(area, 0) > 30 THEN 0.9 ELSE 0 END + CASE WHEN wikipedia IS NOT NULL THEN 0.5 ELSE 0 END"


def _cut(scored: str, order: str, floor: float, share: float, most: int) -> str:
    """The cutoff in SQL: the first row's score, those that reach the floor, and the walk to the first one that is too far below."""
    return f"""WITH s AS ({scored}), t AS (SELECT score AS top FROM s ORDER BY {order} LIMIT 1), f AS (SELECT s.*, top, row_number() OVER (ORDER BY {order}) AS r FROM s, t WHERE score >= greatest({floor}, top * {share}) ORDER BY {order} LIMIT {most}),
 g AS (SELECT *, bool_or(r > 1 AND top - score > 7) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stop FROM f) SELECT id, round(score, 6) AS score FROM g WHERE NOT stop"""


@query(_cut(f"SELECT id, lower(name) AS n, CAST(6 * (1 - {_KM} / 250) + 4 + {_RECOMMEND} + {_REST} AS DOUBLE) AS score FROM {_FROM} WHERE archipelago IN ('Outer Isles', 'Inner Isles') AND {_KM} <= 250 AND id <> 12 AND (coalesce(area, 0) >= 3 OR coalesce(population, 0) > 0 OR coalesce(source = 'curated', false) OR (has_photo AND coalesce(area, 0) >= 0.8))", "score DESC, n, id", 9, 0.78, 8))
def question_recommended(t):
    """Islands worth a visit near a place, cut where they get irrelevant (Q-08, R-02, W-04, W-01)."""
    q = Ask(archipelagos=("Outer Isles", "Inner Isles"), near=(56.0, -4.0, 250.0, 12), recommend=True)
    return search_asked(_asked(t), q, 8, _hay()).select("id", F.round("score", 6).alias("score"))


@query(_cut(f"SELECT id, area, CAST(6 + 3 + {_REST} AS DOUBLE) AS score FROM {_FROM} WHERE type = 'lake' AND ({_word('castle')} OR {_word('fortress')} OR {_word('tower house')} OR {_word('keep')}) AND has_photo AND NOT coalesce(confidence = 'unconfirmed', false) AND area > 0", "area DESC, id", 7, 0.65, 12))
def question_sorted(t):
    """The largest with a castle, in order of size (Q-08, W-05)."""
    q = Ask(types=("lake",), features=("castle",), photo=True, sure=True, sort=("area", True))
    return search_asked(_asked(t), q, 12, _hay()).select("id", F.round("score", 6).alias("score"))


@query(_cut(f"SELECT id, lower(name) AS n, CAST(8 + CASE WHEN {_word('skarva', 'nm')} THEN 5 WHEN {_word('skarva')} THEN 1 ELSE 0 END + CASE WHEN {_word('skarva', 'nm')} THEN 4 ELSE 0 END + {_REST} AS DOUBLE) AS score FROM (SELECT *, trim(regexp_replace(lower(strip_accents(name)), '[^a-z0-9]+', ' ', 'g')) AS nm FROM {_FROM}) z WHERE contains(lower(coalesce(water, '')), 'loch varn') AND ({_word('skarva', 'nm')} OR {_word('skarva')})", "score DESC, n, id", 7, 0.65, 10))
def question_in_water(t):
    """Islands of a name in a water that the question names (Q-04, Q-08)."""
    water = water_in_question("Which islands called Skarva are in Loch Varn and near?")
    return search_asked(_asked(t), Ask(water=water, words=("skarva",)), 10, _hay()).select("id", F.round("score", 6).alias("score"))


@query(rf"SELECT id, 1.0 AS score FROM {_P} p WHERE id = (SELECT first(id ORDER BY levenshtein('skarvo', b), -coalesce(area, 0), id) FROM (SELECT id, area, trim(regexp_replace(regexp_replace(lower(strip_accents(name)), '\b(?:the|isle of|island of)\b', ' ', 'g'), '\s+', ' ', 'g')) AS b FROM {_P} x) q WHERE b <> '' AND levenshtein('skarvo', b) <= 1)")
def question_misspelt(t):
    """A misspelt name, when nothing else fits (Q-08, J-26)."""
    return search_asked(_asked(t), Ask(words=("skarvo",), name="Skarvo"), 4, _hay()).select("id", "score")


@query(
    """SELECT target, place, edits, rank FROM (SELECT target, place, edits, CAST(row_number() OVER (PARTITION BY target ORDER BY edits, place) AS INTEGER) AS rank FROM (SELECT target, n_name AS place, CAST(CASE WHEN starts_with(lower(n_name), target) OR starts_with(target, lower(n_name)) THEN least(levenshtein(target, lower(n_name)), 1) ELSE levenshtein(target, lower(n_name)) END AS INTEGER) AS edits
 FROM nation, (VALUES ('nation_1'), ('nativn_12'), ('nowhere'), ('ation_7')) v(target)) q WHERE edits <= 2) r WHERE rank <= 3"""
)
def suggested_places(t):
    """Known places for misspelt ones (J-27, Q-05)."""
    words = t("region").filter("r_regionkey = 0").select(F.explode(F.array(*map(F.lit, ("nation_1", "nativn_12", "nowhere", "ation_7")))).alias("target"))
    return suggestions_for(words, t("nation").select(F.col("n_name").alias("place")), "target", "place").select("target", "place", "edits", "rank")


def _sup(which: str, value: str, known: str, down: bool) -> str:
    return f"(SELECT '{which}' AS which, CAST(1 AS INTEGER) AS rank, id, round(CAST({value} AS DOUBLE), 6) AS value FROM {_P} p WHERE {known} ORDER BY {value} {'DESC' if down else ''}, id LIMIT 1)"


_FAR = "least(" + ", ".join(f"2 * 6371.0 * asin(sqrt(pow(sin(radians(lat - {a}) / 2), 2) + cos(radians(CAST({a} AS DOUBLE))) * cos(radians(lat)) * pow(sin(radians(lng - ({b})) / 2), 2)))" for a, b in ANCHORS) + ")"


@query(" UNION ALL ".join([_sup("largest", "area", "area > 0", True), _sup("smallest", "area", "area > 0", False), _sup("highest", "elevation", "elevation IS NOT NULL", True), _sup("lowest", "elevation", "elevation > 0", False), _sup("most populous", "population", "population > 0", True), _sup("most remote", _FAR, "lat IS NOT NULL", True), _sup("northernmost", "lat", "lat IS NOT NULL", True), _sup("southernmost", "lat", "lat IS NOT NULL", False), _sup("easternmost", "lng", "lng IS NOT NULL", True), _sup("westernmost", "lng", "lng IS NOT NULL", False)]))
def all_superlatives(t):
    """Every superlative that a question may ask for (A-04)."""
    return superlatives(places(t)).withColumn("value", F.round("value", 6))


def _meant(name: str) -> str:
    """The place that a name means best, in SQL."""
    fit = f"CASE WHEN nm = '{name}' THEN 100 WHEN starts_with(nm, '{name}') OR starts_with('{name}', nm) THEN 50 + least(length(nm), {len(name)}) WHEN contains(nm, '{name}') OR contains('{name}', nm) THEN 20 + least(length(nm), {len(name)}) END"
    return f"(SELECT name, area FROM (SELECT *, trim(regexp_replace(lower(strip_accents(name)), '^(?:the |isle of |island of )', '')) AS nm FROM {_P} x) q WHERE nm <> '' AND (contains(nm, '{name}') OR contains('{name}', nm)) ORDER BY {fit} + least(5.0, log10(1 + coalesce(area, 0))) + least(3.0, log10(1 + CAST(coalesce(population, 0) AS DOUBLE))) DESC, id LIMIT 1)"


@query(f"SELECT a.name AS a, a.area AS a_value, b.name AS b, b.area AS b_value, round(greatest(a.area, b.area) / nullif(least(a.area, b.area), 0), 2) AS ratio FROM {_meant('tolm island')} a, {_meant('hesker')} b")
def compare_two(t):
    """Two places by name, each looked up among all (A-05, J-25)."""
    return compare(places(t), parse("compare tolm island and isle of hesker", []).names)


@query(f"SELECT slug AS category, count(DISTINCT place) AS places, count(*) AS entries FROM {_I} i WHERE status = 'accepted' GROUP BY slug")
def distinct_per_category(t):
    """Collections with their places and entries (A-11, Q-11)."""
    return collections(items(t).withColumnRenamed("slug", "category"))


@query(f"SELECT id, json_extract_string(j, '$.name') AS name, CAST(json_extract_string(j, '$.lat') AS DOUBLE) AS lat, json_extract_string(j, '$.note') IS NOT NULL AS noted, CAST(json_extract_string(j, '$.total') AS INTEGER) AS total FROM (SELECT id, json_object('name', nullif(name, ''), 'lat', round(lat, 3), 'note', CASE WHEN coalesce(population, 0) <= 0 THEN 'x' END, 'total', CASE WHEN n > 2 THEN n END) AS j FROM {_P} p LEFT JOIN (SELECT place, count(*) AS n FROM {_I} i GROUP BY place) c ON p.id = c.place) q")
def read_records(t):
    """Records as JSON without blank fields (Q-12, P-52, P-53)."""
    cited = items(t).groupBy("place").agg(F.array_sort(F.collect_list(F.struct("item", "slug", "title", "summary"))).alias("stories"))
    p = places(t).join(cited.withColumnRenamed("place", "id"), "id", "left").withColumn("stories", F.coalesce("stories", F.array().cast(cited.schema["stories"].dataType)))
    j = record_json(p, 2)
    get = lambda k: F.get_json_object("record", f"$.{k}")
    return j.select("id", get("name").alias("name"), get("lat").cast("double").alias("lat"), get("note").isNotNull().alias("noted"), get("citedTotal").cast("int").alias("total"))


@query(f"SELECT id FROM (SELECT id, row_number() OVER (ORDER BY CASE WHEN nm = 'mirren' THEN 100 WHEN starts_with(nm, 'mirren') OR starts_with('mirren', nm) THEN 50 + least(length(nm), 6) WHEN contains(nm, 'mirren') OR contains('mirren', nm) THEN 20 + least(length(nm), 6) END + least(5.0, log10(1 + coalesce(area, 0))) + least(3.0, log10(1 + CAST(coalesce(population, 0) AS DOUBLE))) DESC, id) AS r FROM (SELECT *, trim(regexp_replace(lower(strip_accents(name)), '^(?:the |isle of |island of )', '')) AS nm FROM {_P} x) p WHERE nm <> '' AND (contains(nm, 'mirren') OR contains('mirren', nm))) q WHERE r = 1")
def question_lookup(t):
    """What is known of a place by its name (J-25, Q-06, Q-07)."""
    return lookup(places(t), "Mirren").select("id")


# duplicates
_DUP = f"SELECT id, name, nation, area, map_type, map_id, water AS parent, lat, lng, source, has_photo, wikidata, wikipedia, description FROM {_P} p WHERE name <> ''"


def _doubles(t) -> DataFrame:
    p = places(t).filter("name <> ''").select(F.col("id"), "name", "nation", "area", "map_type", "map_id", F.col("water").alias("parent"), "lat", "lng", "source", "has_photo", "wikidata", "wikipedia", "description")
    copy = p.filter("id % 3 = 0").withColumns({"id": F.col("id") + 1_000_000, "lat": F.col("lat") + 0.0001, "map_id": F.when(F.col("id") % 2 == 0, F.col("map_id")).otherwise(F.col("map_id") + 1), "area": F.col("area") * F.when(F.col("id") % 5 == 0, 1.5).otherwise(1.01), "source": F.lit("discovery")})
    return p.unionByName(copy).withColumn("curated", F.col("source") == "curated")


def _glued(words) -> str:
    return "CASE " + " ".join(f"WHEN starts_with(x, '{w}') AND length(x) > {len(w) + 2} THEN '{w}'" for w in words) + " END"


_QUALIFIERS = "[" + ", ".join(f"'{w}'" for w in text.QUALIFIERS) + "]"
_FILLED = "CAST(trim(coalesce({}, '')) <> '' AS INTEGER)"
#: The rules of pairs, groups and keepers over all records and their doubles.
_DOUBLES_SQL = rf"""WITH RECURSIVE d AS (SELECT * FROM ({_DUP}) a UNION ALL SELECT id + 1000000, name, nation, area * CASE WHEN id % 5 = 0 THEN 1.5 ELSE 1.01 END, map_type, CASE WHEN id % 2 = 0 THEN map_id ELSE map_id + 1 END, parent, lat + 0.0001, lng, 'discovery', has_photo, wikidata, wikipedia, description FROM ({_DUP}) b WHERE id % 3 = 0),
 e AS (SELECT *, trim(regexp_replace(regexp_replace(replace(lower(strip_accents(name)), chr(39), ' '), '\([^)]*\)|[^a-z0-9]+', ' ', 'g'), '\s+', ' ', 'g')) AS plain FROM d),
 f AS (SELECT *, trim(regexp_replace(regexp_replace(plain, '\b(?:{"|".join(text.CORE_DROPS)})\b', ' ', 'g'), '\s+', ' ', 'g')) AS simple FROM e),
 g AS (SELECT *, list_distinct(list_filter(string_split(simple, ' '), lambda x: x <> '')) AS words FROM f),
 h AS (SELECT *, list_sort(list_distinct(list_concat(list_filter(words, lambda x: list_contains({_QUALIFIERS}, x)), list_filter(list_transform(words, lambda x: {_glued(text.GLUED)}), lambda x: x IS NOT NULL)))) AS quals, list_filter(words, lambda x: NOT list_contains({_QUALIFIERS}, x)) AS core, 1000 * sqrt(coalesce(area, 0) / pi()) AS r FROM g),
 near AS (SELECT a.id AS u, b.id AS v, a.nation AS na, b.nation AS nb, coalesce(a.area, 0) AS aa, coalesce(b.area, 0) AS ab, a.r AS ra, b.r AS rb, a.map_type = b.map_type AND a.map_id = b.map_id AS one_object,
  2000 * 6371.0 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2))) AS m,
  CASE WHEN a.simple = '' OR b.simple = '' OR a.quals <> b.quals THEN NULL WHEN a.simple = b.simple OR (len(a.core) > 0 AND len(b.core) > 0 AND (list_has_all(b.core, a.core) OR list_has_all(a.core, b.core))) THEN 'exact' WHEN levenshtein(a.simple, b.simple) <= 2 AND least(length(a.simple), length(b.simple)) >= 6 THEN 'close' END AS names
  FROM h a JOIN h b ON a.id < b.id AND abs(a.lat - b.lat) < 0.005),
 rated AS (SELECT u, v, CASE WHEN coalesce(one_object, false) THEN 'same-osm-object' WHEN na <> nb AND m > 40 THEN NULL
  WHEN aa > 0 AND ab > 0 THEN CASE WHEN greatest(aa, ab) / least(aa, ab) <= 1.03 AND m <= CASE WHEN names IS NULL THEN greatest(8, 0.25 * least(ra, rb)) ELSE greatest(12, 0.08 * least(ra, rb)) END THEN 'same-outline'
   WHEN names = 'exact' AND greatest(aa, ab) / least(aa, ab) <= 1.25 AND m <= least(250, greatest(30, 0.35 * least(ra, rb))) AND m < 0.8 * (ra + rb) THEN 'same-name' WHEN names = 'close' AND greatest(aa, ab) / least(aa, ab) <= 1.08 AND m <= least(120, greatest(20, 0.25 * least(ra, rb))) THEN 'close-name' END
  WHEN (aa > 0) <> (ab > 0) AND names IS NOT NULL AND NOT (names = 'close' AND m > 30) AND m <= least(80, greatest(35, 0.4 * greatest(ra, rb))) THEN 'point-and-outline' END AS reason FROM near WHERE m <= 500),
 pairs AS (SELECT * FROM rated WHERE reason IS NOT NULL), both_ways AS (SELECT u, v FROM pairs UNION SELECT v, u FROM pairs), reach(a, b) AS (SELECT u, v FROM both_ways UNION SELECT reach.a, both_ways.v FROM reach JOIN both_ways ON reach.b = both_ways.u),
 member AS (SELECT a AS id, min(least(a, b)) AS component FROM reach GROUP BY a), box AS (SELECT component, min(lat) AS s, max(lat) AS n, min(lng) AS w, max(lng) AS e, min(CASE WHEN area > 0 THEN r END) AS r, count(*) FILTER (WHERE source = 'curated') AS c FROM member JOIN h USING (id) GROUP BY component),
 good AS (SELECT component FROM box WHERE c <= 1 AND 2000 * 6371.0 * asin(sqrt(pow(sin(radians(n - s) / 2), 2) + cos(radians(s)) * cos(radians(n)) * pow(sin(radians(e - w) / 2), 2))) <= greatest(100, 0.45 * coalesce(r, 0))),
 kept AS (SELECT component, first(id ORDER BY CAST(source = 'curated' AS INTEGER) DESC, CAST(coalesce(area, 0) > 0 AS INTEGER) DESC, {_FILLED.format("wikidata")} DESC, {_FILLED.format("wikipedia")} DESC, CAST(has_photo AS INTEGER) DESC, CAST(coalesce(map_type = 'relation', false) AS INTEGER) DESC, CAST(source IN ('osm', 'curated', 'wikidata') AS INTEGER) DESC, {_FILLED.format("description")} DESC, CAST(source <> 'discovery' AS INTEGER) DESC, id DESC) AS keeper FROM member JOIN h USING (id) WHERE component IN (SELECT component FROM good) GROUP BY component)"""


@query(f"{_DOUBLES_SQL} SELECT u, v, reason FROM pairs")
def duplicate_pairs(t):
    """Pairs of records that are one place, with the reason (G-03, J-10, P-06, P-07)."""
    return resolve.duplicate_pairs(_doubles(t))


@query(f"{_DOUBLES_SQL} SELECT id AS old, keeper AS new FROM member JOIN kept USING (component) WHERE id <> keeper")
def retired_doubles(t):
    """Ids that give way to their keepers (G-01, G-02, U-05, W-06)."""
    return resolve.resolve(_doubles(t))[1]


_CLAIM = "lat + CASE id % 4 WHEN 0 THEN 0.0005 WHEN 1 THEN 0.00001 WHEN 2 THEN 0.0009 ELSE 0.0004 END"
_OTHERS = f"(SELECT id, lat, lng, area FROM {_P} a UNION ALL SELECT id + 1000000, lat + 0.0005, lng, area * (1 + id % 3 / 2.0) FROM {_P} b)"


@query(
    f"""SELECT DISTINCT c.id FROM (SELECT id, {_CLAIM} AS clat, lat, lng, area FROM {_P} p) c JOIN {_OTHERS} o ON o.id <> c.id AND abs(o.lat - c.clat) < 0.001 WHERE (c.clat - c.lat) * 111.19 > 0.015 AND o.area >= 1.5 * c.area
 AND 2 * 6371.0 * asin(sqrt(pow(sin(radians(o.lat - c.clat) / 2), 2) + cos(radians(c.clat)) * cos(radians(o.lat)) * pow(sin(radians(o.lng - c.lng) / 2), 2))) <= 0.08"""
)
def borrowed_names(t):
    """Names taken from a source point that lies at another, larger place (M-05)."""
    p = places(t).select("id", "lat", "lng", "area")
    others = p.select((F.col("id") + 1_000_000).alias("id"), (F.col("lat") + 0.0005).alias("lat"), "lng", (F.col("area") * (1 + F.col("id") % 3 / 2.0)).alias("area"))
    return resolve.borrowed_names(p.unionByName(others), p.select("id", F.expr(_CLAIM).alias("lat"), "lng"))


@query(f"SELECT item FROM {_I} i WHERE status = 'accepted' AND item % 4 <> 0 AND slug IN ('unusual-news', 'island-books')")
def public_rows(t):
    """Accepted rows of published categories that are not deleted (F-34)."""
    rows = items(t).withColumn("deleted_at", F.when(F.col("item") % 4 == 0, F.current_timestamp()))
    published = t("region").filter("r_regionkey < 3").select(F.when(F.col("r_regionkey") == 0, "unusual-news").when(F.col("r_regionkey") == 1, "island-books").otherwise("island-castles").alias("slug"), (F.col("r_regionkey") < 2).alias("published"))
    return filters.visible(rows, published, "slug").select("item")


@query(
    f"""SELECT id, CASE WHEN source = 'curated' THEN 'curated' WHEN name <> '' THEN 'already named' WHEN id % 6 = 0 THEN 'unusable' WHEN id % 5 = 0 THEN 'tier D' WHEN id % 400 > CASE id % 4 WHEN 0 THEN 150 WHEN 1 THEN 200 ELSE 500 END THEN 'too far' WHEN 70 + CASE WHEN id % 4 = 0 THEN 5 ELSE 0 END + CASE WHEN id % 400 <= 50 THEN 5 WHEN id % 400 > 300 THEN -15 ELSE 0 END < 75 THEN 'score' WHEN id % 7 = 0 THEN 'no licence' ELSE 'ok' END AS reason FROM {_P} p"""
)
def name_gates(t):
    """Why a proposed name is taken or not: the first reason (F-26, R-20)."""
    i = F.col("id")
    tier = F.when(i % 5 == 0, "D").when(i % 4 == 0, "A").when(i % 4 == 1, "B").otherwise("C")
    most = F.when(i % 4 == 0, 150).when(i % 4 == 1, 200).otherwise(500)
    score = scores.staged_name_score(F.lit("medium"), F.when(i % 4 == 0, "A").otherwise("B"), F.lit(False), i % 400)
    rules = [("curated", F.col("source") == "curated"), ("already named", F.col("name") != ""), ("unusable", i % 6 == 0), ("tier D", tier == "D"), ("too far", i % 400 > most), ("score", score < 75), ("no licence", i % 7 == 0)]
    return places(t).select("id", filters.first_reason(rules, "ok").alias("reason"))


@query(f"SELECT slug, place, score FROM (SELECT slug, place, count(*) AS score, row_number() OVER (PARTITION BY slug ORDER BY count(*) DESC, place) AS r FROM {_I} i GROUP BY slug, place) q WHERE r <= 2")
def top_places(t):
    """The places with most stories of each interest (A-12, W-19)."""
    n = items(t).groupBy("slug", "place").agg(F.count("*").alias("score"))
    return topk.per_group(n, ["slug"], [F.desc("score"), F.col("place")], 2).drop("rank")
