"""Queries that begin with sentences: what a log of questions asks for, and single questions from their words to their answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sentences as s
from ..functions.text import fold
from ..operators.tables import durable
from .asking import _FROM, _KM, _RECOMMEND, _REST, _asked, _cut, _hay, _word, answered
from .base import pick
from .registry import plain, query

_AT = "CAST(floor(o_orderkey / {0}) AS BIGINT)"
#: A question of each order, of four parts.
QUESTIONS = f"""SELECT o_orderkey AS id, {pick("o_orderkey", "Largest sea islands", "Islands worth visiting", "Give me five", "Ferry islands", "Uninhabited islands", "Crannogs", "Best 7 islands", "big islands", "Tidal loch islands")}
 || {pick(_AT.format(9), "", " with a castle", " with photos and puffins", " with a summit, elevation known", " over 12.5 km²", " smaller than 3 sq km", " for sale", " and a white-tailed eagle")}
 || {pick(_AT.format(72), "", " in Scotland", " in Northern Ireland", " in Ireland", " in the Hebrides", " in Loch Lomond", " in the Western Isles", " of the Highlands", " in Éire")}
 || {pick(_AT.format(648), "", " near Oban", " near Obn?", " within 20 miles of the Port Ellen", " within 30 km of Tober", " close to Port", " by car ferries from Mallaig to Rum", " with CalMac year-round", " near Scotland hide unconfirmed")} AS sentence FROM {{orders}}"""


def _words(ws) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in ws) + "]"


def _facets(facets) -> str:
    table = "[" + ", ".join(f"{{'v': '{v}', 'w': {_words(ws)}}}" for v, ws in facets.items()) + "]"
    return f"list_transform(list_filter({table}, lambda f: len(list_filter(f.w, lambda w: contains(txt, w))) > 0), lambda f: f.v)"


def _has(name: str, text: str = "txt") -> str:
    return f"regexp_matches({text}, '{s.PATTERNS[name]}')".replace("a-z'", "a-z''").replace("a-z' -", "a-z'' -")


def _part(name: str, group: int = 1) -> str:
    return "nullif(regexp_extract(txt, '" + s.PATTERNS[name].replace("'", "''") + f"', {group}), '')"


def _nation(n: str, text: str = "txt") -> str:
    return f"CASE WHEN regexp_matches({text}, '(?:^|[^a-z0-9])(?:{'|'.join(s.NATIONS[n])})(?:$|[^a-z0-9])') THEN '{n}' END"


_COUNT = "coalesce(" + ", ".join(f"nullif(regexp_extract(txt, '{p}', 1), '')" for p in s.COUNTS) + ")"
_ALL = s.Dictionaries().words()
_READ = f"""WITH a AS (SELECT id, trim(replace(lower(strip_accents(sentence)), '²', '2')) AS txt FROM ({plain(QUESTIONS)}) x),
 b AS (SELECT *, list_distinct(list_filter([{", ".join(_nation(n) for n in list(s.NATIONS)[:5])}, {_nation("Ireland", "replace(txt, 'northern ireland', ' ')")}, CASE WHEN regexp_matches(txt, '\\bhighlands?\\b') THEN 'Scotland' END], lambda x: x IS NOT NULL)) AS nations,
  nullif(trim(regexp_replace(regexp_extract(txt, '{s.PATTERNS["water"].replace("'", "''")}', 1), '\\b(?:and|with|that|which|near|islands?|the)\\b.*$', '')), '') AS water, {_facets(s.TYPES)} AS kinds, {_facets(s.SUBTYPES)} AS subtypes, {_facets(s.ARCHIPELAGOS)} AS arch, {_facets(s.FEATURES)} AS feats, {_COUNT} AS cnt,
  trim(regexp_replace(regexp_replace(trim(coalesce({_part("within", 3)}, {_part("near")}, '')), '^the\\s+', ''), '[?.!]+$', '')) AS want FROM a),
 c AS (SELECT *, coalesce(TRY_CAST(cnt AS INTEGER), nullif(list_position({_words(s.NUMBERS)}, cnt), 0)) AS n, CASE WHEN list_contains(feats, 'uninhabited') THEN list_filter(feats, lambda x: x <> 'inhabited') ELSE feats END AS features,
  CASE WHEN {_has("on foot")} THEN 'foot-only' WHEN {_has("by car")} THEN 'car-and-foot' END AS kind, CASE WHEN {_has("all year")} THEN 'year-round' WHEN {_has("in summer")} THEN 'summer-only' END AS season, list_filter({_words(s.OPERATORS)}, lambda o: contains(txt, o))[1] AS operator, trim({_part("port")}) AS port,
  CASE WHEN regexp_matches(txt, '\\bhebrid(?:es|ean)\\b') AND NOT regexp_matches(txt, '\\b(?:inner\\s+hebrides|outer\\s+hebrides|western\\s+isles)\\b') THEN list_distinct(list_concat(arch, ['Inner Hebrides', 'Outer Hebrides'])) ELSE arch END AS archipelagos FROM b),
 d AS (SELECT *, {_has("recommend")} OR coalesce(n BETWEEN 1 AND 25 AND len(archipelagos) + len(nations) > 0, false) AS recommend FROM c)"""


def _log(t):
    """The log, and each of its sentences once: equal sentences ask for the same."""
    log = durable(t.sql(QUESTIONS), "questions")
    return log, s.with_facets(log.select("sentence").distinct(), "sentence")


@query(
    f"""{_READ} SELECT id, list_aggregate(list_sort(nations), 'string_agg', '|') AS nations, list_aggregate(list_sort(CASE WHEN recommend AND len(kinds) = 0 AND len(features) = 0 AND water IS NULL THEN ['sea'] WHEN water IS NOT NULL THEN list_filter(kinds, lambda x: x NOT IN ('lake', 'river')) ELSE kinds END), 'string_agg', '|') AS types,
 list_aggregate(list_sort(subtypes), 'string_agg', '|') AS subtypes, list_aggregate(list_sort(archipelagos), 'string_agg', '|') AS archipelagos, list_aggregate(list_sort(features), 'string_agg', '|') AS features, water, CASE WHEN contains(txt, 'largest') THEN 'area' END AS sort, {_has("ferry")} OR coalesce(kind, season, operator, port) IS NOT NULL AS ferry, kind AS ferry_kind, season AS ferry_season, operator AS ferry_operator, port AS ferry_port,
 recommend, CASE WHEN n BETWEEN 1 AND 25 THEN CAST(n AS INTEGER) END AS recommend_n, CAST({_part("smaller")} AS DOUBLE) AS max_area, coalesce(CAST({_part("larger")} AS DOUBLE), CASE WHEN {_has("large")} THEN 10.0 END) AS min_area, {_has("photo")} AS photo, {_has("elevation")} AS elevation, {_has("sure")} AS sure,
 CASE WHEN length(want) >= 3 AND NOT regexp_matches(want, '{s.NOT_NEAR}') THEN want END AS near, round(coalesce(CAST({_part("within")} AS DOUBLE) * CASE WHEN {_part("within", 2)} LIKE 'mi%' THEN 1.60934 ELSE 1 END, 100.0), 6) AS near_km,
 list_aggregate(list_filter(string_split_regex(list_reduce(list_prepend(CASE WHEN list_contains(nations, 'Northern Ireland') THEN replace(CASE WHEN water IS NULL THEN ' ' || txt || ' ' ELSE replace(' ' || txt || ' ', water, ' ') END, 'northern ireland', ' ') WHEN water IS NULL THEN ' ' || txt || ' ' ELSE replace(' ' || txt || ' ', water, ' ') END, {_words(_ALL)}), lambda r, w: replace(r, ' ' || w || ' ', ' ')), '[^a-z0-9''-]+'), lambda w: length(w) >= 3), 'string_agg', '|') AS words FROM d"""
)
def question_facets(t):
    """What each sentence of a log asks for (Q-01 to Q-04)."""
    log, read = _log(t)
    text = lambda c: F.nullif(F.array_join(F.sort_array(c), "|"), F.lit("")).alias(c)
    lists = ("nations", "types", "subtypes", "archipelagos", "features")
    read = durable(read.select(F.col("sentence").alias("_read"), *map(text, lists), "water", "sort", "ferry", "ferry_kind", "ferry_season", "ferry_operator", "ferry_port", "recommend", "recommend_n", "max_area", "min_area", "photo", "elevation", "sure", "near", F.round("near_km", 6).alias("near_km"), F.nullif(F.array_join("words", "|"), F.lit("")).alias("words")), "read-sentences")
    return log.join(read, F.col("sentence").eqNullSafe(F.col("_read")), "left").drop("sentence", "_read")


_GAZETTEER = "(VALUES " + ", ".join(f"('{k}', {a}, {b})" for k, (a, b) in s.PLACES.items()) + ") g(place, lat, lng)"


@query(f"{_READ}, h AS (SELECT id, g.place, lower(g.place) <> want AS longer FROM d JOIN {_GAZETTEER} ON (lower(g.place) = want OR (length(want) >= 4 AND starts_with(lower(g.place), want))) AND NOT regexp_matches(want, '{s.NOT_NEAR}') WHERE length(want) >= 3) SELECT id, first(place ORDER BY longer, place) AS place FROM h GROUP BY id HAVING count(*) = 1 OR NOT bool_and(longer)")
def question_near(t):
    """The known place that each sentence is near to, by name or as the only one that begins so (Q-05)."""
    log, read = _log(t)
    gazetteer = t.spark.createDataFrame([(k, *v) for k, v in s.PLACES.items()], "place string, lat double, lng double")
    words = durable(read.select("sentence", "near"), "near-words")
    near = s.near_places(words, "sentence", gazetteer).join(words, "sentence").select("sentence", "place", (fold(F.col("place")) != F.col("near")).alias("longer"))
    # rows of one id are one sentence; a beginning counts if it stands there once
    found = log.join(durable(near, "near-sentences"), "sentence").groupBy("id", "place", "longer").count()
    return found.filter("count = 1 or not longer").select("id", "place")


#: The made places have nations and groups of their own.
OWN = s.Dictionaries(nations={"NATION_3": ("third nation",), "NATION_13": ("thirteenth nation",), "NATION_4": ("fourth nation",)}, archipelagos={"Outer Isles": ("outer isles",), "Inner Isles": ("inner isles",)}, tags={"castles": ("castle", "castles", "stronghold")})


def _routed(t):
    i = F.col("id")
    ports = F.when(i % 3 == 0, F.array(F.lit("Oban Pier"), F.lit("Rum"))).otherwise(F.array(F.lit("Mallaig")))
    # a table, so that its rows are not made anew in each expression over them
    return durable(_asked(t), "asked").withColumns({"ferry_operators": F.when(i % 2 == 0, F.array(F.lit("Calmac Ltd"))).otherwise(F.array(F.lit("Other"))), "ferry_ports": ports})


def _scores(words: tuple[str, ...]) -> str:
    """Points of search words, and whether one of them is in a name or text."""
    return " + ".join(f"CASE WHEN {_word(w, 'nm')} THEN 5 WHEN {_word(w)} THEN 1 ELSE 0 END" for w in words) + f" + CASE WHEN {' AND '.join(_word(w, 'nm') for w in words)} THEN 4 ELSE 0 END"


_NAMED = f"(SELECT *, trim(regexp_replace(lower(strip_accents(name)), '[^a-z0-9]+', ' ', 'g')) AS nm FROM {_FROM}) z"


@query(_cut(f"SELECT id, lower(name) AS n, CAST(4 + 6 * (1 - {_KM.replace('56.0', '56.623').replace('lng + 4.0', 'lng + 6.069')} / 100) + {_scores(('give', 'five', 'tobermory'))} + {_RECOMMEND} + {_REST} AS DOUBLE) + 6 AS score FROM {_NAMED} WHERE type = 'sea' AND archipelago = 'Outer Isles' AND {_KM.replace('56.0', '56.623').replace('lng + 4.0', 'lng + 6.069')} <= 100 AND (coalesce(area, 0) >= 3 OR coalesce(population, 0) > 0 OR coalesce(source = 'curated', false) OR (has_photo AND coalesce(area, 0) >= 0.8))", "score DESC, n, id", 9, 0.78, 5))
def asked_recommended(t):
    """From the sentence to five islands worth a visit (Q-01, Q-05, Q-08, R-02)."""
    return answered(_routed(t), "Give me five islands worth visiting in the outer isles near Tobermory", _hay(), OWN).select("id", F.round("score", 6).alias("score"))


@query(_cut(f"SELECT id, area, CAST(6 + 4 + 3 + CASE WHEN tagged THEN 7 ELSE 3 + least(3, CAST(contains(hay, 'castle') AS INTEGER) + CAST(contains(hay, 'castles') AS INTEGER) + CAST(contains(hay, 'stronghold') AS INTEGER)) END + {_scores(('unconfirmed', 'hide'))} + {_REST} AS DOUBLE) AS score FROM {_NAMED} WHERE type = 'lake' AND has_photo AND NOT coalesce(confidence = 'unconfirmed', false) AND ({_word('castle')} OR {_word('fortress')} OR {_word('tower house')} OR {_word('keep')}) AND (tagged OR contains(hay, 'castle')) AND area > 0", "area DESC, id", 7, 0.65, 6))
def asked_largest(t):
    """From the sentence to the largest with a castle and a photo (Q-01, Q-02, W-05)."""
    return answered(_routed(t), "Largest loch islands with a castle and photos hide unconfirmed", _hay(), OWN, 6).select("id", F.round("score", 6).alias("score"))


@query(_cut(f"SELECT id, lower(name) AS n, CAST(6 + 6 + least(4, ferry_n) + CASE WHEN by_car THEN 1 ELSE 0 END + CASE WHEN all_year THEN 1 ELSE 0 END + 3 + {_scores(('year-round', 'oban', 'third', 'nation'))} + {_REST} AS DOUBLE) AS score FROM {_NAMED} WHERE nation = 'NATION_3' AND ferry_n > 0 AND ferry AND all_year AND id % 2 = 0 AND id % 3 = 0", "score DESC, n, id", 7, 0.65, 9))
def asked_ferries(t):
    """From the sentence to islands by routes: season, operator and port (Q-01, R-02)."""
    return answered(_routed(t), "year-round calmac ferries from oban in the third nation", _hay(), OWN, 9).select("id", F.round("score", 6).alias("score"))
