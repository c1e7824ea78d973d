"""Queries of rank models and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import interest, scores
from .base import ITEMS_SQL, PLACES_SQL, items, places
from .registry import query

_P, _I = PLACES_SQL, ITEMS_SQL


def _ranked_places(t):
    return places(t).select(F.col("id").alias("place"), "name", "type", "area", "population", "elevation", F.col("has_photo").alias("has_image"))


def _cited(t):
    return items(t).select("item", "place", "slug", "title", "summary", "facet", "picture")


_BARE = r"trim(regexp_replace(regexp_replace(lower(strip_accents(name)), '\([^)]*\)', ' ', 'g'), '\s+', ' ', 'g'))"
_WORDS = "list_filter(string_split_regex(bare, '[^a-z0-9]+'), lambda x: length(x) >= 5 AND NOT list_contains(['island', 'islands', 'isles', 'unnamed'], x))"


def _mentions(hay: str) -> str:
    return f"((length(bare) >= 4 AND contains({hay}, bare)) OR (length(regexp_replace(bare, '^isle of ', '')) >= 4 AND contains({hay}, regexp_replace(bare, '^isle of ', ''))) OR len(list_filter({_WORDS}, lambda x: contains(' ' || regexp_replace({hay}, '[^a-z0-9_]+', ' ', 'g') || ' ', ' ' || x || ' '))) > 0)"


def _near(pattern: str) -> str:
    at = rf"length(regexp_extract(t, '(?s)^(.*?)(?:{pattern})', 1))"
    window = f"substr(t, greatest(1, {at} + 1 - 90), {at} + 1 + length(regexp_extract(t, '{pattern}')) + 90 - greatest(1, {at} + 1 - 90))"
    return f"(regexp_matches(t, '{pattern}') AND {_mentions(window)})"


_LISTED = "(bare <> '' AND contains(t, bare) AND regexp_matches(substr(t, greatest(1, strpos(t, bare) - 48), strpos(t, bare) + length(bare) + 48 - greatest(1, strpos(t, bare) - 48)), '\\b(?:ireland|wales|scotland|england|cornwall|britain|france|europe|normandy)\\b'))"
_ONLY = "found only|only known|restricted to|confined to|only native|stronghold|the largest"


def _told(cap: int) -> str:
    return f"CAST(least(length(coalesce(summary, '')), {cap * 100}) AS DOUBLE) / 100"


def _has(pattern: str) -> str:
    return f"regexp_matches(t, '{pattern}')"


def _pts(test: str, points: float) -> str:
    return f"CASE WHEN {test} THEN {points} ELSE 0 END"


_SUBJECT, _STAND_IN = "coalesce(picture = 'subject', false)", "coalesce(picture = 'stand-in', false)"
_NEWS = f"8 * CASE WHEN {_has('castaway|vanished|feudal')} THEN 5 WHEN {_has('rocket|crowned|dinosaur')} OR {_has('(^|[^a-z])king([^a-z]|$)')} THEN 4 WHEN {_has('fossil|chapel')} OR {_has('(^|[^a-z])(fire|wreck)([^a-z]|$)')} THEN 3 ELSE 2 END + {_pts(_SUBJECT, 4)} + {_told(2)}"
_CASTLE = f"{_pts(_SUBJECT, 14)} + CASE WHEN area IS NULL THEN 1 WHEN area < 0.05 THEN 8 WHEN area < 1 THEN 6 WHEN area < 8 THEN 3 WHEN area > 200 THEN -5 ELSE 0 END + {_pts(_has('mansion|country house|gothic revival'), -8)} + {_pts(_has('tower house') + ' AND NOT ' + _SUBJECT, -5)} + {_told(4)}"
_OPENING = "lower(strip_accents(coalesce(title, '') || '. ' || substr(coalesce(summary, ''), 1, 320)))"
_WILD = f"""CASE WHEN {_SUBJECT} THEN 8 ELSE 1 END + CASE WHEN NOT {_LISTED} AND (({_mentions(_OPENING)} AND {_has('(^|[^a-z])endemic([^a-z]|$)')}) OR {_near('endemic')}) THEN 10 ELSE 0 END + CASE WHEN {_mentions(_OPENING)} AND NOT {_LISTED} AND {_has('subspecies|race of|own unique')} THEN 5 ELSE 0 END
 + CASE WHEN {_mentions("lower(strip_accents(coalesce(title, '')))")} THEN 6 ELSE 0 END + CASE WHEN NOT {_LISTED} AND {_near(_ONLY)} THEN 5 ELSE 0 END + {_pts(_has('(^|[^a-z])extinct([^a-z]|$)'), -8)} + {_told(3)}"""
_STILL = "coalesce(facet = 'distillery', false)"
_WHISKY = rf"CASE facet WHEN 'distillery' THEN 16 WHEN 'silent' THEN 7 WHEN 'story' THEN 5 ELSE 1 END + CASE WHEN {_SUBJECT} THEN CASE WHEN {_STILL} THEN 8 ELSE 3 END ELSE 0 END + 2 * least(len(regexp_extract_all(t, 'oldest|founded|established|peated|northernmost|classic malt|\bonly\b')), 2)"
_BOOK = f"CASE WHEN {_SUBJECT} THEN 12 WHEN {_STAND_IN} THEN 4 ELSE 0 END + {_pts(_has('(^|[^a-z])(novel|memoir)([^a-z]|$)'), 3)} + {_told(4)}"
_TRADITION = f"CASE WHEN {_SUBJECT} THEN 6 WHEN {_STAND_IN} THEN 2 ELSE 0 END + {_pts(_has('harris tweed|king of '), 6)} + {_told(4)}"
_CULTURE = f"CASE facet WHEN 'film' THEN 10 WHEN 'music' THEN 7 WHEN 'artwork' THEN 5 ELSE 3 END + {_pts(_SUBJECT, 6)} + {_pts(_has('highlander'), 6)} + {_told(4)}"
_SCORED = f"""(SELECT *, CAST(CASE slug WHEN 'unusual-news' THEN {_NEWS} WHEN 'island-castles' THEN {_CASTLE} WHEN 'unusual-wildlife' THEN {_WILD} WHEN 'whisky-distilleries' THEN {_WHISKY} WHEN 'island-books' THEN {_BOOK} WHEN 'local-traditions' THEN {_TRADITION} WHEN 'film-art-music' THEN {_CULTURE}
 ELSE CASE WHEN {_SUBJECT} THEN 2 ELSE 1 END END AS DOUBLE) AS score FROM (SELECT i.item, i.place, i.slug, i.title, i.summary, i.facet, i.picture, p.name, p.type, p.area, p.population, p.elevation, p.has_photo, lower(strip_accents(coalesce(i.title, '') || ' ' || coalesce(i.summary, ''))) AS t, {_BARE.replace('name', 'p.name')} AS bare FROM {_I} i JOIN {_P} p ON i.place = p.id) q)"""


@query(f"SELECT item, round(score, 6) AS score FROM {_SCORED} s")
def cited_item_scores(t):
    """Each cited item by its interest's model (R-04 to R-09, R-11, R-13)."""
    return interest.scored_items(_cited(t), _ranked_places(t)).select("item", F.round("score", 6).alias("score"))


def _place_scores_sql(others: str) -> str:
    river = "(type = 'river')"
    tidal = f"CASE WHEN has_photo THEN 8 ELSE 0 END + 5 * least({others}, 2) + CASE WHEN population > 0 AND population < 3000 THEN 2 ELSE 0 END - CASE WHEN {river} THEN 8 ELSE 0 END + CASE WHEN coalesce(area, 0) BETWEEN 0.02 AND 20 THEN 2 WHEN coalesce(area, 0) > 30 THEN -3 ELSE 0 END"
    sale = f"CASE WHEN type = 'lake' THEN 2 WHEN {river} THEN -8 ELSE 6 END + CASE WHEN has_photo THEN 5 ELSE 0 END + CASE WHEN coalesce(area, 0) BETWEEN 0.02 AND 15 THEN 4 WHEN coalesce(area, 0) > 0 AND coalesce(area, 0) < 0.02 THEN 2 WHEN coalesce(area, 0) > 40 THEN -4 ELSE 0 END + CASE WHEN population IS NULL OR population <= 30 THEN 3 WHEN population > 400 THEN -4 ELSE 0 END + CASE WHEN any_private THEN 5 ELSE 0 END"
    more = "CASE slug WHEN 'unusual-news' THEN 0.75 * least(greatest(n - 1, 0), 2) WHEN 'island-castles' THEN 0.4 * least(greatest(n - 1, 0), 3) WHEN 'unusual-wildlife' THEN 0.7 * least(greatest(n - 1, 0), 3) WHEN 'island-books' THEN 0.35 * least(greatest(n - 1, 0), 4) WHEN 'local-traditions' THEN 0.2 * least(greatest(n - 1, 0), 2) WHEN 'film-art-music' THEN 0.4 * least(greatest(n - 1, 0), 3) WHEN 'whisky-distilleries' THEN 1.2 * least(greatest(working - 1, 0), 5) ELSE 0 END"
    return f"""SELECT place, slug, has_photo, area, round(CAST(CASE slug WHEN 'for-sale' THEN {sale} WHEN 'tidal-islands' THEN {tidal} ELSE best + CASE WHEN slug = 'film-art-music' AND facets >= 3 THEN 4 WHEN slug = 'film-art-music' AND facets = 2 THEN 2 ELSE 0 END + {more} END AS DOUBLE), 6) AS score
 FROM (SELECT place, slug, any_value(type) AS type, any_value(area) AS area, any_value(population) AS population, any_value(has_photo) AS has_photo, max(score) AS best, count(*) AS n, count(*) FILTER (WHERE facet = 'distillery') AS working, count(DISTINCT facet) AS facets, bool_or(contains(lower(title), 'private island')) AS any_private FROM {_SCORED} s GROUP BY place, slug) g
 JOIN (SELECT place AS pl, count(DISTINCT slug) AS slugs, CAST(bool_or(slug = 'for-sale') AS INTEGER) AS sold FROM {_I} i GROUP BY place) c ON g.place = c.pl"""


@query(f"SELECT place, slug, score FROM ({_place_scores_sql('slugs - 1')}) x")
def place_scores(t):
    """Each place within each interest (R-07, R-10 to R-13)."""
    return interest.place_scores(_cited(t), _ranked_places(t)).select("place", "slug", F.round("score", 6).alias("score"))


_CEILING = "CASE slug WHEN 'unusual-news' THEN 48 WHEN 'island-castles' THEN 36 WHEN 'unusual-wildlife' THEN 36 WHEN 'whisky-distilleries' THEN 36 WHEN 'island-books' THEN 24 WHEN 'local-traditions' THEN 26 WHEN 'tidal-islands' THEN 30 WHEN 'film-art-music' THEN 32 ELSE 28 END"


@query(
    f"""WITH s AS (SELECT place, list_sort(list(least(greatest(score, 0), {_CEILING}) / {_CEILING} * 18), 'DESC') AS shares FROM ({_place_scores_sql('slugs - 1 - sold')}) x WHERE slug <> 'for-sale' GROUP BY place)
 SELECT id AS place, round(CAST(CASE WHEN coalesce(area, 0) > 8000 THEN -50 ELSE 0 END AS DOUBLE) + coalesce(shares[1], 0) + CAST(0.08 AS DOUBLE) * coalesce(shares[2], 0) + CASE WHEN id IN (SELECT place FROM {_I} i WHERE picture = 'subject' AND slug <> 'for-sale') THEN 3 WHEN NOT has_photo THEN -3 ELSE 0 END, 8) AS score FROM {_P} p LEFT JOIN s ON p.id = s.place"""
)
def atlas_ranking(t):
    """Places by the strongest of their cited stories (R-15)."""
    return interest.atlas_ranking(_cited(t), _ranked_places(t)).select("place", F.round("score", 8).alias("score"))


@query(
    f"""SELECT id AS place, CAST(CASE WHEN has_photo THEN 10 ELSE 0 END + 4 * least(coalesce(n, 0), 3) + CASE WHEN coalesce(news, false) THEN 4 ELSE 0 END + CASE WHEN coalesce(area, 0) BETWEEN 0.05 AND 40 THEN 4 WHEN coalesce(area, 0) > 100 THEN -4 ELSE 0 END + CASE WHEN elevation >= 100 THEN 2 ELSE 0 END AS DOUBLE) AS score
 FROM {_P} p LEFT JOIN (SELECT place, count(DISTINCT slug) AS n, bool_or(slug = 'unusual-news') AS news FROM {_I} i WHERE slug <> 'for-sale' GROUP BY place) c ON p.id = c.place"""
)
def remote_ranking(t):
    """Remote places by what is cited of them (R-14)."""
    return interest.remote_ranking(_cited(t), _ranked_places(t))


_SRC = "CASE id % 8 WHEN 0 THEN 'wikidata' WHEN 1 THEN 'osm-commons-category' WHEN 2 THEN 'commons-text-search' WHEN 3 THEN 'commons-geosearch' WHEN 4 THEN 'legacy-image-field' WHEN 5 THEN 'somewhere' WHEN 6 THEN 'curated' ELSE 'geograph' END"
_STAGED = "CASE id % 9 WHEN 0 THEN 'inaturalist-obs' WHEN 1 THEN 'openverse' WHEN 2 THEN 'commons-regional-category' WHEN 3 THEN 'wikidata-depicts' WHEN 4 THEN 'commons-depicts-q' WHEN 5 THEN 'wellcome-collection' WHEN 6 THEN 'panoramax' WHEN 7 THEN 'ogl-tourism' ELSE 'nowhere' END"
_FACTS = "id % 3 = 0 AS named, id % 5 < 3 AS geo, id % 7 = 0 AS flagged, CASE WHEN id % 4 = 0 THEN CAST(NULL AS DOUBLE) ELSE CAST(id * 41 % 7000 AS DOUBLE) END AS metres, id % 2 = 0 AS verified, CASE WHEN id % 6 = 0 THEN CAST(NULL AS INTEGER) ELSE CAST(80 + id % 20 AS INTEGER) END AS pct"


@query(
    f"""SELECT id, CAST(CASE src WHEN 'wikidata' THEN 95 WHEN 'osm-commons-category' THEN CASE WHEN named THEN 85 ELSE 70 END WHEN 'commons-text-search' THEN CASE WHEN named AND geo THEN 88 ELSE 60 END WHEN 'commons-geosearch' THEN CASE WHEN flagged THEN 75 WHEN named AND coalesce(metres <= 500, false) THEN 85 ELSE 70 END WHEN 'legacy-image-field' THEN 50 WHEN 'curated' THEN 98 WHEN 'geograph' THEN 90 ELSE 45 END AS INTEGER) AS lead,
 flagged OR src IN ('legacy-image-field', 'somewhere') OR (src = 'osm-commons-category' AND NOT named) OR (src = 'commons-text-search' AND NOT (named AND geo)) OR (src = 'commons-geosearch' AND NOT flagged AND NOT (named AND coalesce(metres <= 500, false))) AS suspect,
 CAST(CASE staged WHEN 'inaturalist-obs' THEN CASE WHEN metres <= 5000 THEN 96 WHEN metres IS NOT NULL THEN 70 ELSE 75 END WHEN 'openverse' THEN CASE WHEN named THEN 80 ELSE 55 END WHEN 'wellcome-collection' THEN CASE WHEN named THEN 78 ELSE 50 END WHEN 'panoramax' THEN 80
  WHEN 'wikidata-depicts' THEN CASE WHEN verified THEN coalesce(pct, 92) ELSE 65 END WHEN 'commons-depicts-q' THEN CASE WHEN verified AND pct >= 90 THEN pct ELSE 65 END WHEN 'nowhere' THEN NULL ELSE CASE WHEN named AND geo THEN 92 WHEN named THEN 85 ELSE 70 END END AS INTEGER) AS staged_score,
 CAST(CASE WHEN flagged OR NOT (named OR geo) THEN -200 ELSE 50 + CASE WHEN named THEN 25 ELSE 0 END + CASE WHEN geo THEN 15 ELSE 0 END + CASE WHEN verified THEN 35 ELSE 0 END + CASE WHEN metres >= 2800 THEN 25 WHEN metres >= 1600 THEN 15 WHEN metres > 0 AND metres < 1024 THEN -25 ELSE 0 END + CASE WHEN verified THEN 5 ELSE 0 END END AS INTEGER) AS gallery
 FROM (SELECT id, {_SRC} AS src, {_STAGED} AS staged, {_FACTS} FROM {_P} p) q"""
)
def photo_scores(t):
    """Confidence in lead pictures and staged ones, and gallery scores (R-18, R-19, R-21)."""
    p = places(t).selectExpr("id", f"{_SRC} AS src", f"{_STAGED} AS staged", *[x.strip() for x in _FACTS.replace("CAST(NULL AS DOUBLE)", "CAST(NULL AS DOUBLE)").split(", ")])
    c = F.col
    lead = scores.photo_confidence(c("src"), c("named"), c("metres"), c("geo"), c("flagged"))
    staged = scores.staged_photo_confidence(c("staged"), c("named"), c("metres"), c("geo"), c("verified"), c("pct"))
    gallery = scores.gallery_score(c("named"), c("geo"), F.lit(False), F.when(c("verified"), "Quality").otherwise(""), c("metres"), c("verified"), F.lit(False), c("flagged"))
    return p.select("id", lead["confidence"].alias("lead"), lead["suspect"].alias("suspect"), staged.alias("staged_score"), gallery.alias("gallery"))


@query(
    f"""SELECT id, round(CAST(CASE WHEN source = 'curated' THEN 400 ELSE 0 END + CASE WHEN description <> '' THEN 250 ELSE 0 END + CASE WHEN has_photo THEN 200 ELSE 0 END + CASE WHEN ferry THEN 120 ELSE 0 END + coalesce(least(80, area * 0.05), 0) + CASE WHEN wikidata IS NOT NULL THEN 30 ELSE 0 END + CASE WHEN type = 'sea' THEN 15 ELSE 0 END AS DOUBLE), 9) AS featured,
 CASE WHEN confidence = 'unconfirmed' THEN 'unconfirmed' WHEN source = 'curated' THEN 'high' WHEN wikidata IS NOT NULL THEN CASE WHEN confidence = 'high' THEN 'high' ELSE 'medium' END WHEN map_type IS NOT NULL AND name <> '' THEN 'medium' WHEN name <> '' THEN 'low' ELSE 'none' END AS name_confidence,
 CAST(CASE WHEN source = 'curated' THEN 100 ELSE 0 END + CASE WHEN area <> 0 THEN 5 ELSE 0 END + CASE WHEN population IS NOT NULL THEN 3 ELSE 0 END + CASE WHEN wikidata IS NOT NULL THEN 3 ELSE 0 END + CASE WHEN wikipedia IS NOT NULL THEN 3 ELSE 0 END + CASE WHEN has_photo THEN 2 ELSE 0 END AS INTEGER) AS discovery,
 CAST(CASE source WHEN 'curated' THEN 100 WHEN 'osm' THEN 50 ELSE 0 END + CASE WHEN area <> 0 THEN 5 ELSE 0 END + CASE WHEN population IS NOT NULL THEN 3 ELSE 0 END + CASE WHEN wikidata IS NOT NULL THEN 3 ELSE 0 END + CASE WHEN wikipedia IS NOT NULL THEN 3 ELSE 0 END + CASE WHEN has_photo THEN 2 ELSE 0 END AS INTEGER) AS merge_quality,
 CAST(CASE map_type WHEN 'relation' THEN 3 WHEN 'way' THEN 2 WHEN 'node' THEN 1 ELSE 0 END + CASE WHEN area <> 0 THEN 5 ELSE 0 END + CASE WHEN wikipedia IS NOT NULL THEN 3 ELSE 0 END + CASE WHEN has_photo THEN 2 ELSE 0 END + CASE WHEN population IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS tagged,
 round(CASE WHEN area > 0 THEN log10(area + 1) * 10 ELSE 0 END + CASE WHEN population > 0 THEN log10(CAST(population AS DOUBLE) + 1) * 4 ELSE 0 END + CASE WHEN wikipedia IS NOT NULL THEN 8 ELSE 0 END + CASE WHEN has_photo THEN 3 ELSE 0 END + CASE map_type WHEN 'relation' THEN 4 WHEN 'way' THEN 2 ELSE 0 END + CASE WHEN type = 'sea' THEN 3 ELSE 0 END, 6) AS notability,
 CASE WHEN elevation IS NOT NULL THEN elevation WHEN id % 3 = 0 THEN CAST(id % 100 AS DOUBLE) WHEN id % 3 = 1 THEN 7.0 END AS metres, CASE WHEN elevation IS NOT NULL THEN CASE WHEN id % 3 = 0 AND elevation > 0 AND NOT (abs(elevation - id % 100) <= 5 OR abs(elevation - id % 100) / greatest(elevation, 1) <= 0.05) THEN 'estimate' ELSE 'high' END WHEN id % 3 = 0 THEN 'estimate' WHEN id % 3 = 1 THEN 'high' ELSE 'n/a' END AS height FROM {_P} p"""
)
def record_scores(t):
    """Featured places, sure names, three qualities, notability and heights (R-17, R-22, R-24, R-25, W-09)."""
    c = F.col
    args = (c("source"), c("area"), c("population"), c("wikidata"), c("wikipedia"), c("has_photo"), c("map_type"))
    top = scores.highest_point(c("elevation"), F.when(c("id") % 3 == 0, (c("id") % 100).cast("double")), F.when(c("id") % 3 == 1, 7.0))
    return places(t).select(
        "id", F.round(scores.featured_score(F.lit(False), c("source"), c("description") != "", c("has_photo"), c("ferry"), c("area"), c("wikidata"), c("type")), 9).alias("featured"),
        scores.name_confidence(c("confidence"), c("source"), c("wikidata"), c("map_type"), c("map_id"), c("name")).alias("name_confidence"), scores.record_quality("discovery", *args).alias("discovery"), scores.record_quality("merge", *args).alias("merge_quality"), scores.record_quality("tagged", *args).alias("tagged"),
        F.round(scores.notability(c("area"), c("population"), c("wikipedia"), c("has_photo"), c("map_type"), F.when(c("type") == "sea", "island")), 6).alias("notability"), top["metres"].alias("metres"), top["confidence"].alias("height"),
    )
