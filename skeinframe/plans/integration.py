"""Queries of waters, ferries, imports and name joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import grid, text
from ..operators import ferries, filters, imports, inland, joins, spelling
from ..operators.tables import durable
from .base import PLACES, PLACES_SQL, places, word
from .registry import plain, query

_P = PLACES_SQL

#: Suppliers as rectangles of water, and a rectangle of land with a hole.
WATER = """SELECT s_suppkey AS body, CASE WHEN s_suppkey % 2 = 0 THEN 'lake' ELSE 'river' END AS kind, floor(abs(s_acctbal) / 2000) AS area, 51.5 + CAST(s_suppkey * 131 % 700 AS DOUBLE) / 100 AS clat, -8.5 + CAST(s_suppkey * 173 % 900 AS DOUBLE) / 100 AS clng,
 0.2075 + CAST(s_suppkey % 5 AS DOUBLE) / 10 AS h, 0.3075 + CAST(s_suppkey % 3 AS DOUBLE) / 10 AS d FROM {supplier}"""
_W = f"({plain(WATER)})"


def rectangle(lat, lng, h, d):
    corner = lambda a, b: F.struct((lng + b * d).alias("x"), (lat + a * h).alias("y"))
    return F.array(corner(-1, -1), corner(-1, 1), corner(1, 1), corner(1, -1))


def water(t):
    c = F.col
    return t.sql(WATER).select("body", "kind", "area", F.array(rectangle(c("clat"), c("clng"), c("h"), c("d"))).alias("outers"), F.array().cast("array<array<struct<x:double,y:double>>>").alias("inners"))


def land(t):
    one = lambda a, b, h, d: rectangle(F.lit(a), F.lit(b), F.lit(h), F.lit(d))
    return t("region").filter("r_regionkey = 0").select(F.lit(1).alias("polygon"), F.array(one(54.0, -4.0, 2.5045, 3.0045)).alias("outers"), F.array(one(54.0, -4.0, 0.5045, 0.5045)).alias("inners"))


_INSIDE = "abs(p.lat - w.clat) < w.h AND abs(p.lng - w.clng) < w.d"
_METRES = "sqrt(pow(greatest(abs(p.lat - w.clat) - w.h, 0) * 111320, 2) + pow(greatest(abs(p.lng - w.clng) - w.d, 0) * cos(radians(p.lat)) * 111320, 2))"
_ASHORE = "abs(p.lat - 54) < 2.5045 AND abs(p.lng + 4) < 3.0045 AND NOT (abs(p.lat - 54) < 0.5045 AND abs(p.lng + 4) < 0.5045)"
_CLASS = "CASE id % 10 WHEN 0 THEN 'manual' WHEN 1 THEN 'osm' END"


def _judged(t):
    p = places(t)
    entities = p.filter("id % 7 = 2 and wikidata is not null").select(F.col("wikidata").alias("entity"), F.lit("lake").alias("type"), F.concat(F.lit("W"), "id").alias("parent"))
    return inland.verdicts(p.select("id", "lat", "lng", "type", F.expr(_CLASS).alias("class_source"), F.col("wikidata").alias("entity")), entities, water(t), land(t))


_VERDICTS = f"""WITH p AS (SELECT *, {_CLASS} AS cs FROM {_P} x), i AS (SELECT p.id, first(w.body ORDER BY w.area, w.body) AS body, first(w.kind ORDER BY w.area, w.body) AS kind FROM p JOIN {_W} w ON {_INSIDE} GROUP BY p.id),
 n AS (SELECT p.id, first(w.body ORDER BY {_METRES}, w.area, w.body) AS body, first(w.kind ORDER BY {_METRES}, w.area, w.body) AS kind, min({_METRES}) AS m FROM p JOIN {_W} w ON {_METRES} <= 500 GROUP BY p.id),
 v AS (SELECT p.id, p.type AS before, CASE WHEN cs = 'manual' THEN 0 WHEN p.id % 7 = 2 AND wikidata IS NOT NULL THEN 1 WHEN i.id IS NOT NULL THEN 3 WHEN {_ASHORE} AND n.id IS NOT NULL THEN 4 ELSE 2 END AS tier, i.body AS ib, i.kind AS ik, n.body AS nb, n.kind AS nk, n.m, {_ASHORE} AS ashore FROM p LEFT JOIN i ON p.id = i.id LEFT JOIN n ON p.id = n.id),
 r AS (SELECT id, tier, before, CASE tier WHEN 0 THEN before WHEN 1 THEN 'lake' WHEN 3 THEN ik WHEN 4 THEN nk ELSE CASE WHEN ashore THEN 'unknown' ELSE 'sea' END END AS type, CASE tier WHEN 1 THEN 'W' || id WHEN 3 THEN CAST(ib AS VARCHAR) WHEN 4 THEN CAST(nb AS VARCHAR) END AS parent, CASE tier WHEN 0 THEN 'kept' WHEN 1 THEN 'high' WHEN 3 THEN 'medium' WHEN 4 THEN CASE WHEN m <= 200 THEN 'medium' ELSE 'low' END ELSE CASE WHEN ashore THEN 'low' ELSE 'high' END END AS confidence FROM v)"""


_E2 = 1 - (grid.WGS84[1] / grid.WGS84[0]) ** 2
_ZONE = f"({1 - _E2!r} * (sin(radians({{0}})) / (1 - {_E2!r} * pow(sin(radians({{0}})), 2)) - ln((1 - {_E2**0.5!r} * sin(radians({{0}}))) / (1 + {_E2**0.5!r} * sin(radians({{0}})))) / (2 * {_E2**0.5!r})))"


@query(f"SELECT body, round(radians(2 * w.d) * ({_ZONE.format('w.clat + w.h')} - {_ZONE.format('w.clat - w.h')}) * {grid.WGS84[0]} * {grid.WGS84[0]} / 2 / 1e6, 4) AS km2 FROM {_W} w")
def ellipsoid_areas(t):
    """Areas of waters on the ellipsoid (P-23)."""
    return water(t).select("body", F.round(grid.ellipsoid_km2(F.col("outers")[0]), 4).alias("km2"))


@query(f"{_VERDICTS} SELECT id, tier, type, parent, confidence, before FROM r")
def water_verdicts(t):
    """Which water each place lies in, by tiers of evidence (M-06, J-14, J-16)."""
    return _judged(t).select("id", "tier", "type", "parent", "confidence", "before")


@query(f"{_VERDICTS} SELECT tier, before || '>' || type AS change, count(*) AS n FROM r WHERE tier > 0 AND type <> before GROUP BY ALL")
def water_changes(t):
    """Proposed changes of type by tier (M-06, A-10)."""
    return inland.proposals(_judged(t)).groupBy("tier", "change").agg(F.count("*").alias("n"))


@query(f"SELECT id, CASE WHEN id % 4 = 1 AND coalesce(source <> 'curated', true) THEN 'sea' ELSE type END AS type, CASE WHEN id % 4 = 1 AND coalesce(source <> 'curated', true) THEN CASE WHEN id % 8 = 1 THEN NULL ELSE 'tidal' END ELSE subtype END AS subtype, CASE WHEN id % 4 = 1 AND coalesce(source <> 'curated', true) THEN 'B' || id END AS parent FROM {_P} p")
def reclassified_places(t):
    """Accepted proposals applied; a blank subtype takes it away, curated places stay (M-09)."""
    p = places(t).withColumn("parent", F.lit(None).cast("string"))
    accepted = p.filter("id % 4 = 1").select("id", F.lit("sea").alias("type"), F.when(F.col("id") % 8 == 1, "").otherwise("tidal").alias("subtype"), F.concat(F.lit("B"), "id").alias("parent"))
    return inland.reclassified(p, accepted).select("id", "type", "subtype", "parent")


_RINGS = "(SELECT c_custkey AS way, c_custkey % 10 + 1 AS body FROM customer UNION SELECT c_custkey, c_custkey * 3 % 10 + 1 FROM customer)"
_RING_NAME = "CASE WHEN c_custkey % 3 = 0 THEN '' ELSE " + word("c_custkey") + " END"


@query(
    rf"""WITH b AS (SELECT way, first(r.body ORDER BY coalesce(area, CAST('inf' AS DOUBLE)), CASE kind WHEN 'lake' THEN 0 ELSE 1 END, r.body) AS body FROM {_RINGS} r JOIN (SELECT body, kind, CASE WHEN body % 7 = 0 THEN NULL ELSE area END AS area FROM {_W} w) w ON r.body = w.body GROUP BY way),
 p AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(name), '\(.*?\)', '', 'g'), '\b(?:isle of|island|ynys|inch)\b', '', 'g'), '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '\s+', ' ', 'g')) AS k FROM {_P} x),
 w AS (SELECT c_custkey AS way, lower({_RING_NAME}) AS k, 50 + CAST(c_custkey * 37 % 997 AS DOUBLE) / 100 + 0.002 AS lat, -9 + CAST(c_custkey * 53 % 1009 AS DOUBLE) / 100 AS lng FROM customer),
 same AS (SELECT way, p.id FROM b JOIN p ON p.map_type = 'way' AND p.map_id = b.way),
 m AS (SELECT w.way, first(p.id ORDER BY 2 * 6371.0 * asin(sqrt(pow(sin(radians(p.lat - w.lat) / 2), 2) + cos(radians(w.lat)) * cos(radians(p.lat)) * pow(sin(radians(p.lng - w.lng) / 2), 2))), p.id) AS id FROM w JOIN p ON w.k = p.k AND abs(p.lat - w.lat) < 0.05 AND abs(p.lng - w.lng) < 0.05 AND 2 * 6371.0 * asin(sqrt(pow(sin(radians(p.lat - w.lat) / 2), 2) + cos(radians(w.lat)) * cos(radians(p.lat)) * pow(sin(radians(p.lng - w.lng) / 2), 2))) <= 1 WHERE w.k <> '' AND w.way NOT IN (SELECT way FROM same) GROUP BY w.way)
 SELECT b.way, b.body, CASE WHEN same.way IS NOT NULL THEN 'same' WHEN m.way IS NOT NULL THEN 'merged' ELSE 'new' END AS how, coalesce(same.id, m.id) AS id FROM b LEFT JOIN same ON b.way = same.way LEFT JOIN m ON b.way = m.way LEFT JOIN w ON b.way = w.way WHERE same.way IS NOT NULL OR w.k <> ''"""
)
def inner_ring_places(t):
    """Islands that are inner rings of waters: the smallest water, and the place they are (M-07)."""
    rings = t.sql("SELECT c_custkey AS way, c_custkey % 10 + 1 AS body FROM {customer} UNION SELECT c_custkey, c_custkey * 3 % 10 + 1 FROM {customer}")
    bodies = water(t).select("body", "kind", F.when(F.col("body") % 7 != 0, F.col("area")).alias("area"))
    parents = inland.inner_ring_parents(rings, bodies)
    ways = t.sql(f"SELECT c_custkey AS way, {_RING_NAME} AS name, 50 + CAST(c_custkey * 37 % 997 AS DOUBLE) / 100 + 0.002 AS lat, -9 + CAST(c_custkey * 53 % 1009 AS DOUBLE) / 100 AS lng FROM {{customer}}")
    return parents.join(inland.inner_ring_places(parents, places(t), ways), "way").select("way", "body", "how", "id")


@query(f"SELECT w.body, first(p.id ORDER BY -p.elevation, p.id) AS id, max(p.elevation) AS elevation, string_agg(CAST(p.id AS VARCHAR), ',' ORDER BY -p.elevation, p.id) AS points FROM {_P} p JOIN {_W} w ON {_INSIDE} WHERE p.elevation IS NOT NULL GROUP BY w.body")
def polygon_peaks(t):
    """The highest point in each polygon, and all of them in order (J-15)."""
    found = joins.polygon_points(water(t), places(t).filter("elevation is not null").select("id", "lat", "lng", "elevation"), "body", "id", "elevation")
    return found.select("body", "id", "elevation", F.array_join(F.transform("points", lambda x: x.cast("string")), ",").alias("points"))


@query(f"SELECT p.id, first(w.body ORDER BY {_METRES}, w.area, w.body) AS body, round(min({_METRES}), 3) AS metres FROM {_P} p JOIN {_W} w ON {_METRES} <= 500 GROUP BY p.id")
def nearest_polygons(t):
    """The nearest polygon within 500 m (J-16)."""
    return joins.nearest_polygon(places(t).select("id", "lat", "lng"), water(t), "id", "body", 500).withColumn("metres", F.round("metres", 3))


@query(
    f"""WITH near AS (SELECT p.id, first(w.body ORDER BY {_METRES}, w.area, w.body) AS place, min({_METRES}) AS m FROM {_P} p JOIN {_W} w ON {_METRES} <= 200 WHERE p.id % 5 <> 0 GROUP BY p.id), nm AS (SELECT * FROM (VALUES (1001, 'skarva'), (1002, 'brenna'), (1003, 'great orran')) v(place, n)),
 named AS (SELECT id, first(place ORDER BY -length(n), place) AS place FROM {_P} p JOIN nm ON contains(' ' || trim(regexp_replace(lower(strip_accents(name)), '[^a-z0-9]+', ' ', 'g')) || ' ', ' ' || n || ' ') WHERE id NOT IN (SELECT id FROM near) GROUP BY id)
 SELECT id, place, CASE WHEN m = 0 THEN 'polygon' ELSE 'proximity' END AS how FROM near UNION ALL SELECT id, place, 'name' FROM named"""
)
def placed_listings(t):
    """Listings by polygon, then offshore, then name (J-17)."""
    spots = places(t).select("id", "name", F.when(F.col("id") % 5 != 0, F.col("lat")).alias("lat"), "lng").withColumnRenamed("name", "title")
    names = t("region").filter("r_regionkey < 3").select((F.col("r_regionkey") + 1001).cast("long").alias("place"), F.when(F.col("r_regionkey") == 0, "Skarva").when(F.col("r_regionkey") == 1, "Brenna").otherwise("Great Orran").alias("name"))
    return joins.place_listing(spots, water(t).withColumnRenamed("body", "place"), names, "id", "place", "title")


_SITES = "(SELECT s_suppkey AS site, CASE s_suppkey % 3 WHEN 0 THEN 'Tolm' WHEN 1 THEN 'Nowhere' ELSE 'Isle of Hesker' END AS name, 50 + CAST(s_suppkey * 61 % 990 AS DOUBLE) / 100 + 0.003 AS lat, -9 + CAST(s_suppkey * 71 % 1000 AS DOUBLE) / 100 AS lng FROM supplier)"
_KM = "2 * 6371.0 * asin(sqrt(pow(sin(radians(p.lat - w.lat) / 2), 2) + cos(radians(w.lat)) * cos(radians(p.lat)) * pow(sin(radians(p.lng - w.lng) / 2), 2)))"
_INLAND_KEY = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({0}), '\(.*?\)', '', 'g'), '\b(?:isle of|island|ynys|inch)\b', '', 'g'), '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '\s+', ' ', 'g'))"


def _sites(t):
    return t.sql("SELECT s_suppkey AS site, CASE s_suppkey % 3 WHEN 0 THEN 'Tolm' WHEN 1 THEN 'Nowhere' ELSE 'Isle of Hesker' END AS name, 50 + CAST(s_suppkey * 61 % 990 AS DOUBLE) / 100 + 0.003 AS lat, -9 + CAST(s_suppkey * 71 % 1000 AS DOUBLE) / 100 AS lng FROM {supplier}")


@query(
    f"""WITH s AS (SELECT *, {_INLAND_KEY.format('name')} AS k FROM {_SITES} x), p AS (SELECT *, {_INLAND_KEY.format('name')} AS k FROM {_P} x), a AS (SELECT p.site, first(w.body ORDER BY w.area, w.body) AS place FROM s p JOIN {_W} w ON {_INSIDE} GROUP BY p.site),
 b AS (SELECT site, min(p.id) AS place FROM s JOIN p ON s.k = p.k WHERE s.k <> '' AND site NOT IN (SELECT site FROM a) GROUP BY site), c AS (SELECT w.site, first(p.id ORDER BY {_KM}, p.id) AS place FROM s w JOIN p ON {_KM} <= 25 WHERE w.site NOT IN (SELECT site FROM a) AND w.site NOT IN (SELECT site FROM b) GROUP BY w.site)
 SELECT *, 'polygon' AS how FROM a UNION ALL SELECT *, 'name' FROM b UNION ALL SELECT *, 'near' FROM c"""
)
def sites_of_places(t):
    """Lighthouses and the like: by polygon, name or nearness (J-18)."""
    return inland.sites_of_places(_sites(t), places(t).select(F.col("id").alias("place"), "name", "lat", "lng"), water(t).withColumnRenamed("body", "place"), 25)


@query(f"SELECT w.site AS reserve, p.id AS place FROM {_SITES} w JOIN {_P} p ON {_INLAND_KEY.format('w.name')} = {_INLAND_KEY.format('p.name')} UNION SELECT w.site, p.id FROM {_SITES} w JOIN {_P} p ON {_KM} <= 20")
def reserves_of_places(t):
    """Reserves by name or nearness, each pair once (X-18)."""
    return inland.reserves_of_places(_sites(t).withColumnRenamed("site", "reserve"), places(t).select(F.col("id").alias("place"), "name", "lat", "lng"), 20)


@query(
    f"""SELECT band, count(*) AS n, count(*) FILTER (WHERE m <= 100) AS within_100, count(*) FILTER (WHERE m <= 500) AS within_500 FROM (SELECT m, CASE WHEN m <= 50 THEN '0-50m' WHEN m <= 100 THEN '50-100m' WHEN m <= 200 THEN '100-200m' WHEN m <= 500 THEN '200-500m' WHEN m <= 1000 THEN '500m-1km' WHEN m <= 5000 THEN '1km-5km' ELSE '>5km' END AS band
 FROM (SELECT p.id, min({_METRES}) AS m FROM {_P} p CROSS JOIN {_W} w GROUP BY p.id) q) r GROUP BY band"""
)
def water_proximity(t):
    """How far places are from the nearest water, in bands (A-19)."""
    return inland.proximity_profile(places(t).select("id", "lat", "lng"), water(t))


@query(f"SELECT p.id FROM {_P} p WHERE type = 'river' AND (2.5045 - abs(p.lat - 54)) * 111320 > 2000 AND (3.0045 - abs(p.lng + 4)) * cos(radians(p.lat)) * 111320 > 2000 AND sqrt(pow(greatest(abs(p.lat - 54) - 0.5045, 0) * 111320, 2) + pow(greatest(abs(p.lng + 4) - 0.5045, 0) * cos(radians(p.lat)) * 111320, 2)) > 2000")
def inland_rocks(t):
    """Rocks on land, far from its edge (F-29)."""
    p = places(t).select("id", "lat", "lng", F.when(F.col("type") == "river", "rock").otherwise("island").alias("kind"))
    return filters.inland_rocks(p, land(t), "id", 2000)


_TERMINALS = "SELECT s_suppkey AS terminal, CASE s_suppkey % 7 WHEN 0 THEN 'port-tolm-' || s_suppkey ELSE 't-' || s_suppkey END AS code, CASE s_suppkey % 7 WHEN 1 THEN 'x-brenna-y' ELSE 'r' END AS route, CASE s_suppkey % 7 WHEN 2 THEN 'Q6' WHEN 3 THEN 'nothing' END AS given, CASE s_suppkey % 7 WHEN 4 THEN 'the Isle of Skarva' ELSE 'Pier ' || s_suppkey END AS name, 50 + CAST(s_suppkey * 61 % 990 AS DOUBLE) / 100 AS lat, -9 + CAST(s_suppkey * 71 % 1000 AS DOUBLE) / 100 AS lng FROM {supplier}"


@query(
    f"""WITH w AS ({plain(_TERMINALS)}), p AS (SELECT *, trim(regexp_replace(regexp_replace(lower(strip_accents(name)), '\\b(?:the|isle of|island of)\\s+', '', 'g'), '[^a-z0-9]+', ' ', 'g')) AS k FROM {_P} x),
 a AS (SELECT code AS terminal, CASE WHEN list_contains(string_split_regex(code, '[^a-z0-9]+'), 'tolm') THEN 1 ELSE 2 END AS place FROM w WHERE list_contains(string_split_regex(code, '[^a-z0-9]+'), 'tolm') OR list_contains(string_split_regex(route, '[^a-z0-9]+'), 'brenna')),
 b AS (SELECT code AS terminal, id AS place FROM w JOIN p ON w.given = p.wikidata WHERE code NOT IN (SELECT terminal FROM a)), c AS (SELECT code AS terminal, first(id ORDER BY -coalesce(area, 0), id) AS place FROM w JOIN p ON p.k = 'skarva' AND s7(w.terminal) WHERE code NOT IN (SELECT terminal FROM a) AND code NOT IN (SELECT terminal FROM b) GROUP BY code),
 d AS (SELECT w.code AS terminal, first(p.id ORDER BY {_KM}, p.id) AS place FROM w JOIN p ON p.type = 'sea' AND {_KM} <= 25 WHERE w.code NOT IN (SELECT terminal FROM a UNION SELECT terminal FROM b UNION SELECT terminal FROM c) GROUP BY w.code)
 SELECT *, 'port' AS how FROM a UNION ALL SELECT *, 'id' FROM b UNION ALL SELECT *, 'name' FROM c UNION ALL SELECT *, 'near' FROM d""".replace("s7(w.terminal)", "w.terminal % 7 = 4")
)
def terminal_places(t):
    """Terminals to places: ports, ids, names, nearness (J-23, J-12)."""
    p = places(t).select(F.col("id").alias("place"), "name", "type", "lat", "lng", "area", "wikidata")
    return ferries.terminal_places(t.sql(_TERMINALS).drop("terminal").withColumnRenamed("code", "terminal"), p, p.select(F.col("wikidata").alias("alias"), "place").filter("alias is not null"), {"tolm": "1", "brenna": "2"})


_ROUTE = "CASE o_orderkey % 5 WHEN 0 THEN 'car-and-foot' WHEN 1 THEN 'foot-only' WHEN 2 THEN 'charter' WHEN 3 THEN 'raft' END AS kind, CASE o_orderkey % 3 WHEN 0 THEN 'year-round' WHEN 1 THEN 'summer-only' END AS season, CASE o_orderkey % 4 WHEN 0 THEN 'daily' WHEN 1 THEN 'weekly' WHEN 2 THEN 'sometimes' END AS freq"


@query(f"SELECT o_orderkey, CASE kind WHEN 'car-and-foot' THEN 0 WHEN 'foot-only' THEN 1 WHEN 'charter' THEN 2 ELSE 9 END * 1000 + CASE season WHEN 'year-round' THEN 0 WHEN 'summer-only' THEN 1 ELSE 9 END * 100 + CASE WHEN freq IS NULL THEN 4 WHEN freq = 'daily' THEN 1 WHEN freq = 'weekly' THEN 2 ELSE 9 END * 10 AS shown, CASE WHEN o_orderkey % 6 = 0 THEN 'car-and-foot' WHEN o_orderkey % 6 = 1 THEN 'foot-only' WHEN o_orderkey % 6 = 2 THEN 'foot-only' WHEN o_orderkey % 6 = 3 THEN 'foot-only' ELSE 'car-and-foot' END AS tagged, CASE WHEN o_orderkey % 4 = 0 THEN 'summer-only' ELSE 'year-round' END AS season_tag FROM (SELECT o_orderkey, {_ROUTE} FROM orders) q")
def route_ranks(t):
    """Ranks of routes, and what tags say of a ferry (W-18, P-49)."""
    i = F.col("o_orderkey")
    r = t.sql(f"SELECT o_orderkey, {_ROUTE} FROM {{orders}}")
    kind = ferries.ferry_type(F.when(i % 6 == 0, "Yes").when(i % 6 == 1, "no"), F.when(i % 6 == 2, "designated"), F.when(i % 6 == 3, "Passenger boat").otherwise("Boat"))
    return r.select("o_orderkey", ferries.route_rank(F.col("kind"), F.col("season"), F.col("freq")).alias("shown"), kind.alias("tagged"), ferries.seasonality(F.when(i % 4 == 0, "Apr-Oct Mo-Su 10:00-16:00").when(i % 4 == 1, "24/7")).alias("season_tag"))


@query("SELECT s_suppkey AS terminal, city, city_lat FROM supplier, (VALUES ('North', 57.5, 0), ('South', 51.5, 1), ('West', 53.3, 2)) c(city, city_lat, k) WHERE s_suppkey % 9 <> 0 AND NOT (s_suppkey % 3 = k AND s_suppkey % 2 = 0)")
def missing_drives(t):
    """Drive times that are not known yet, by terminal and city (J-29)."""
    k = F.col("s_suppkey")
    known = F.when(k % 2 == 0, F.create_map(F.when(k % 3 == 0, "North").when(k % 3 == 1, "South").otherwise("West"), F.lit(30))).otherwise(F.create_map(F.lit("North"), F.lit(None).cast("int")))
    t_ = t("supplier").select(k.alias("terminal"), F.when(k % 9 != 0, F.lit(55.0)).alias("lat"), F.lit(-4.0).alias("lng"), known.alias("minutes"))
    return ferries.missing_drives(t_, {"North": (57.5, -4.2), "South": (51.5, -0.1), "West": (53.3, -6.3)}).select("terminal", "city", "city_lat")


@query(f"SELECT id, CASE WHEN id % 50 = 7 THEN 'direct-' || id ELSE CASE WHEN contains(lower(name), 'great') THEN 'g' WHEN contains(lower(name), 'tolm') THEN 't' WHEN contains(lower(name), 'isle of') THEN 'i' END END AS causeway FROM {_P} p WHERE id % 50 = 7 OR contains(lower(name), 'great') OR contains(lower(name), 'tolm') OR contains(lower(name), 'isle of')")
def causeways_of(t):
    """Causeways by id, then by the first hint in a name (J-31)."""
    p = places(t)
    direct = p.filter("id % 50 = 7").select(F.concat(F.lit("direct-"), "id").alias("causeway"), F.lit(9).alias("ord"), F.col("id").alias("place"), F.array().cast("array<string>").alias("hints"))
    hint = lambda k, *h: t("region").filter(f"r_regionkey = {k}").select(F.lit("gti"[k]).alias("causeway"), F.lit(k).alias("ord"), F.lit(None).cast("long").alias("place"), F.array(*map(F.lit, h)).alias("hints"))
    return ferries.causeways_of(p, direct.unionByName(hint(0, "Great")).unionByName(hint(1, "nope", "tolm")).unionByName(hint(2, "", "Isle of")), "id")


@query(f"SELECT DISTINCT o_orderkey AS route FROM orders JOIN {_P} p ON p.id IN (o_custkey, o_custkey % 10 + 1) WHERE contains(lower(archipelago), 'outer') OR p.nation = 'NATION_4'")
def routes_touching(t):
    """Routes that touch an archipelago or a nation (X-22)."""
    p = places(t).select(F.col("id").alias("place"), "name", "archipelago", "nation")
    r = t("orders").select(F.col("o_orderkey").alias("route"), F.col("o_custkey").alias("start"), (F.col("o_custkey") % 10 + 1).alias("end"))
    terminals = p.select(F.col("place").alias("terminal"), "place", F.lit("pier").alias("terminal_name"), F.lit(None).cast("string").alias("country"))
    return ferries.routes_touching(r, terminals, p, F.contains(F.lower("archipelago"), F.lit("outer")) | (F.col("nation") == "NATION_4"))


_FUZZY = "(VALUES ('Skarvo'), ('Isle of Mirrin'), ('Brennaa'), ('hesker'), ('Nothing at all'), ('Tol'), ('great orran rock')) v(target)"


@query(
    rf"""WITH t AS (SELECT target, trim(regexp_replace(regexp_replace(lower(target), '\b(?:the|isle of|island of)\b', ' ', 'g'), '\s+', ' ', 'g')) AS a FROM {_FUZZY}), p AS (SELECT id, area, trim(regexp_replace(regexp_replace(lower(strip_accents(name)), '\b(?:the|isle of|island of)\b', ' ', 'g'), '\s+', ' ', 'g')) AS b FROM {_P} x)
 SELECT target, first(id ORDER BY levenshtein(a, b), -coalesce(area, 0), id) AS id, CAST(min(levenshtein(a, b)) AS INTEGER) AS edits FROM t JOIN p ON b <> '' AND length(a) BETWEEN 4 AND 40 AND levenshtein(a, b) <= CASE WHEN length(a) >= 8 THEN 2 ELSE 1 END GROUP BY target"""
)
def fuzzy_names(t):
    """Misspelt names, by one edit or two; the larger place of equals (J-26)."""
    words = ("Skarvo", "Isle of Mirrin", "Brennaa", "hesker", "Nothing at all", "Tol", "great orran rock")
    targets = t("region").filter("r_regionkey = 0").select(F.explode(F.array(*map(F.lit, words))).alias("target"))
    return joins.fuzzy_name(targets, places(t), "target", "id")


#: Matching blocks in SQL over pairs (x, y): the longest common run as 1000 * length - place, and then the rest on both sides.
_RUN = "list_max(flatten(list_transform(range(1, length({x}) + 1), lambda i: list_transform(range(1, length({x}) - i + 2), lambda n: CASE WHEN contains({y}, substr({x}, i, n)) THEN n * 1000 - i ELSE -1 END))))"
_BLOCKS = f"""blocks(a, b, x, y, v) AS (SELECT a, b, a, b, {_RUN.format(x="a", y="b")} FROM spelt UNION ALL SELECT a, b, e.x, e.y, {_RUN.format(x="e.x", y="e.y")} FROM (SELECT a, b, unnest([{{'x': substr(x, 1, i - 1), 'y': substr(y, 1, strpos(y, substr(x, i, n)) - 1)}}, {{'x': substr(x, i + n), 'y': substr(y, strpos(y, substr(x, i, n)) + n)}}]) AS e
  FROM (SELECT *, CAST(ceil(v / 1000.0) AS BIGINT) AS n, CAST(ceil(v / 1000.0) AS BIGINT) * 1000 - v AS i FROM blocks WHERE v > 0) q) r WHERE e.x <> '' AND e.y <> ''),
 ratios AS (SELECT a, b, 2.0 * sum(CASE WHEN v > 0 THEN CAST(ceil(v / 1000.0) AS BIGINT) ELSE 0 END) / (length(a) + length(b)) AS ratio FROM blocks GROUP BY a, b)"""
#: A name with a letter left out (the first too), doubled or changed.
_MISSPELT = "CASE id % 5 WHEN 0 THEN substr({k}, 1, id % 7) || substr({k}, id % 7 + 2) WHEN 1 THEN substr({k}, 1, id % 6 + 1) || substr({k}, id % 6 + 1) WHEN 2 THEN substr({k}, 1, id % 8) || 'q' || substr({k}, id % 8 + 2) WHEN 3 THEN {k} || ' island' ELSE {k} END"


@query(
    rf"""WITH RECURSIVE p AS (SELECT id, nation, {_INLAND_KEY.format('name')} AS k FROM {_P} x), l AS (SELECT id, nation, {_MISSPELT.format(k="k")} AS k FROM p WHERE k <> ''), r AS (SELECT id + 100000 AS rid, nation, CASE WHEN id % 2 = 0 THEN k ELSE k || ' island' END AS k FROM p WHERE k <> ''),
 a AS (SELECT id, min(rid) AS rid FROM l JOIN r ON l.nation = r.nation AND l.k = r.k GROUP BY id), b AS (SELECT id, min(rid) AS rid FROM l JOIN r ON l.nation = r.nation AND l.k || ' island' = r.k WHERE id NOT IN (SELECT id FROM a) GROUP BY id),
 rest AS (SELECT * FROM l WHERE id NOT IN (SELECT id FROM a) AND id NOT IN (SELECT id FROM b)), spelt AS (SELECT DISTINCT l.k AS a, r.k AS b FROM rest l JOIN r ON l.nation = r.nation), {_BLOCKS}
 SELECT *, 'exact' AS tier FROM a UNION ALL SELECT *, 'expanded' FROM b UNION ALL SELECT id, first(rid ORDER BY ratio DESC, rid), 'fuzzy' FROM rest l JOIN r ON l.nation = r.nation JOIN ratios q ON q.a = l.k AND q.b = r.k WHERE ratio >= 0.88 GROUP BY id"""
)
def name_cascade(t):
    """Names within a nation: whole, with island after it, and by spelling (J-07)."""
    p = durable(places(t).select("id", "nation", text.name_key_variant(F.col("name"), "inland").alias("k")), "keys").filter("k <> ''")
    left = p.select("id", "nation", F.expr(_MISSPELT.format(k="k")).alias("key"))
    right = p.select((F.col("id") + 100000).alias("rid"), "nation", F.when(F.col("id") % 2 == 0, F.col("k")).otherwise(F.concat("k", F.lit(" island"))).alias("key"))
    return joins.name_cascade(left, right, "id", "rid")


_EDGES = r"regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents(coalesce({0}, ''))), '\([^)]*\)', '', 'g'), '[^a-z0-9 ]+', ' ', 'g'), '\s+', ' ', 'g')), '^(?:the |isles? of |island of )', ''), '\s+(?:islands?|isles?)$', '')"
_LISTED_SQL = f"SELECT id AS listing, {_MISSPELT.format(k='name')} AS name, nation, CASE WHEN id % 29 = 0 THEN 'near the Old Quay' WHEN id % 31 = 0 THEN 'in Quay Bay' ELSE 'for sale' END AS blob, CASE WHEN id % 4 = 0 THEN NULL ELSE lat + 0.2 END AS lat, lng FROM ({PLACES}) p WHERE name <> ''"
_LISTED = plain(_LISTED_SQL)


@query(
    rf"""WITH RECURSIVE p AS (SELECT id AS place, name, nation, coalesce(area, 0) AS area, lat, lng, {_EDGES.format("name")} AS k FROM {_P} x), l AS (SELECT *, {_EDGES.format("name")} AS k FROM ({_LISTED}) x),
 hint AS (SELECT listing, first(place ORDER BY o) AS place FROM l JOIN (VALUES (1, 'old quay', 3), (2, 'quay', 6), (3, 'quay', 7)) h(o, word, place) ON contains(lower(blob), word) JOIN p USING (place) WHERE p.nation = l.nation GROUP BY listing),
 alias AS (SELECT listing, min(p.place) AS place FROM l JOIN p ON p.nation = l.nation AND l.k = 'tolm' AND p.place % 50 = 1 WHERE listing NOT IN (SELECT listing FROM hint) GROUP BY listing),
 pick AS (SELECT l.listing, p.place, l.k AS lk, p.k AS pk, p.nation, CASE WHEN l.lat IS NULL THEN NULL ELSE 2 * 6371.0 * asin(sqrt(pow(sin(radians(p.lat - l.lat) / 2), 2) + cos(radians(l.lat)) * cos(radians(p.lat)) * pow(sin(radians(p.lng - l.lng) / 2), 2))) END AS km, p.area, length(p.name) AS long FROM l JOIN p ON l.nation = p.nation WHERE p.k <> '' AND listing NOT IN (SELECT listing FROM hint UNION SELECT listing FROM alias)),
 exact AS (SELECT listing, first(place ORDER BY km, -area, -long, place) AS place, count(*) AS n FROM pick WHERE lk = pk GROUP BY listing), longer AS (SELECT listing, first(place ORDER BY km, -area, -long, place) AS place FROM pick WHERE lk || ' island' = pk AND listing NOT IN (SELECT listing FROM exact) GROUP BY listing),
 rest AS (SELECT * FROM pick WHERE listing NOT IN (SELECT listing FROM exact UNION SELECT listing FROM longer)), spelt AS (SELECT DISTINCT lk AS a, pk AS b FROM rest), {_BLOCKS},
 near AS (SELECT DISTINCT rest.nation, a, b, ratio FROM rest JOIN ratios ON lk = a AND pk = b WHERE ratio >= 0.88), best AS (SELECT nation, a, first(b ORDER BY ratio DESC, b) AS b, max(ratio) AS ratio FROM near GROUP BY nation, a),
 fuzzy AS (SELECT listing, first(place ORDER BY km, -area, -long, place) AS place, max(ratio) AS ratio FROM rest JOIN best ON rest.nation = best.nation AND lk = a AND pk = b GROUP BY listing)
 SELECT listing, place, 'high' AS confidence, 'hint' AS method FROM hint UNION ALL SELECT listing, place, 'high', 'alias' FROM alias UNION ALL SELECT listing, place, CASE WHEN n = 1 THEN 'high' ELSE 'medium' END, 'exact' FROM exact UNION ALL SELECT listing, place, 'high', 'suffix-island' FROM longer UNION ALL SELECT listing, place, CASE WHEN ratio >= 0.97 THEN 'high' WHEN ratio >= 0.92 THEN 'medium' ELSE 'low' END, 'fuzzy' FROM fuzzy"""
)
def listing_places(t):
    """Listings matched to places by hints, aliases, keys and spelling, with confidences (J-07, P-33)."""
    p = durable(places(t).select(F.col("id").alias("place"), "name", "nation", "area", "lat", "lng", F.lit(None).cast("array<string>").alias("names")), "places")
    aliases = p.filter("place % 50 = 1").select(F.lit("tolm").alias("key"), "nation", "place")
    return spelling.listing_matches(durable(t.sql(_LISTED_SQL), "listed"), p, [("(?i)old quay", 3), ("(?i)quay", 6), ("(?i)quay", 7)], aliases)


@query(
    """WITH l AS (SELECT s_suppkey AS id, s_nationkey AS k, CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE 50 + CAST(s_suppkey * 61 % 990 AS DOUBLE) / 100 END AS lat, -9 + CAST(s_suppkey * 71 % 1000 AS DOUBLE) / 100 AS lng FROM supplier), r AS (SELECT c_custkey AS rid, c_nationkey AS k, 50 + CAST(c_custkey * 37 % 997 AS DOUBLE) / 100 AS lat, -9 + CAST(c_custkey * 53 % 1009 AS DOUBLE) / 100 AS lng FROM customer WHERE c_custkey % 5 < 2),
 j AS (SELECT id, rid, 2 * 6371.0 * asin(sqrt(pow(sin(radians(r.lat - l.lat) / 2), 2) + cos(radians(l.lat)) * cos(radians(r.lat)) * pow(sin(radians(r.lng - l.lng) / 2), 2))) AS km, count(*) OVER (PARTITION BY id) AS n FROM l JOIN r ON l.k = r.k)
 SELECT id, first(rid ORDER BY km, rid) AS rid, round(min(km), 6) AS km FROM j WHERE CASE WHEN n = 1 THEN km IS NULL OR km <= 250 ELSE coalesce(km <= 200, false) END GROUP BY id"""
)
def name_and_distance(t):
    """The only candidate of a key, or the nearest of several (J-05)."""
    left = t.sql("SELECT s_suppkey AS id, s_nationkey AS k, CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE 50 + CAST(s_suppkey * 61 % 990 AS DOUBLE) / 100 END AS lat, -9 + CAST(s_suppkey * 71 % 1000 AS DOUBLE) / 100 AS lng FROM {supplier}")
    right = t.sql("SELECT c_custkey AS rid, c_nationkey AS k, 50 + CAST(c_custkey * 37 % 997 AS DOUBLE) / 100 AS lat, -9 + CAST(c_custkey * 53 % 1009 AS DOUBLE) / 100 AS lng FROM {customer} WHERE c_custkey % 5 < 2")
    return joins.name_and_distance(left, right, "k", "id", "rid", 250, 200).withColumn("km", F.round("km", 6))


@query(f"SELECT coalesce(a.lat, b.lat) AS lat, coalesce(a.lng, b.lng) AS lng, a.id, b.site FROM (SELECT id, round(lat + 0.003, 1) + 0.0 AS lat, round(lng + 0.003, 1) + 0.0 AS lng FROM {_P} p) a FULL JOIN (SELECT site, round(lat, 1) + 0.0 AS lat, round(lng + 0.003, 1) + 0.0 AS lng FROM {_SITES} s) b ON a.lat = b.lat AND a.lng = b.lng")
def rounded_match(t):
    """A full join on rounded coordinates (J-19)."""
    return joins.rounded_match(places(t).select("id", (F.col("lat") + 0.003).alias("lat"), (F.col("lng") + 0.003).alias("lng")), _sites(t).select("site", "lat", (F.col("lng") + 0.003).alias("lng")), 1)


#: A quarter of the candidates lies away from all places, in chains of points 440 m apart.
_CAND = "SELECT o_orderkey AS candidate, " + word("CASE WHEN o_orderkey % 4 = 1 THEN o_custkey ELSE o_orderkey END") + " AS name, 50 + CAST(o_custkey * 37 % 997 AS DOUBLE) / 100 + CASE WHEN o_orderkey % 4 = 1 THEN 20 + CAST(o_orderkey % 7 AS DOUBLE) * 4 / 1000 ELSE CAST(o_orderkey % 5 AS DOUBLE) / 1000 END AS lat, -9 + CAST(o_custkey * 53 % 1009 AS DOUBLE) / 100 AS lng, CASE WHEN o_orderkey % 9 = 0 THEN 'way' END AS map_type, o_custkey * 10 AS map_id, CASE WHEN o_orderkey % 11 = 0 THEN 'Q' || CAST(o_custkey AS VARCHAR(20)) END AS entity, o_orderkey % 3 = 0 AS review FROM {orders}"


def _key_sql(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({c}), '\(.*?\)', '', 'g'), '\b(?:island of|isle of|islands|island|isles|isle|oileán|eilean)\b', ' ', 'g'), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g')), '^(?:of|and|with|the)\s+', ''), '\s+(?:of|and|with|the)$', ''))"


@query(
    f"""WITH w AS (SELECT *, {_key_sql('name')} AS k FROM ({plain(_CAND)}) c), p AS (SELECT *, {_key_sql('name')} AS k FROM {_P} x), rest AS (SELECT * FROM w WHERE candidate % 13 <> 0),
 m AS (SELECT candidate, 0 AS n, 0 AS d, id FROM rest w JOIN p ON w.map_type = p.map_type AND w.map_id = p.map_id UNION ALL SELECT candidate, 1, 0, id FROM rest w JOIN p ON w.entity = p.wikidata UNION ALL SELECT candidate, CASE WHEN w.k = p.k AND w.k <> '' THEN 2 ELSE 3 END, {_KM}, id FROM rest w JOIN p ON abs(p.lat - w.lat) < 0.02 AND {_KM} <= 1 AND ((w.k = p.k AND w.k <> '') OR (NOT review AND {_KM} <= 0.5))),
 b AS (SELECT candidate, first(id ORDER BY n, d, id) AS place FROM m GROUP BY candidate), open AS (SELECT * FROM rest WHERE candidate NOT IN (SELECT candidate FROM b) AND NOT review),
 kept AS (SELECT unnest(list_reduce(list([{{'c': candidate, 'lat': lat, 'lng': lng}}] ORDER BY candidate), lambda taken, x: CASE WHEN len(list_filter(taken, lambda y: 2 * 6371.0 * asin(sqrt(pow(sin(radians(y.lat - x[1].lat) / 2), 2) + cos(radians(x[1].lat)) * cos(radians(y.lat)) * pow(sin(radians(y.lng - x[1].lng) / 2), 2))) <= 0.5)) > 0 THEN taken ELSE list_concat(taken, x) END)) AS t FROM open GROUP BY k),
 dup AS (SELECT candidate FROM open WHERE candidate NOT IN (SELECT t.c FROM kept))
 SELECT w.candidate, CASE WHEN w.candidate % 13 = 0 THEN 'inland rock' WHEN b.candidate IS NOT NULL THEN CASE WHEN p.source = 'curated' THEN 'curated match' ELSE 'merged' END WHEN review THEN 'needs review' WHEN dup.candidate IS NOT NULL THEN 'duplicate' ELSE 'added' END AS outcome, b.place FROM w LEFT JOIN b ON w.candidate = b.candidate LEFT JOIN p ON b.place = p.id LEFT JOIN dup ON w.candidate = dup.candidate"""
)
def site_update(t):
    """What becomes of candidates for the atlas (M-12, M-10)."""
    c = t.sql(_CAND)
    p = places(t).select(F.col("id").alias("place"), "name", "lat", "lng", "map_type", "map_id", F.col("wikidata").alias("entity"), "source")
    return imports.site_update(c, p, c.filter("candidate % 13 = 0"))


@query(
    f"""WITH b AS (SELECT o_custkey AS id, first('New ' || o_orderkey ORDER BY o_orderkey % 50 DESC, o_orderkey) AS proposed FROM orders WHERE o_orderkey % 4 <> 0 GROUP BY o_custkey) SELECT p.id, CASE WHEN u THEN proposed ELSE name END AS name, CASE WHEN u THEN NULL ELSE st END AS name_status, CASE WHEN u THEN 'x,named-via-staging' ELSE 'x,unnamed' END AS tags
 FROM (SELECT p.id, name, CASE WHEN name = '' THEN 'unknown' ELSE 'known' END AS st, proposed, name = '' AND source <> 'curated' AND proposed IS NOT NULL AS u FROM {_P} p LEFT JOIN b ON p.id = b.id) p"""
)
def named_places(t):
    """The best proposed names for unnamed places (M-13, W-07)."""
    p = places(t).select("id", "name", F.when(F.col("name") == "", "unknown").otherwise("known").alias("name_status"), "source", F.array(F.lit("x"), F.lit("unnamed")).alias("tags"))
    o = F.col("o_orderkey")
    proposals = t("orders").select(F.col("o_custkey").alias("id"), F.when(o % 4 == 0, " ").otherwise(F.concat(F.lit("New "), o)).alias("proposed"), (o % 50).alias("score"), o.alias("ord"))
    return imports.named_places(p, proposals).select("id", "name", "name_status", F.array_join("tags", ",").alias("tags"))


@query(
    f"""WITH a AS (SELECT *, {_INLAND_KEY.format('name')} AS k FROM {_P} x) SELECT w.id AS imported, first(p.id ORDER BY {_KM}, p.id) AS place, round(min({_KM}), 6) AS km FROM a w JOIN a p ON w.k = p.k AND w.source = 'csv' AND p.source <> 'csv' AND {_KM} <= 300 GROUP BY w.id"""
)
def import_duplicates(t):
    """Imported rows that are places of their name nearby (M-14)."""
    p = places(t).select("id", text.name_key_variant(F.col("name"), "inland").alias("key"), "lat", "lng", "source")
    found = imports.import_duplicates(p.filter("source = 'csv'").select(F.col("id").alias("imported"), "key", "lat", "lng"), p.filter("source <> 'csv'").select(F.col("id").alias("place"), "key", "lat", "lng"), 300)
    return found.withColumn("km", F.round("km", 6))


@query(f"SELECT id, coalesce(map_type, CASE WHEN wikidata IS NOT NULL AND id % 6 <> 0 AND id % 5 <> 0 THEN 'relation' END) AS map_type, CASE WHEN map_id IS NULL AND wikidata IS NOT NULL AND id % 6 <> 0 AND id % 5 <> 0 THEN id * 7 ELSE map_id END AS map_id FROM {_P} p")
def backfilled_objects(t):
    """Map objects by way of the entity, if it has just one (M-16)."""
    p = places(t).select("id", F.col("wikidata").alias("entity"), "map_type", "map_id")
    one = p.filter("entity is not null and id % 5 <> 0").select("entity", F.lit("relation").alias("map_type"), (F.col("id") * 7).alias("map_id"))
    two = p.filter("entity is not null and id % 6 = 0").select("entity", F.lit("way").alias("map_type"), F.col("id").alias("map_id"))
    return imports.backfilled(p, one.unionByName(two).unionByName(two.withColumn("map_id", F.col("map_id") + 1))).select("id", "map_type", "map_id")


@query("SELECT a.k AS place, CAST(CASE WHEN a.k % 3 = 0 THEN DATE '2020-01-01' ELSE DATE '2024-05-05' END AS VARCHAR) AS first_seen, '2024-05-05' AS last_seen, n AS listings FROM (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey) a")
def registry_pass(t):
    """Listings of a week: first and last seen (M-17, W-16)."""
    old = t("customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("place"), F.lit("2020-01-01").alias("first_seen"))
    now = t("orders").filter("o_orderstatus = 'O'").select(F.col("o_custkey").alias("place"))
    return imports.registry_pass(old, now, "place", F.lit("2024-05-05"))


_SCORES = "SELECT CASE WHEN o_orderkey % 97 = 0 THEN 'p0' ELSE 'p' || CAST(o_orderkey AS VARCHAR(20)) END AS id, CASE WHEN o_orderkey % 19 = 0 THEN 'other' ELSE 'text' END AS prompt, CASE o_orderkey % 5 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' WHEN 2 THEN 'odd' END AS status, CASE o_orderkey % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN 'yes' END AS cited, CASE WHEN o_orderkey % 3 = 0 THEN 'true' END AS correct, CASE o_orderkey % 7 WHEN 0 THEN 'https://www.atlas.org/a' WHEN 1 THEN 'https://evil.org/a' END AS url FROM {orders}"


@query(
    f"""WITH s AS (SELECT *, count(*) OVER (PARTITION BY id) AS n, cited IS NOT NULL OR correct IS NOT NULL AS scored FROM ({plain(_SCORES)}) x), j AS (SELECT s.*, q.id IS NULL AS unknown, coalesce(status, CASE WHEN scored THEN 'completed' ELSE 'unrun' END) AS st, coalesce(cited = 'true', false) AS c, coalesce(url, '') AS u FROM s LEFT JOIN (SELECT 'p' || CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_orderkey % 23 <> 0) q ON s.id = q.id)
 SELECT id, 'duplicate id' AS problem FROM j WHERE n > 1 UNION SELECT id, 'unknown id' FROM j WHERE unknown UNION SELECT id, 'text differs' FROM j WHERE NOT unknown AND prompt <> 'text' UNION SELECT id, 'mark is no boolean' FROM j WHERE cited = 'yes' UNION SELECT id, 'unknown status' FROM j WHERE st = 'odd' UNION SELECT id, 'scored without an answer' FROM j WHERE st IN ('failed', 'unrun') AND scored
 UNION SELECT id, 'citation without an address' FROM j WHERE c AND u = '' UNION SELECT id, 'foreign address' FROM j WHERE c AND contains(u, 'evil') UNION SELECT id, 'address without a citation' FROM j WHERE NOT c AND u <> ''"""
)
def score_problems(t):
    """Imported scores that can't be taken, and why (M-18)."""
    prompts = t("orders").filter("o_orderkey % 23 <> 0").select(F.concat(F.lit("p"), "o_orderkey").alias("id"), F.lit("text").alias("prompt"))
    return imports.score_problems(t.sql(_SCORES), prompts, ["atlas.org", "www.atlas.org"])


@query("SELECT c_custkey, 'c_acctbal' AS \"column\" FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT c_custkey, 'c_mktsegment' FROM customer WHERE c_custkey % 7 = 0")
def protected_changes(t):
    """Columns that changed though only the name may (M-19)."""
    c = t("customer")
    k = F.col("c_custkey")
    new = c.withColumns({"c_name": F.concat("c_name", F.lit("!")), "c_acctbal": F.when(k % 5 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")), "c_mktsegment": F.when(k % 7 != 0, F.col("c_mktsegment"))})
    return imports.protected_changes(c, new, "c_custkey", ["c_name"])


@query(f"SELECT CASE WHEN confidence = 'unconfirmed' THEN 'unconfirmed' WHEN source = 'curated' THEN 'high' ELSE 'low' END AS part, count(*) AS n FROM {_P} p GROUP BY 1 UNION ALL SELECT 'outstanding', count(*) FROM orders WHERE o_orderkey % 10 = 0")
def ledger(t):
    """Places by how sure their names are, and what is outstanding (A-18)."""
    c = F.when(F.col("confidence") == "unconfirmed", "unconfirmed").when(F.col("source") == "curated", "high").otherwise("low")
    return imports.ledger(places(t), t("orders").filter("o_orderkey % 10 = 0"), c)


@query(f"SELECT 'all' AS stat, count(*) AS n FROM {_P} p UNION ALL SELECT type, count(*) FROM {_P} p GROUP BY type UNION ALL SELECT 'photographed', count(*) FROM {_P} p WHERE has_photo")
def headline(t):
    """Numbers for a headline, in one pass (A-21)."""
    return imports.headline(places(t), {k: F.col("type") == k for k in ("sea", "lake", "river")} | {"photographed": F.col("has_photo")})


@query("SELECT o_custkey, count(*) AS contributed, count(*) FILTER (WHERE o_orderstatus = 'O') AS accepted, count(*) FILTER (WHERE o_orderstatus = 'F') AS rejected FROM orders GROUP BY o_custkey")
def moderation(t):
    """Contributions by user (A-24)."""
    o = t("orders").withColumn("status", F.when(F.col("o_orderstatus") == "O", "accepted").when(F.col("o_orderstatus") == "F", "rejected"))
    return imports.moderation(o, "o_custkey", "status")


@query(f"SELECT 'isles' AS collection, id FROM {_P} p WHERE contains(lower(archipelago), 'isles') UNION ALL SELECT 'varn', id FROM {_P} p WHERE contains(lower(water), 'varn') OR contains(lower(archipelago), 'north')")
def collection_members(t):
    """Members of collections by archipelago or water (X-21)."""
    spec = t("region").filter("r_regionkey < 2").select(F.when(F.col("r_regionkey") == 0, "isles").otherwise("varn").alias("collection"), F.when(F.col("r_regionkey") == 0, "Isles").otherwise("north").alias("archipelago"), F.when(F.col("r_regionkey") == 1, "Varn").alias("parent"))
    return imports.collection_members(places(t), spec)
