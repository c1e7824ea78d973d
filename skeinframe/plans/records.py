"""Queries of place records: names, units, coordinates, licences, facets and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, parse, text
from ..functions.sentences import FEATURES
from ..operators import filters
from .base import PLACES_SQL, places
from .registry import query

_P = PLACES_SQL
_GENERIC = "island of|isle of|islands|island|isles|isle|islets|islet|ynys|inch|inish|inis|oilean|oileán|oiléan|oiléán|eileanan|eilean|holms|holm|skerries|skerry"
_BARE = r"regexp_replace(lower(coalesce(name, '')), '\(.*?\)', '', 'g')"
_SQUEEZED = r"trim(regexp_replace(regexp_replace(regexp_replace({bare}, '\b(?:{words})\b', '{gap}', 'g'), '[^\p{{L}}\p{{N}}_\s]', '{gap}', 'g'), '\s+', ' ', 'g'))"
_KEY = _SQUEEZED.format(bare=_BARE, words=_GENERIC, gap=" ")
_ENDS = r"trim(regexp_replace(regexp_replace({0}, '^(?:of|and|with|the)\s+', ''), '\s+(?:of|and|with|the)$', ''))"
_PLAIN = r"trim(regexp_replace(regexp_replace(replace(lower(strip_accents(coalesce(name, ''))), '''', ' '), '\([^)]*\)', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))"
_SIMPLE = rf"trim(regexp_replace(regexp_replace({_PLAIN}, '\b(?:islands|island|isles|isle|islets|islet|eilean|eileanan|inis|innis|inch|rocks|rock|skerries|skerry)\b', ' ', 'g'), '\s+', ' ', 'g'))"


@query(
    rf"""SELECT id, {_ENDS.format(_KEY)} AS key, {_SQUEEZED.format(bare=_BARE, words='isle of|island|ynys|inch', gap='')} AS inland_key, {_SQUEEZED.format(bare=_BARE, words='isle of|island|ynys|inch|inis|oilan|oilean|oiléan|eilean', gap=' ')} AS source_key,
 trim(regexp_replace(trim(regexp_replace(lower(strip_accents(coalesce(name, ''))), '[^a-z0-9]+', ' ', 'g')), '\b(?:island|isle|isles|eilean|ynys|oilean|holm|skerry)\b', '', 'g')) AS audit_key,
 {_SIMPLE} AS simple, list_aggregate(list_sort(list_filter(['great', 'mor'], lambda q: list_contains(string_split({_SIMPLE}, ' '), q))), 'string_agg', ',') AS qualifiers,
 coalesce('osm-' || map_type || '-' || map_id, 'wd-' || wikidata) AS canonical, coalesce(nullif(trim(name), ''), nullif(trim(water), ''), nullif(trim(archipelago), ''), '') AS display FROM {_P} p"""
)
def name_forms(t):
    """Keys, core names, qualifiers, ids and display names (P-04 to P-07, P-09, P-10)."""
    n = F.col("name")
    qualifiers = F.nullif(F.array_join(text.qualifier_set(text.simplify(n)), ","), F.lit(""))
    kinds = {f"{k}_key": text.name_key_variant(n, v) for k, v in (("inland", "inland"), ("source", "sources"), ("audit", "audit"))}
    canonical = F.when(F.col("map_type").isNotNull() | F.col("wikidata").isNotNull(), text.canonical_id(F.col("map_type"), F.col("map_id"), F.col("wikidata"), n))
    return places(t).select("id", text.name_key(n).alias("key"), *[c.alias(k) for k, c in kinds.items()], text.simplify(n).alias("simple"), qualifiers.alias("qualifiers"), canonical.alias("canonical"), text.first_filled(n, F.col("water"), F.col("archipelago")).alias("display"))


@query(
    rf"""SELECT id, contains(' ' || trim(regexp_replace(lower(description), '[^a-z0-9]+', ' ', 'g')) || ' ', ' ' || lower(w) || ' ') AS mentioned, regexp_replace(coalesce(name, ''), '([.*+?^$()|{{}}\[\]\\])', '\\\1', 'g') AS pattern,
 CASE WHEN length(description) > 30 THEN rtrim(substr(description, 1, 29)) || '…' ELSE description END AS clipped, source IN ('osm') AS open,
 CASE WHEN area IS NULL THEN NULL WHEN area / 3 < 1 THEN printf('%.2f km²', area / 3) WHEN area / 3 < 100 THEN printf('%.1f km²', area / 3) ELSE format('{{:,}}', CAST(round_even(area / 3, 0) AS BIGINT)) || ' km²' END AS size FROM {_P} p"""
)
def text_checks(t):
    """Whole words, escaped patterns, clipping, licences and formats (P-35, P-36, P-38, P-39, P-51, P-53)."""
    d = F.col("description")
    return places(t).select("id", text.whole_word(d, F.col("w")).alias("mentioned"), text.escape_pattern(F.coalesce("name", F.lit(""))).alias("pattern"), text.clip(d, 30).alias("clipped"), text.open_licence(F.col("source"), ["osm"]).alias("open"), text.format_area(F.col("area") / 3).alias("size"))


@query(
    f"""SELECT id, CASE WHEN id % 2 = 0 THEN -1 ELSE 1 END * (CAST(id % 90 AS DOUBLE) + CAST(id % 60 AS DOUBLE) / 60 + CAST(id % 50 AS DOUBLE) / 3600) AS degrees, CASE id % 4 WHEN 0 THEN CAST(id AS DOUBLE) WHEN 1 THEN CAST(id AS DOUBLE) / 100 WHEN 2 THEN CAST(id AS DOUBLE) / 1e6 END AS km2,
 CASE WHEN id % 3 = 0 THEN NULL ELSE id END AS people, CASE WHEN id % 5 < 3 THEN NULL ELSE id END AS number FROM {_P} p"""
)
def unit_texts(t):
    """Angles, areas, populations and lenient integers of texts (P-11, P-12, P-13, P-15)."""
    i = F.col("id").cast("string")
    angle = F.concat((F.col("id") % 90).cast("string"), F.lit("°"), (F.col("id") % 60).cast("string"), F.lit("'"), (F.col("id") % 50).cast("string"), F.when(F.col("id") % 2 == 0, '"S').otherwise('"N'))
    area = F.concat(F.lit("about "), i, F.when(F.col("id") % 4 == 0, " km²").when(F.col("id") % 4 == 1, " hectares").when(F.col("id") % 4 == 2, " m²").otherwise(" acres"))
    people = F.when(F.col("id") % 3 == 0, "nobody counted").otherwise(F.concat(F.lit("Population: "), F.format_number("id", 0)))
    number = F.when(F.col("id") % 5 == 0, "").when(F.col("id") % 5 == 1, "-").when(F.col("id") % 5 == 2, "..").otherwise(F.format_number("id", 0))
    return places(t).select("id", parse.dms(angle).alias("degrees"), parse.area_km2(area).alias("km2"), parse.population(people).alias("people"), parse.lenient_int(number).alias("number"))


_FILE = "CASE id % 6 WHEN 0 THEN 'File:Map of ' || w || '.png' WHEN 1 THEN 'File:' || w || ' beach.jpg' WHEN 2 THEN 'Coat of arms.svg' WHEN 3 THEN w || '_(logo)_1.jpg' WHEN 4 THEN '' ELSE w || ' harbour 2.jpg' END"
_LICENCE = "CASE id % 7 WHEN 0 THEN 'https://cc.org/licenses/by-sa/4.0/' WHEN 1 THEN 'https://cc.org/licenses/by/4.0/' WHEN 2 THEN 'https://cc.org/publicdomain/zero/1.0/' WHEN 3 THEN 'https://cc.org/licenses/by-nc/4.0/' WHEN 4 THEN 'https://cc.org/licenses/by-nd/4.0/' WHEN 5 THEN '' ELSE 'https://x.org/terms' END"


@query(
    rf"""SELECT id, CASE id % 7 WHEN 0 THEN 'CC-BY-SA-4.0' WHEN 1 THEN 'CC-BY-4.0' WHEN 2 THEN 'CC0-1.0' END AS licence, id % 6 IN (0, 2, 3, 4) AS not_photo, replace(replace(f, 'File:', ''), '_', ' ') AS title,
 CASE WHEN f = '' THEN '' ELSE 'https://m.org/' || replace(replace(replace(replace(f, 'File:', ''), ' ', '_'), '(', '%28'), ')', '%29') || '?width=300' END AS thumb, left(md5(replace(f, ' ', '_')), 1) || '/' || left(md5(replace(f, ' ', '_')), 2) || '/' || replace(f, ' ', '_') AS folder FROM (SELECT *, {_FILE} AS f FROM {_P} p) q"""
)
def media_names(t):
    """Licences by URL, titles that are no photographs, file names, addresses and folders (P-40 to P-43)."""
    p = places(t).withColumns({"f": F.expr(_FILE), "l": F.expr(_LICENCE)})
    f = F.col("f")
    return p.select("id", text.licence_label(F.col("l")).alias("licence"), text.not_a_photo(text.file_title(f), text.file_title(f)).alias("not_photo"), text.file_title(f).alias("title"), text.file_url(f, "https://m.org/", 300).alias("thumb"), text.md5_path(f).alias("folder"))


@query(
    rf"""SELECT id, CASE WHEN id % 5 = 0 THEN 'whole_island' WHEN id % 5 IN (1, 4) THEN 'residential' WHEN id % 5 = 2 THEN 'land' ELSE 'residential' END AS listing, CASE WHEN id % 4 = 0 THEN 'tidal' WHEN id % 4 = 1 THEN 'air' ELSE '' END AS access,
 CASE id % 8 WHEN 0 THEN 'sea' WHEN 1 THEN 'lake' WHEN 2 THEN 'lake' WHEN 3 THEN 'river' WHEN 4 THEN 'river' WHEN 5 THEN 'lake' WHEN 6 THEN 'sea' END AS kind, CASE id % 8 WHEN 1 THEN 'reservoir' WHEN 2 THEN 'pond' WHEN 3 THEN 'canal' WHEN 6 THEN 'estuary' END AS sub, id % 8 IN (0, 6) AS tidal_water,
 CASE WHEN id % 4 = 1 THEN NULL ELSE round(57 + CAST(30 AS DOUBLE) / 60, 6) END AS template_lat, CASE id % 4 WHEN 0 THEN round(-CAST(6 AS DOUBLE) - CAST(15 AS DOUBLE) / 60, 6) WHEN 2 THEN round(-CAST(6 AS DOUBLE) - CAST(15 AS DOUBLE) / 60, 6) WHEN 3 THEN round(-6.25, 6) END AS template_lng FROM {_P} p"""
)
def record_classes(t):
    """Listings, access, water tags and coordinate templates (P-47, P-48, P-60, S-14)."""
    i = F.col("id")
    body = F.when(i % 5 == 0, "Private island with a cottage").when(i % 5 == 1, "A croft above the bay").when(i % 5 == 2, "Ten acre plot").when(i % 5 == 3, "Something else").otherwise("Cottage and land")
    tags = F.when(i % 8 == 0, F.create_map(F.lit("tidal"), F.lit("yes"))).when(i % 8 == 1, F.create_map(F.lit("landuse"), F.lit("reservoir"))).when(i % 8 == 2, F.create_map(F.lit("water"), F.lit("pond"))).when(i % 8 == 3, F.create_map(F.lit("water"), F.lit("river"), F.lit("waterway"), F.lit("canal")))
    tags = tags.when(i % 8 == 4, F.create_map(F.lit("waterway"), F.lit("riverbank"))).when(i % 8 == 5, F.create_map(F.lit("natural"), F.lit("water"))).when(i % 8 == 6, F.create_map(F.lit("estuary"), F.lit("yes"))).otherwise(F.create_map(F.lit("place"), F.lit("islet")))
    coord = F.when(i % 4 == 0, "57|30|N|6|15|W").when(i % 4 == 1, "unknown").when(i % 4 == 2, "57|30|0|N|6|15|0|W|display=title").otherwise("57.5|-6.25")
    at = text.coordinate_template(coord)
    p = places(t).select("id", text.listing_type(body, F.lit(None).cast("string")).alias("listing"), text.access_label(F.when(i % 4 == 0, "tidal"), F.when(i % 4 == 1, "Two flights a day")).alias("access"), text.water_class(tags).alias("c"), at.alias("at"))
    return p.select("id", "listing", "access", F.col("c.kind").alias("kind"), F.col("c.subtype").alias("sub"), F.col("c.tidal").alias("tidal_water"), F.round("at.lat", 6).alias("template_lat"), F.round("at.lng", 6).alias("template_lng"))


_E, _N = "CAST(id * 7919 % 700000 AS DOUBLE)", "CAST(id * 104729 % 1300000 AS DOUBLE)"
_IRISH = "CASE WHEN e >= 20000 AND floor((e - 20000) / 100000) <= 4 AND floor(n / 100000) <= 4 THEN substr('VWXYZQRSTULMNOPFGHJKABCDE', CAST((4 - floor(n / 100000)) * 5 + floor((e - 20000) / 100000) + 1 AS INTEGER), 1) || printf('%03d%03d', CAST(e AS BIGINT) % 100000 // 1000, CAST(n AS BIGINT) % 100000 // 1000) END"
_L = "substr('ABCDEFGHJKLMNOPQRSTUVWXYZ', CAST({0} AS INTEGER) + 1, 1)"
_A, _B = "CAST(floor(e / 100000) AS INTEGER)", "CAST(floor(n / 100000) AS INTEGER)"


@query(
    f"""SELECT id, round(2 * 6371.0088 * asin(sqrt(pow(sin(radians(55 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(55.0)) * pow(sin(radians(-4 - lng) / 2), 2))), 6) AS fine_km,
 round(sqrt(pow(55 - lat, 2) + pow((-4 - lng) * cos(radians((lat + 55) / 2)), 2)) * 111320, 4) AS flat_m, round(CASE WHEN area > 0 THEN sqrt(area / pi()) * 1000 ELSE 0 END, 6) AS radius_m, CAST(floor((lng + 180) / 360 * 1024) AS INTEGER) AS tile_x,
 CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 1024) AS INTEGER) AS tile_y, CAST(id % 256 AS DOUBLE) * 256 + CAST(id * 3 % 256 AS DOUBLE) + CAST(id * 7 % 256 AS DOUBLE) / 256 - 32768 AS terrain, {_IRISH} AS irish,
 {_L.format(f'(19 - {_B}) - (19 - {_B}) % 5 + ({_A} + 10) // 5')} || {_L.format(f'(19 - {_B}) * 5 % 25 + {_A} % 5')} || printf('%03d%03d', CAST(e AS BIGINT) % 100000 // 100, CAST(n AS BIGINT) % 100000 // 100) AS british,
 lat BETWEEN 49 - 0.06 * 12 AND 61 + 0.06 * 12 AND lng BETWEEN -8 - 0.06 * 10 AND 2 + 0.06 * 10 AS in_view, (lat BETWEEN 49 AND 61 AND lng BETWEEN -9 AND 2) AND ((lat BETWEEN 54 AND 61 AND lng BETWEEN -8 AND 0) OR (lat BETWEEN 50 AND 56 AND lng BETWEEN -6 AND 2)) AS in_remit
 FROM (SELECT *, {_E} AS e, {_N} AS n FROM {_P} p) q"""
)
def geo_forms(t):
    """Distances, radii, tiles, terrain colours, grid references, views and remits (P-18, P-19, P-21, P-22, P-29, P-30, S-19, F-20)."""
    lat, lng, i = F.col("lat"), F.col("lng"), F.col("id")
    tile = geo.tile(lat, lng, 10)
    view = geo.padded_box((49.0, -8.0, 61.0, 2.0), 12)
    colour = lambda k: (i * k % 256).cast("double")
    e, n = F.expr(_E), F.expr(_N)
    return places(t).select(
        "id", F.round(geo.haversine_km(lat, lng, F.lit(55.0), F.lit(-4.0), geo.RADIUS_FINE_KM), 6).alias("fine_km"), F.round(geo.flat_m(lat, lng, F.lit(55.0), F.lit(-4.0)), 4).alias("flat_m"), F.round(geo.equal_area_radius_m(F.col("area")), 6).alias("radius_m"), tile["x"].alias("tile_x"), tile["y"].alias("tile_y"),
        geo.terrain_m(colour(1), colour(3), colour(7)).alias("terrain"), geo.grid_letter_irish(e, n).alias("irish"), geo.grid_letters_british(e, n).alias("british"), geo.in_box(lat, lng, view).alias("in_view"),
        filters.in_remit(lat, lng, (49.0, -9.0, 61.0, 2.0), [("a", (54.0, -8.0, 61.0, 0.0)), ("b", (50.0, -6.0, 56.0, 2.0))]).alias("in_remit"),
    )


_RECT = "round({0}, 6)"


@query(
    f"""SELECT id, round(h * d * cos(radians(lat)) * 111.32 * 111.32, 6) AS planar, round(6371.0088 * 6371.0088 * radians(d) * (sin(radians(lat + h / 2)) - sin(radians(lat - h / 2))), 4) AS spherical,
 round(6371.0088 * 6371.0088 * (radians(d) * (sin(radians(lat + h / 2)) - sin(radians(lat - h / 2))) - radians(d / 2) * (sin(radians(lat + h / 4)) - sin(radians(lat - h / 4)))), 4) AS with_hole, round(lat, 6) AS mid_lat, round(lng, 6) AS mid_lng
 FROM (SELECT *, 0.02 + CAST(id % 10 AS DOUBLE) / 100 AS h, 0.03 + CAST(id % 7 AS DOUBLE) / 100 AS d FROM {_P} p) q"""
)
def polygon_areas(t):
    """Planar and spherical areas, holes taken away, and centroids of rectangles (P-23, P-24, P-26)."""

    def ring(h, d):
        corner = lambda a, b: F.struct((F.col("lng") + b * d / 2).alias("x"), (F.col("lat") + a * h / 2).alias("y"))
        return F.array(corner(-1, -1), corner(-1, 1), corner(1, 1), corner(1, -1))

    p = places(t).withColumns({"h": 0.02 + (F.col("id") % 10).cast("double") / 100, "d": 0.03 + (F.col("id") % 7).cast("double") / 100})
    p = p.withColumns({"o": ring(F.col("h"), F.col("d")), "i": ring(F.col("h") / 2, F.col("d") / 2)})
    mid = geo.centroid(F.col("o"))
    return p.select("id", F.round(geo.planar_km2(F.col("o")), 6).alias("planar"), F.round(geo.spherical_km2(F.col("o")), 4).alias("spherical"), F.round(geo.polygon_km2(F.array("o"), F.array("i")), 4).alias("with_hole"), F.round(mid["y"], 6).alias("mid_lat"), F.round(mid["x"], 6).alias("mid_lng"))


@query(
    f"""SELECT id, trim(coalesce(description, '')) <> '' OR trim(coalesce(history, '')) <> '' AS told, elevation IS NOT NULL OR (confidence IS NOT NULL AND confidence <> 'n/a') AS height, coalesce(population, 0) = 0 AS empty, coalesce(subtype = 'tidal', false) OR tidal AS tidal_place, coalesce(elevation >= 500, false) OR regexp_matches(hay, '\\b(?:{"|".join(FEATURES["mountain"]).replace("ben ", "ben")})\\b') AS mountain,
 regexp_matches(hay, '\\b(?:{"|".join(FEATURES["castle"])})\\b') AS castle, regexp_matches(hay, '\\b(?:{"|".join(FEATURES["lighthouse"])})\\b') AS lighthouse FROM (SELECT *, trim(regexp_replace(lower(coalesce(description, '')), '[^a-z0-9]+', ' ', 'g')) AS hay FROM {_P} p) q"""
)
def feature_flags(t):
    """What a place has: text, a height, people, tides, mountains and words for features (F-06, F-11, F-12, F-25)."""
    d = F.col("description")
    has = lambda f: filters.has_feature(f, d)
    return places(t).select("id", filters.told().alias("told"), filters.elevation_known(F.col("elevation"), F.col("confidence")).alias("height"), has("uninhabited").alias("empty"), has("tidal").alias("tidal_place"), has("mountain").alias("mountain"), has("castle").alias("castle"), has("lighthouse").alias("lighthouse"))


@query(f"SELECT id FROM {_P} p WHERE (population = 0 OR (population IS NULL AND type = 'sea' AND NOT ferry)) AND NOT coalesce(confidence = 'unconfirmed', false) AND lat BETWEEN 51 AND 59 AND lng BETWEEN -8 AND 0")
def remote_in_bounds(t):
    """Remote places in map bounds, unconfirmed ones hidden (F-14, F-16, F-18)."""
    return filters.Facets(remote=True, hide_unconfirmed=True, bounds=(51.0, -8.0, 59.0, 0.0)).apply(places(t)).select("id")


@query(f"SELECT id FROM {_P} p WHERE has_photo AND trim(coalesce(description, '')) <> '' AND for_sale AND name <> '' AND id IN (SELECT o_custkey FROM orders WHERE o_orderkey % 9 = 1)")
def members_for_sale(t):
    """Members of a collection with a picture, a text and an offer; unnamed ones are left out (F-02, F-05 to F-07, F-09, F-10, F-17)."""
    members = t("orders").filter("o_orderkey % 9 = 1").select(F.col("o_custkey").alias("id"))
    df = places(t).withColumn("unnamed", F.col("name") == "")
    return filters.Facets(has_photo=True, has_story=True, for_sale=True, id_sets=[members]).apply(df).select("id")


@query(
    f"""SELECT id FROM {_P} p WHERE ferry AND nation = 'NATION_3' UNION SELECT id FROM {_P} p WHERE source = 'curated' AND tidal""",
)
def widened_scope(t):
    """A scope that a chip widens: places with a ferry in a nation, and curated tidal ones anywhere (F-08, F-16, F-19)."""
    p = places(t)
    return filters.widened(p.filter("ferry and nation = 'NATION_3'"), p, (F.col("source") == "curated") & F.col("tidal")).select("id")


@query(
    f"""WITH j AS (SELECT id, CASE WHEN lat IS NULL THEN 'missing' WHEN NOT (lat BETWEEN 51 AND 58 AND lng BETWEEN -8 AND 0) THEN 'outside' END AS problem, round(lat, 5) AS a, round(lng, 5) AS b FROM (SELECT CASE WHEN id % 17 = 0 THEN NULL ELSE round(lat, 1) END AS lat, round(lng, 1) AS lng, id FROM {_P} p) q)
 SELECT id, problem FROM j WHERE problem IS NOT NULL UNION ALL SELECT id, 'collision' FROM j WHERE problem IS NULL AND (a, b) IN (SELECT (a, b) FROM j WHERE problem IS NULL GROUP BY a, b HAVING count(*) > 1)"""
)
def coordinate_audit(t):
    """Missing, outside and colliding coordinates (F-31)."""
    p = places(t).select("id", F.when(F.col("id") % 17 != 0, F.round("lat", 1)).alias("lat"), F.round("lng", 1).alias("lng"))
    return filters.coordinate_audit(p, "id", (51.0, -8.0, 58.0, 0.0))


@query(
    f"""SELECT id, CASE WHEN coalesce(trim(CASE WHEN id % 3 = 0 THEN '' ELSE name END), '') = '' AND trim(coalesce(history, '')) = '' AND id % 4 <> 0 THEN (CASE WHEN id % 2 = 0 THEN CASE WHEN id % 5 = 0 THEN CASE WHEN id % 6 = 0 THEN 'not a link' END ELSE 'say what should change' END ELSE 'add a name or a sentence' END) WHEN id % 6 = 0 THEN 'not a link' END AS problem,
 coalesce(source = 'curated', false) OR (name <> '' AND trim(coalesce(description, '')) <> '') AS in_sitemap,
 (regexp_matches(trim(regexp_replace(lower(strip_accents(name)), '[^a-z0-9]+', ' ', 'g')), '^\\S+ (?:island|isle)$') OR (length(trim(regexp_replace(lower(strip_accents(name)), '[^a-z0-9]+', ' ', 'g'))) <= 8 AND NOT contains(trim(regexp_replace(lower(strip_accents(name)), '[^a-z0-9]+', ' ', 'g')), ' '))) AS generic FROM {_P} p"""
)
def record_gates(t):
    """Contributions, pages for the sitemap and names that say little (F-28, F-30, F-36)."""
    i = F.col("id")
    problem = filters.contribution_problem(F.when(i % 2 == 0, "fix_atlas").otherwise("new_pin"), F.when(i % 3 == 0, "").otherwise(F.col("name")), F.col("history"), F.when(i % 5 == 0, "rename it").otherwise(F.lit(None)), F.when(i % 4 == 0, "x.jpg").otherwise(F.lit(None)), F.when(i % 6 == 0, "http://").when(i % 6 == 1, "www.a.org/b").otherwise("a book"))
    curated = F.coalesce(F.col("source") == "curated", F.lit(False))
    return places(t).select("id", problem.alias("problem"), filters.sitemap_eligible(curated, F.lit(False), F.col("name") == "", F.trim(F.coalesce("description", F.lit(""))) != "").alias("in_sitemap"), filters.generic_name(F.col("name")).alias("generic"))


@query(
    f"""SELECT id, named AND coalesce(km <= CASE WHEN generic THEN 5 ELSE 15 END, false) AS dual FROM (SELECT id, id % 4 <> 0 AS named, id % 3 = 0 AS generic, CASE WHEN id % 5 = 0 THEN NULL ELSE CAST(id % 20 AS DOUBLE) END AS km FROM {_P} p) q"""
)
def dual_signals(t):
    """A name and a place together (F-27)."""
    i = F.col("id")
    return places(t).select("id", filters.dual_signal(i % 4 != 0, F.when(i % 5 != 0, (i % 20).cast("double")), i % 3 == 0).alias("dual"))
