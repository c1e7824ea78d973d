"""Which water a place lies in: evidence tiers over water polygons and land (survey M-06, M-07, M-09, A-19, J-18)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import name_key_variant
from .joins import nearest, nearest_polygon, points_in_polygons, same_key, smallest_polygon, within_km
from .tables import durable

#: Metres up to which a place on land belongs to the nearest water, and up to which that is more than a guess.
NEAR_M, SURE_M = 500, 200
#: Sources of a classification that stays.
KEPT_SOURCES = ("tier-a", "tier-b", "manual", "curated", "thames-list", "wp-category", "crannog-subtype-override")


def verdicts(places: DataFrame, entities: DataFrame, water: DataFrame, land: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, tier, type, parent, confidence, before): what each place's water is, by the first evidence there is.

    0 what was classified before by a source that stays; 1 what a linked entity
    says; 3 the smallest water polygon that holds the place; 4 on land, the nearest
    water within NEAR_M; 2 on land without any: unknown; else the sea. Each tier
    sees only places that none before it has settled. places: id, lat, lng, type,
    class_source, entity; entities: entity, type, parent; water: body, kind, area,
    outers, inners; land: polygon, outers, inners.
    """
    row = lambda df, tier, kind, parent, sure: df.select(id_col, F.lit(tier).alias("tier"), kind.alias("type"), parent.cast("string").alias("parent"), sure.alias("confidence"))
    kept = row(places.filter(F.col("class_source").isin(*KEPT_SOURCES)), 0, F.col("type"), F.lit(None), F.lit("kept"))
    rest = places.join(kept.select(id_col), id_col, "left_anti").drop("type")
    linked = row(rest.join(entities, "entity"), 1, F.col("type"), F.col("parent"), F.lit("high"))
    rest = rest.join(linked.select(id_col), id_col, "left_anti").select(id_col, "lat", "lng")
    bodies = water.select("body", F.col("kind").alias("_kind"))
    rest = durable(rest, "open-places")
    inside = row(durable(smallest_polygon(rest, water, id_col, "body"), "in-water").join(bodies, "body"), 3, F.col("_kind"), F.col("body"), F.lit("medium"))
    rest = rest.join(inside.select(id_col), id_col, "left_anti")
    ashore = durable(points_in_polygons(rest, land, "polygon").select(id_col, "lat", "lng").dropDuplicates([id_col]), "ashore")
    close = durable(nearest_polygon(ashore, water, id_col, "body", NEAR_M), "near-water").join(bodies, "body")
    near = row(close, 4, F.col("_kind"), F.col("body"), F.when(F.col("metres") <= SURE_M, "medium").otherwise("low"))
    dry = row(ashore.join(near.select(id_col), id_col, "left_anti"), 2, F.lit("unknown"), F.lit(None), F.lit("low"))
    sea = row(rest.join(ashore.select(id_col), id_col, "left_anti"), 2, F.lit("sea"), F.lit(None), F.lit("high"))
    all_ = kept.unionByName(linked).unionByName(inside).unionByName(near).unionByName(dry).unionByName(sea)
    return all_.join(places.select(id_col, F.col("type").alias("before")), id_col)


def proposals(judged: DataFrame) -> DataFrame:
    """Verdicts that change a type, with the change as before>after."""
    return judged.filter((F.col("tier") > 0) & (F.col("type") != F.col("before"))).withColumn("change", F.concat_ws(">", "before", "type"))


def reclassified(places: DataFrame, accepted: DataFrame, id_col: str = "id") -> DataFrame:
    """Places with the type, subtype and parent that accepted proposals give; curated ones stay. accepted: id, type, subtype, parent; a blank subtype takes it away."""
    new = accepted.select(id_col, *(F.col(c).alias(f"_{c}") for c in ("type", "subtype", "parent")), F.lit(True).alias("_new"))
    use = F.coalesce(F.col("_new"), F.lit(False)) & ~F.coalesce(F.col("source") == "curated", F.lit(False))
    j = places.join(new, id_col, "left")
    pick = {"type": F.coalesce("_type", "type"), "subtype": F.nullif(F.col("_subtype"), F.lit("")), "parent": F.col("_parent")}
    return j.withColumns({c: F.when(use, v).otherwise(F.col(c)) for c, v in pick.items()}).drop("_type", "_subtype", "_parent", "_new")


def inner_ring_parents(rings: DataFrame, bodies: DataFrame) -> DataFrame:
    """(way, body): of the water bodies in which a way is an inner ring the smallest; of equals a lake before a river, then the least id. An unknown area is the largest."""
    area = F.coalesce("area", F.lit(float("inf")))
    order = F.struct(area.alias("a"), (F.col("kind") != "lake").alias("k"), F.col("body"))
    return rings.join(bodies, "body").groupBy("way").agg(F.min(order)["body"].alias("body"))


def inner_ring_places(parents: DataFrame, places: DataFrame, ways: DataFrame, max_km: float = 1.0) -> DataFrame:
    """(way, id, how): the place that is the way, else the nearest of its name within ``max_km``, else null: a new place. places: id, name, lat, lng, map_type, map_id; ways: way, name, lat, lng; unnamed ways that are no place are left out."""
    same = parents.select("way").join(places.filter("map_type = 'way'").select(F.col("map_id").alias("way"), "id"), "way").select("way", "id", F.lit("same").alias("how"))
    rest = ways.join(parents.select("way"), "way", "left_semi").join(same.select("way"), "way", "left_anti").filter(F.trim(F.coalesce("name", F.lit(""))) != "")
    key = lambda c: name_key_variant(F.col(c), "inland")
    near = within_km(rest.select("way", "lat", "lng", key("name").alias("_a")), places.select("id", "lat", "lng", key("name").alias("_b")), max_km).filter(F.col("_a") == F.col("_b"))
    merged = near.groupBy("way").agg(F.min(F.struct("km", "id"))["id"].alias("id")).withColumn("how", F.lit("merged"))
    new = rest.join(merged.select("way"), "way", "left_anti").select("way", F.lit(None).cast(dict(places.dtypes)["id"]).alias("id"), F.lit("new").alias("how"))
    return same.unionByName(merged).unionByName(new)


def distance_band(metres: Column) -> Column:
    # Bands of distance
    bands = ((50, "0-50m"), (100, "50-100m"), (200, "100-200m"), (500, "200-500m"), (1000, "500m-1km"), (5000, "1km-5km"))
    out = F.lit(">5km")
    for most, label in reversed(bands):
        out = F.when(metres <= most, label).otherwise(out)
    return out


def proximity_profile(points: DataFrame, water: DataFrame, id_col: str = "id", max_m: float = 10_000) -> DataFrame:
    """(band, n, within_100, within_500): how far points are from the nearest water; those beyond ``max_m`` stand in the last band."""
    near = points.join(nearest_polygon(points, water, id_col, "body", max_m), id_col, "left")
    m = F.coalesce("metres", F.lit(float("inf")))
    return near.groupBy(distance_band(m).alias("band")).agg(F.count("*").alias("n"), F.count(F.when(m <= 100, 1)).alias("within_100"), F.count(F.when(m <= 500, 1)).alias("within_500"))


def sites_of_places(sites: DataFrame, places: DataFrame, polygons: DataFrame, max_km: float) -> DataFrame:
    """(site, place, how) of lighthouses, reserves and the like: the polygon that holds a site, else a place of its name, else the nearest place within ``max_km``. sites: site, name, lat, lng; places: place, name, lat, lng; polygons: place, area, outers, inners."""
    inside = durable(smallest_polygon(sites, polygons, "site", "place"), "in-polygons").withColumn("how", F.lit("polygon"))
    rest = sites.join(inside.select("site"), "site", "left_anti")
    key = lambda c: name_key_variant(F.col(c), "inland")
    named = rest.select("site", key("name").alias("_k")).filter("_k <> ''").join(places.groupBy(key("name").alias("_k")).agg(F.min("place").alias("place")), "_k").groupBy("site").agg(F.min("place").alias("place")).withColumn("how", F.lit("name"))
    rest = rest.join(named.select("site"), "site", "left_anti")
    near = nearest(rest, places, "site", "place", max_km).select("site", "place").withColumn("how", F.lit("near"))
    return inside.unionByName(named).unionByName(near)


def reserves_of_places(reserves: DataFrame, places: DataFrame, max_km: float = 1.0) -> DataFrame:
    """(reserve, place): every place of a reserve's name and every place within ``max_km``; each pair once.

    Names meet as lists of ids, and what is near leaves out what has one name, so
    pairs are not shuffled; only those of ids that have several rows are made distinct.
    """
    a, b = _keyed(reserves, "reserve"), _keyed(places, "place")
    once = _reserve_pairs(a.filter("not _many"), b.filter("not _many"), max_km)
    if a.filter("_many").isEmpty() and b.filter("_many").isEmpty():
        return once
    return once.unionByName(_reserve_pairs(a.filter("_many"), b, max_km).unionByName(_reserve_pairs(a.filter("not _many"), b.filter("_many"), max_km)).distinct())


def _keyed(df: DataFrame, id_col: str) -> DataFrame:
    """(id, lat, lng, _k, _many): the name's key, null if it is blank; and whether the id has several rows. The key of a name is made once."""
    rows = df.select(id_col, "lat", "lng", "name").distinct()
    names = durable(rows.select("name").distinct().filter("name is not null").select("name", name_key_variant(F.col("name"), "inland").alias("_k")), "name-keys")
    keyed = rows.join(names.filter("_k <> ''"), "name", "left").drop("name").distinct()
    return durable(keyed.withColumn("_many", F.count("*").over(Window.partitionBy(id_col)) > 1), "keyed-" + id_col)


def _reserve_pairs(a: DataFrame, b: DataFrame, max_km: float) -> DataFrame:
    """(reserve, place) of one name or near each other."""
    key = lambda d, i: d.filter("_k is not null").select(i, "_k").distinct()
    named = same_key(key(a, "reserve"), key(b, "place"), "_k", "reserve", "place")
    near = within_km(a.select("reserve", "lat", "lng", F.col("_k").alias("_ka")), b.select("place", "lat", "lng", F.col("_k").alias("_kb")), max_km)
    return named.unionByName(near.filter("not coalesce(_ka = _kb, false)").select("reserve", "place"))
