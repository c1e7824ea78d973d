"""Duplicate places: pair rules, components, sanity, keepers and merging (survey G-01 to G-03, W-06, M-01, M-05, U-05)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import equal_area_radius_m, haversine_km
from ..functions.text import name_relation, plain_name
from .graph import components
from .joins import within_km
from .topk import keeper

Side = Callable[[str], Column]


def between(low: float, value: Column, high: float) -> Column:
    return F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), value))


def pair_reason(a: Side, b: Side, metres: Column) -> Column:
    """Why two records are one place, or null. Sides give id, name, nation, area (km2), map_type, map_id and parent."""
    area_a, area_b = F.coalesce(a("area"), F.lit(0.0)), F.coalesce(b("area"), F.lit(0.0))
    both, one = (area_a > 0) & (area_b > 0), (area_a > 0) != (area_b > 0)
    ratio = F.try_divide(F.greatest(area_a, area_b), F.least(area_a, area_b))
    ra, rb = equal_area_radius_m(area_a), equal_area_radius_m(area_b)
    r, reach = F.least(ra, rb), ra + rb
    names = name_relation(a("name"), b("name"))
    far_abroad = (F.coalesce(a("nation"), F.lit("")) != F.coalesce(b("nation"), F.lit(""))) & (metres > 40)
    outline = F.when(names.isNull(), F.greatest(F.lit(8.0), 0.25 * r)).otherwise(F.greatest(F.lit(12.0), 0.08 * r))
    pa, pb = plain_name(a("parent")), plain_name(b("parent"))
    one_parent = (pa == "") | (pb == "") | (pa == pb)
    outlined = (
        F.when((ratio <= 1.03) & (metres <= outline), "same-outline")
        .when((names == "exact") & (ratio <= 1.25) & (metres <= between(30, 0.35 * r, 250)) & (metres < 0.8 * reach), "same-name")
        .when((names == "close") & (ratio <= 1.08) & (metres <= between(20, 0.25 * r, 120)), "close-name")
        .when((names == "unnamed") & (ratio <= 1.20) & (metres <= between(25, 0.30 * r, 200)) & (metres < 0.75 * reach) & (one_parent | ((metres <= 15) & (ratio <= 1.05))), "named-and-unnamed-outline")
    )
    pointed = F.when(names.isNotNull() & ~((names == "close") & (metres > 30)) & (metres <= between(35, 0.4 * F.greatest(ra, rb), 80)), "point-and-outline")
    same_object = a("map_type").isNotNull() & a("map_id").isNotNull() & (a("map_type") == b("map_type")) & (a("map_id") == b("map_id"))
    return F.when(a("id") == b("id"), None).when(same_object, "same-osm-object").when(far_abroad, None).when(both, outlined).when(one, pointed)


FIELDS = ("id", "name", "nation", "area", "map_type", "map_id", "parent")


def duplicate_pairs(places: DataFrame, max_km: float = 0.5) -> DataFrame:
    """(u, v, reason) with u < v of places that are one, found within ``max_km``."""
    side = lambda p: places.select("lat", "lng", F.struct(*FIELDS).alias(p))
    near = within_km(side("a"), side("b"), max_km).filter("a.id < b.id")
    reason = pair_reason(lambda f: F.col(f"a.{f}"), lambda f: F.col(f"b.{f}"), F.col("km") * 1000)
    return near.select(F.col("a.id").alias("u"), F.col("b.id").alias("v"), reason.alias("reason")).filter("reason is not null")


def sane_groups(places: DataFrame, groups: DataFrame) -> DataFrame:
    """Groups (node, component) whose members lie within max(100 m, 0.45 of the least radius) of each other, with one curated at most.

    The diameter is bounded by the box of the group's points, so no pairs are made.
    """
    j = groups.join(places.select(F.col("id").alias("node"), "lat", "lng", "area", "curated"), "node")
    box = j.groupBy("component").agg(F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lng").alias("w"), F.max("lng").alias("e"), F.min(equal_area_radius_m(F.when(F.col("area") > 0, F.col("area")))).alias("r"), F.count(F.when(F.col("curated"), 1)).alias("c"))
    wide = haversine_km(F.col("s"), F.col("w"), F.col("n"), F.col("e")) * 1000
    good = box.filter((wide <= F.greatest(F.lit(100.0), 0.45 * F.coalesce("r", F.lit(0.0)))) & (F.col("c") <= 1)).select("component")
    return groups.join(good, "component", "left_semi")


def keepers(places: DataFrame, groups: DataFrame) -> DataFrame:
    """(component, keeper): curated, with an area, named, with links and pictures, a relation, described; the largest id of equals."""
    j = groups.join(places.withColumnRenamed("id", "node"), "node")
    filled = lambda c: (F.trim(F.coalesce(F.col(c), F.lit(""))) != "").cast("int")
    tests = [F.coalesce(F.col("curated"), F.lit(False)).cast("int"), (F.coalesce("area", F.lit(0.0)) > 0).cast("int"), filled("name"), filled("wikidata"), filled("wikipedia"), F.coalesce(F.col("has_photo"), F.lit(False)).cast("int"), F.coalesce(F.col("map_type") == "relation", F.lit(False)).cast("int"), F.coalesce(F.col("source").isin("osm", "curated", "wikidata"), F.lit(False)).cast("int"), filled("description"), (~F.coalesce(F.col("source") == "discovery", F.lit(False))).cast("int")]
    return keeper(j, ["component"], tests, "node").select("component", F.col("node").alias("keeper"))


def retired(groups: DataFrame, kept: DataFrame) -> DataFrame:
    """(old, new): aliases from dropped ids to their keepers."""
    return groups.join(kept, "component").filter("node <> keeper").select(F.col("node").alias("old"), F.col("keeper").alias("new"))


def resolve(places: DataFrame, max_km: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(places that stay, aliases)."""
    groups = sane_groups(places, components(duplicate_pairs(places, max_km)))
    gone = retired(groups, keepers(places, groups))
    return places.join(gone.select(F.col("old").alias("id")), "id", "left_anti"), gone


def borrowed_names(places: DataFrame, claims: DataFrame) -> DataFrame:
    """Ids whose name was taken from a source point over 15 m away that lies within 80 m of another place at least half as large again. claims: id, lat, lng (of the source)."""
    own = claims.withColumnsRenamed({"lat": "clat", "lng": "clng"}).join(places.select("id", "lat", "lng", "area"), "id")
    off = own.filter(haversine_km(F.col("clat"), F.col("clng"), F.col("lat"), F.col("lng")) > 0.015).select("id", F.col("area").alias("own_area"), F.col("clat").alias("lat"), F.col("clng").alias("lng"))
    others = places.select(F.col("id").alias("other"), F.col("area").alias("other_area"), "lat", "lng")
    return within_km(off, others, 0.08).filter((F.col("id") != F.col("other")) & (F.col("other_area") >= 1.5 * F.col("own_area"))).select("id").distinct()
