"""Text-plus-place evidence: sentences, aliases, radii and ordered reasons (survey J-13, J-31, P-37, P-50, X-01 to X-26)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import equal_area_radius_m, haversine_km
from ..functions.text import fold, name_key, search_norm, whole_word
from .joins import cells, first_of, within_km
from .tables import durable


def name_variants(name: Column) -> Column:
    """A name, its key, and its forms with Isle of and Island; each once."""
    n, k = F.trim(name), name_key(name)
    return F.array_distinct(F.filter(F.array(F.lower(n), k, F.concat(F.lit("isle of "), k), F.concat(F.lit("island of "), k), F.concat(k, F.lit(" island")), F.concat(k, F.lit(" isle"))), lambda x: F.trim(x) != ""))


def mentions(body: Column, name: Column) -> Column:
    return F.exists(name_variants(name), lambda v: whole_word(body, v))


def location_sentence(body: Column, name: Column) -> Column:
    """Whether a sentence sets something on a place: 'on X', 'in X', 'isle of X', 'X island'; not one that only looks across at it."""
    x = search_norm(name)

    def says(s: Column) -> Column:
        t = F.concat(F.lit(" "), search_norm(s), F.lit(" "))
        has = lambda *parts: F.contains(t, F.concat(F.lit(" "), *(F.lit(p) if isinstance(p, str) else p for p in parts), F.lit(" ")))
        isle = has("on the isle of ", x) | has("in the isle of ", x)
        placed = has("on ", x) | has("in ", x) | has("isle of ", x) | has("island of ", x) | has(x, " distillery") | has(x, " island")
        across = has("opposite ", x) | has("across from ", x)
        return isle | (placed & ~across)

    return (x != "") & F.exists(F.split(F.coalesce(body, F.lit("")), r"[.\n]"), says)


def circle_km(area: Column, factor: float = 1.45, unknown_km: float = 0.4) -> Column:
    """How far a place of some km2 reaches: its equal-area circle widened by ``factor``; ``unknown_km`` without an area."""
    return F.when(area > 0, F.greatest(F.lit(0.35), factor * equal_area_radius_m(area) / 1000)).otherwise(unknown_km)


def in_reach(points: DataFrame, places: DataFrame, point_id: str, place_id: str, factor: float = 1.45, unknown_km: float = 0.4, most_km: float = 75.0) -> DataFrame:
    """(point_id, place_id, km) of places whose equal-area circle, widened by ``factor``, holds a point; those without an area reach ``unknown_km``."""
    sized = places.select(F.col(place_id), "lat", "lng", circle_km(F.col("area"), factor, unknown_km).alias("reach"))
    return reached(points.select(point_id, "lat", "lng"), sized, most_km).select(point_id, place_id, "km")


def reached(points: DataFrame, sized: DataFrame, most_km: float, keys: Sequence[str] = ()) -> DataFrame:
    """Points joined to what lies no further than its ``reach`` from them, with ``km``; what reaches further than ``most_km`` takes no part. Sides have columns lat and lng, equal ``keys`` and otherwise distinct names.

    Places lie in the cells of their band of reach, each half as wide as the one before, so that
    small ones are not probed as far as large ones; a point is put into its cell of every band.
    """
    ok = F.col("lat").between(-90, 90) & F.col("lng").isNotNull() & ~F.isnan("lng")
    fits = sized.filter(ok & (F.col("reach") <= most_km)).withColumn("_b", F.greatest(F.lit(0), F.least(F.lit(30), F.floor(F.log2(most_km / F.greatest("reach", F.lit(1e-6))))))).withColumn("_b", F.col("_b").cast("int"))
    # a band's cells are a little wider than what its places reach, whatever the logarithm's last digit
    bands = {r[0]: cells(most_km / 2 ** r[0] * 1.001, F.col("lat"), F.col("lng")) for r in fits.select("_b").distinct().collect()}  # 31 at most
    if not bands:
        bands = {0: cells(most_km, F.col("lat"), F.col("lng"))}
    own = F.array(*(F.struct(F.lit(b).alias("b"), at.alias("c")) for b, (at, _) in sorted(bands.items())))
    around = F.coalesce(*(F.when(F.col("_b") == b, F.transform(cs, lambda c: F.struct(F.col("_b").alias("b"), c.alias("c")))) for b, (_, cs) in bands.items()))
    p = points.filter(ok).withColumn("_c", F.explode(own)).withColumnsRenamed({"lat": "_lat1", "lng": "_lng1"})
    q = fits.withColumn("_c", F.explode(around)).drop("_b").withColumnsRenamed({"lat": "_lat2", "lng": "_lng2"})
    km = haversine_km(F.col("_lat1"), F.col("_lng1"), F.col("_lat2"), F.col("_lng2"))
    return p.hint("merge").join(q, ["_c", *keys]).withColumn("km", km).filter(F.col("km") <= F.col("reach")).drop("_c", "_lat1", "_lng1", "_lat2", "_lng2")


def any_reach(points: DataFrame, sized: DataFrame, point_id: str, most_km: float, further: float = 3.0) -> DataFrame:
    """(point_id) of points that something reaches. By rounds of growing distance: only points that nothing near reaches look further, and then only at what reaches further."""
    p, out, low, km = durable(points.select(point_id, "lat", "lng"), "reach-points"), None, 0.0, 1.0
    far = min(most_km, sized.filter(F.col("reach") <= most_km).agg(F.max("reach")).first()[0] or 0.0)
    while low < far or out is None:
        high = km if km < far else max(far, 1e-3)
        hit = within_km(p, sized.filter((F.col("reach") > low) & (F.col("reach") <= most_km)), high).filter("km <= reach").select(point_id).distinct()
        hit = durable(hit, "reach-found")
        out = hit if out is None else out.unionByName(hit)
        if high < far:
            p = durable(p.join(hit, point_id, "left_anti"), "reach-points")
        low, km = high, high * further
    return out


def first_evidence(candidates: Sequence[tuple[str, DataFrame]], item: str, place: str) -> DataFrame:
    """(item, place, reason): the first kind of evidence that names exactly one place."""
    out = None
    for n, (reason, df) in enumerate(candidates):
        sole = df.select(item, place).distinct().groupBy(item).agg(F.min(place).alias(place), F.count("*").alias("_c")).filter("_c = 1").select(item, place, F.lit(reason).alias("reason"), F.lit(n).alias("_n"))
        out = sole if out is None else out.unionByName(sole)
    return first_of(out, [item], [F.col("_n")]).drop("_n")


def one_place_only(phrases: DataFrame, denied: DataFrame, item: str, phrase: str, place: str) -> DataFrame:
    """Items whose phrases, without the denied ones, all mean one place; with the longest phrase."""
    left = phrases.join(denied.select(phrase).distinct(), phrase, "left_anti")
    return left.groupBy(item).agg(F.countDistinct(place).alias("_n"), F.min(place).alias(place), F.max_by(phrase, F.struct(F.length(phrase), F.col(phrase))).alias(phrase)).filter("_n = 1").drop("_n")


def smallest_owner(items: DataFrame, title: str, area: str, order: str) -> DataFrame:
    """Of items with one title on several places, the one on the smallest; of equals the first."""
    return first_of(items.withColumn("_k", search_norm(F.col(title))), ["_k"], [F.col(area).asc_nulls_last(), F.col(order)]).drop("_k")


def geo_anchor(km: Column, body: Column, anchors: Sequence[str], max_km: float) -> Column:
    """ok or a reason: a known distance decides; without one an anchor word must stand in the text."""
    near = F.lit(False)
    for a in anchors:
        near = near | whole_word(body, F.lit(a))
    return F.when(km.isNotNull(), F.when(km <= max_km, "ok").otherwise("too far")).when(near, "ok").otherwise("no anchor")


def relation_class(known_entity: Column, entity_km: Column, known_object: Column, gazetteer: Column, gazetteer_km: Column, search_km: Column, article: Column) -> Column:
    """Confidence in a candidate by its sources, the strongest first."""
    return (
        F.when(known_entity, F.when(entity_km > 5, "medium").otherwise("high"))
        .when(known_object, "medium").when(gazetteer & (gazetteer_km >= 2), "hint").when(search_km <= 3, "medium").when(article, "medium").otherwise("rejected")
    )


def longest_alias(texts: DataFrame, aliases: DataFrame, text_id: str, body: str) -> DataFrame:
    """(text_id, owner) of the longest alias that the folded text holds; of equals the first in order. aliases: alias, owner.

    Aliases meet texts over their first letters, as many as the shortest alias
    has, so that the join is an equi-join at any number of aliases.
    """
    a = aliases.select(fold(F.col("alias")).alias("_a"), "owner").filter("_a <> ''")
    n = a.agg(F.min(F.length("_a"))).first()[0]
    if n is None:
        return texts.select(text_id, F.lit(None).cast("string").alias("owner")).limit(0)
    t = texts.select(text_id, fold(F.col(body)).alias("_t"))
    starts = F.when(F.length("_t") >= n, F.sequence(F.lit(1), F.length("_t") - n + 1)).otherwise(F.array().cast("array<int>"))
    grams = F.array_distinct(F.transform(starts, lambda i: F.substring(F.col("_t"), i, F.lit(n))))
    hit = t.withColumn("_g", F.explode(grams)).join(a.withColumn("_g", F.substring("_a", 1, n)), "_g").filter(F.contains(F.col("_t"), F.col("_a")))
    return hit.groupBy(text_id).agg(F.min(F.struct((-F.length("_a")).alias("n"), "_a", "owner"))["owner"].alias("owner"))
