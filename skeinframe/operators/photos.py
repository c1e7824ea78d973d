"""Pictures of places: galleries, audits, two rules compared, records and links (survey A-09, M-22, R-26, X-23 to X-25)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold, image_key
from .joins import first_of


def gallery(lead: DataFrame, extras: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, at, url, primary): a place's lead pictures, then extras that are no mere context, each file once, numbered from 1. lead: id, ord, url; extras: id, ord, url, context."""
    a = lead.select(id_col, F.lit(0).alias("_g"), "ord", "url", F.lit(True).alias("primary"))
    b = extras.filter(~F.coalesce(F.col("context"), F.lit(False))).select(id_col, F.lit(1).alias("_g"), "ord", "url", F.lit(False).alias("primary"))
    every = a.unionByName(b).withColumn("_k", image_key(F.col("url")))
    once = first_of(every.filter("_k <> ''"), [id_col, "_k"], [F.col("_g"), F.col("ord")]).unionByName(every.filter("_k = ''"))
    from .topk import per_group

    return per_group(once, [id_col], [F.col("_g"), F.col("ord")], 1 << 30, "at").select(id_col, "at", "url", "primary")


def confidence_bands(scored: DataFrame, confidence: str = "confidence", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """((band, n), (source, n)): pictures by confidence (90 and more, 80 to 89, less) and by source, the commonest first."""
    c = F.col(confidence)
    bands = scored.groupBy(F.when(c >= 90, "gte90").when(c >= 80, "80-89").otherwise("lt80").alias("band")).agg(F.count("*").alias("n"))
    return bands, scored.groupBy(F.coalesce(F.col(source), F.lit("unknown")).alias("source")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source")


def older_pick(hits: DataFrame, place: str) -> DataFrame:
    """(place, file, rule) by the older rule: pictures that name the place, else those within 200 m; named ones first, then the nearest; the first licensed one of eight. hits: place, file, named, metres, photo (no map or emblem), licensed."""
    near = F.coalesce("metres", F.lit(1e9))
    ok = hits.filter("photo").withColumn("_any", F.max("named").over(_by(place)))
    pool = ok.filter(F.when(F.col("_any"), F.col("named")).otherwise(near <= 200))
    return _first_licensed(pool, place, [(~F.col("named")).cast("int"), near, F.col("file")], F.when(F.col("named"), "name").otherwise("proximity_200m"))


def newer_pick(hits: DataFrame, place: str, radius_m: float) -> DataFrame:
    """(place, file, rule) by the newer rule: of the first eight pictures in order the first licensed one that names the place in its title or caption and lies within the radius and a twentieth. hits: as before, and ord, in_caption."""
    good = F.col("licensed") & (F.col("named") | F.col("in_caption")) & F.coalesce(F.col("metres") <= radius_m * 1.05, F.lit(False))
    from .topk import per_group

    first = per_group(hits.filter("photo"), [place], [F.col("ord"), F.col("file")], 8, "_r").filter(good)
    return first_of(first, [place], [F.col("_r")]).select(place, "file", F.lit("name_and_distance").alias("rule"))


def _by(place: str):
    from pyspark.sql import Window

    return Window.partitionBy(place)


def _first_licensed(pool: DataFrame, place: str, order: list[Column], rule: Column) -> DataFrame:
    from .topk import per_group

    top = per_group(pool, [place], order, 8, "_r").filter("licensed")
    return first_of(top, [place], [F.col("_r")]).select(place, "file", rule.alias("rule"))


def yields(older: DataFrame, newer: DataFrame, places: DataFrame, place: str) -> DataFrame:
    """(yield, n): places for which both rules find a picture, one of them only, or none."""
    a, b = older.select(place, F.lit(True).alias("_a")), newer.select(place, F.lit(True).alias("_b"))
    j = places.select(place).join(a, place, "left").join(b, place, "left")
    x, y = F.col("_a").isNotNull(), F.col("_b").isNotNull()
    return j.groupBy(F.when(x & y, "both").when(x, "older only").when(y, "newer only").otherwise("neither").alias("yield")).agg(F.count("*").alias("n"))


def heritage_match(named: Column, km: Column, max_km: Column, prefiltered: Column, tokens: Column, body: Column, small_km: float = 2.0) -> Column:
    """Whether a heritage record is of a place: it names it, lies near enough (or was found by a box), and one of the place's tokens stands in its text; small places need none, nor do those without tokens."""
    near = F.coalesce(prefiltered, F.lit(False)) | F.coalesce(km <= max_km, F.lit(False))
    known = F.filter(F.coalesce(tokens, F.array().cast("array<string>")), lambda t: F.length(F.trim(t)) >= 4)
    return named & near & ((F.size(known) == 0) | F.exists(known, lambda t: F.contains(fold(body), fold(t))) | (max_km <= small_km))


def best_link(links: DataFrame, key: str) -> DataFrame:
    """The best link of a key: by confidence, then through the commons, then through the survey of squares; of equals the least address. links: key, url, confidence, via."""
    rank = F.when(F.col("confidence") == "high", 3).when(F.col("confidence") == "medium", 2).when(F.col("confidence") == "low", 1).otherwise(0)
    return first_of(links, [key], [rank.desc(), (F.col("via") == "commons").cast("int").desc(), (F.col("via") == "geograph").cast("int").desc(), F.col("url")])


def url_inventory(rows: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """(url, uses, fields): every web address of some columns, how often it stands there and where."""
    long = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("url")) for c in columns))).alias("u")).select("u.*").filter(F.col("url").rlike(r"^https?://"))
    return long.groupBy("url").agg(F.count("*").alias("uses"), F.array_join(F.array_sort(F.collect_set("field")), ",").alias("fields"))


