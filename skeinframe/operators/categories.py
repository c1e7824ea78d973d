"""Categories such as 'Songs about X' that mean one place (survey X-17), with an index of names that also mean something else."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import escape_pattern, fold, name_key
from .evidence import one_place_only
from .joins import first_of
from .tables import durable

# What tells that a name elsewhere in the world is meant at home, years, and sizes that make a name safe
HOME = "Scotland|Scottish|England|English|Wales|Welsh|Ireland|Irish|Isle of Man|Manx|United Kingdom|Channel Islands|Hebrides|Orkney|Shetland|Guernsey|Jersey|Cornwall|Cornish|Argyll|Highland|Cork|Mayo|Galway|Kerry|Donegal|Dublin|Antrim|Down|Devon|Dorset|Kent|Essex|Suffolk|Norfolk|Hampshire|Sussex|Cumbria|Northumberland|Anglesey|Pembrokeshire|Gwynedd|Outer Hebrides|Inner Hebrides"
YEAR = r"(?i)^(?:the\s+)?(?:(?:early|mid|late)\s+)?(?:1[0-9]{3}|20[0-9]{2})s?$|^(?:the\s+)?\d{1,2}(?:st|nd|rd|th)\s+century$"
LARGE_NAMESAKE, OWN_COUNTRY, OWN_WORD = 20.0, 200.0, 1.0
REGION = rf"(?i)(?:,\s*|\s+(?:in|of)\s+(?:the\s+)?)(?:{HOME})$"


def clean(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "), r"^[ ,.;:\-–—]+|[ ,.;:\-–—]+$", "")


def phrase_of(category: Column, prefixes: Sequence[str]) -> Column:
    """What stands behind the first of some prefixes that a category begins with; null without one."""
    name = F.array(clean(F.regexp_replace(category, "(?i)^category:", "")))  # a list, so that it is made once for all prefixes
    behind = F.flatten(F.transform(name, lambda n: F.array(*(clean(F.regexp_extract(n, rf"(?i)^{re.escape(p)}\s+(.+)$", 1)) for p in prefixes))))
    return F.get(F.filter(behind, lambda p: p != ""), F.lit(0))


def phrase_variants(phrase: Column) -> Column:
    """A phrase also without brackets, without 'by ...', without the region behind it, and without 'the'; each once by its folded form."""
    # each step names the array before it once, or Spark would make that anew for each name
    step = lambda a, f: F.array_distinct(F.flatten(F.transform(a, lambda p: F.array(p, clean(f(p))))))
    out = step(F.array(phrase), lambda p: F.regexp_replace(p, r"\s*\([^)]*\)", " "))
    out = step(out, lambda p: F.split(p, r"(?i)\s+by\s+", 2)[0])
    out = step(out, lambda p: F.regexp_replace(p, REGION, ""))
    out = step(out, lambda p: F.regexp_replace(p, r"(?i)^the\s+", ""))
    return F.array_distinct(F.filter(F.transform(out, fold), lambda p: p != ""))


def ambiguity_index(wider: DataFrame) -> DataFrame:
    """(phrase, kinds): what a folded name means besides a place: nation, topic, overseas, town or elsewhere. wider: name, kind."""
    return wider.select(fold(F.trim("name")).alias("phrase"), "kind").filter("phrase <> ''").groupBy("phrase").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))


def _says(folded: Column, phrase: Column) -> Column:
    return F.regexp_like(folded, F.concat(F.lit(r"\b"), escape_pattern(phrase), F.lit(r"\b")))


def judged_categories(categories: DataFrame, places: DataFrame, wider: DataFrame, prefixes: Sequence[str]) -> DataFrame:
    """(category, phrase, place, reason): each form of a category's phrase that is a place's name, with why it does not count, or null.

    A place is meant by its whole name, else by its key; of several the largest.
    Reasons, the first that holds: a nation; a topic; overseas (without a word for
    home in the rest of the category); namesakes (three or more of a name, none
    large); a town, unless the category says the place's longer name, or a place that
    needs a word of its own; elsewhere (a country or region, unless the place is
    large); a word that only a tiny 'X island' shares. Years are no names.

    categories: category; places: place, name, area, only_with (words, divided by |,
    one of which the category must have; mostly null); wider: name, kind. Null
    categories and names match nothing, repeated ones count once.
    """
    c = categories.select("category").distinct()
    # an outer explode: before an inner one, as before a filter, Spark makes the forms once more to see whether there are any
    v = c.select("category", F.explode_outer(phrase_variants(phrase_of(F.col("category"), prefixes))).alias("phrase")).filter((F.length("phrase") >= 3) & ~F.col("phrase").rlike(YEAR))
    p = places.filter("name is not null").select("place", fold(F.trim("name")).alias("_n"), name_key(F.col("name")).alias("_pk"), F.coalesce("area", F.lit(0.0)).alias("_area"), "only_with").filter("_n <> ''")
    p = durable(p, "names")
    same = p.groupBy("_n").agg(F.count("*").alias("_same"), F.max("_area").alias("_most"))
    p = p.join(same, "_n")
    # the first place of a name and of a key are tables of their own, so that a phrase meets one row and none is met in vain
    first = lambda c: durable(first_of(p, [c], [F.col("_area").desc(), F.col("place")]).select(F.col(c).alias("_by"), F.struct("place", "_n", "_area", "_same", "_most", "only_with").alias("_place")), "first-places")
    named, keyed = first("_n"), first("_pk")
    hit = v.join(named.withColumnRenamed("_by", "phrase"), "phrase", "left").withColumn("_by", F.when(F.col("_place").isNull(), F.nullif(name_key(F.col("phrase")), F.lit(""))))
    hit = hit.join(keyed.withColumnRenamed("_place", "_other"), "_by", "left").select("category", "phrase", F.coalesce("_place", "_other").alias("_place")).filter("_place is not null")
    hit = hit.join(ambiguity_index(wider), "phrase", "left").select("category", "phrase", "_place.*", "kinds")
    k = lambda kind: F.coalesce(F.array_contains("kinds", kind), F.lit(False))
    category, phrase, name, area = (F.col(x) for x in ("category", "phrase", "_n", "_area"))
    hit = hit.withColumn("_f", fold(category))
    hit = hit.withColumns({"_says": _says(F.col("_f"), phrase), "_says_name": _says(F.col("_f"), name)})
    says_name = F.col("_says_name")
    rest = F.regexp_replace(category, F.concat(F.lit("(?i)"), escape_pattern(phrase)), F.lit(" "))
    reason = (
        F.when(k("nation"), "nation").when(k("topic"), "topic").when(~F.col("_says") & ~says_name, "not in the category")
        .when(k("overseas") & ~rest.rlike(rf"\b(?:{HOME})\b"), "overseas").when((F.col("_same") >= 3) & (F.col("_most") < LARGE_NAMESAKE), "namesakes")
        .when(F.col("only_with").isNotNull() & ~F.regexp_like(F.col("_f"), F.concat(F.lit(r"\b(?:"), fold(F.col("only_with")), F.lit(r")\b"))), "needs a word")
        .when(k("town") & ~(says_name & (phrase != name)), "town").when(k("elsewhere") & (area < OWN_COUNTRY), "elsewhere")
        .when(((name == F.concat(phrase, F.lit(" island"))) | (name == F.concat(phrase, F.lit(" islands")))) & ~says_name & (area < OWN_WORD), "a common word")
    )
    return hit.select("category", "phrase", "place", reason.alias("reason"))


def category_places(categories: DataFrame, places: DataFrame, wider: DataFrame, prefixes: Sequence[str]) -> DataFrame:
    """(category, place, phrase) of the categories whose forms that count all mean one place, with the longest of them."""
    kept = judged_categories(categories, places, wider, prefixes).filter("reason is null")
    return one_place_only(kept, kept.select("phrase").limit(0), "category", "phrase", "place")
