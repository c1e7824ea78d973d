"""Scoring models as column expressions (survey R-01 to R-26)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import fold

# Typical top score of each interest, and the default
CEILINGS = {"unusual-news": 48, "island-castles": 36, "unusual-wildlife": 36, "whisky-distilleries": 36, "island-books": 24, "local-traditions": 26, "tidal-islands": 30, "film-art-music": 32}
CEILING = 28


def _gaps(name: Column, query: str) -> Column:
    """Characters skipped between the letters of ``query``, each taken at its first place after the last; null if it is no subsequence."""
    quote = lambda ch: "\\" + ch if not ch.isalnum() else ch
    pattern = f"(?s)^[^{quote(query[0])}]*(" + quote(query[0]) + "".join(f"[^{quote(c)}]*{quote(c)}" for c in query[1:]) + ")"
    return F.when(name.rlike(pattern), F.length(F.regexp_extract(name, pattern, 1)) - len(query))


def search_score(name: Column, haystack: Column, query: str) -> Column:
    """How well a normalised query fits a normalised name; null excludes. Ranks: whole name, its start, a word's start, a part, a subsequence, other text."""
    if not query:
        return F.lit(0)
    q, n = F.lit(query), F.length(name)
    at = F.position(q, name)
    gap = _gaps(name, query)
    return (
        F.when(name == "", None)
        .when(name == q, F.lit(1000))
        .when(name.startswith(query), 800 - n)
        .when(F.contains(name, F.lit(" " + query)), 600 - n)
        .when(at > 0, 401 - at)
        .when(gap.isNotNull(), 200 - gap - (n - len(query)))
        .when(F.contains(haystack, q), F.lit(50))
    )


# Points of the tool's and the lookup's scores are those in the two functions below
def token_score(name: Column, water: Column, archipelago: Column, summit: Column, story: Column, tokens: Sequence[str]) -> Column:
    """Score of folded fields for a tool's query; null unless each token is in some field."""
    hits = {k: sum((F.contains(c, F.lit(t)).cast("int") for t in tokens), F.lit(0)) for k, c in (("name", name), ("water", water), ("arch", archipelago), ("peak", summit), ("story", story))}
    everywhere = F.lit(True)
    for t in tokens:
        everywhere = everywhere & (F.contains(name, F.lit(t)) | F.contains(water, F.lit(t)) | F.contains(archipelago, F.lit(t)) | F.contains(summit, F.lit(t)) | F.contains(story, F.lit(t)))
    n = len(tokens)
    bare = F.trim(F.regexp_replace(F.regexp_replace(name, r"\b(?:isle|island|of|the)\b", " "), r"\s+", " "))
    score = (
        F.lit(1)
        + F.when(hits["name"] == n, 40 + hits["name"]).when(hits["name"] > 0, 15 + 3 * hits["name"]).otherwise(0)
        + F.when(hits["water"] == n, 28).when(hits["water"] > 0, 10).otherwise(0)
        + F.when(hits["arch"] > 0, 12).otherwise(0)
        + F.when(hits["peak"] > 0, 18).otherwise(0)
        + F.when(hits["story"] > 0, 6 + 2 * hits["story"]).otherwise(0)
        + F.when(bare == " ".join(tokens), 30).otherwise(0)
    )
    return F.when(everywhere, score)


def size_score(area: Column, has_photo: Column) -> Column:
    """Without a query: size on a log scale up to 5, and a little for a picture."""
    return 1 + F.least(F.lit(5.0), F.log10(1 + F.coalesce(area, F.lit(0.0)))) + F.when(has_photo, 0.4).otherwise(0.0)


def bare_name(name: Column) -> Column:
    """A folded name without what it may begin with."""
    return F.trim(F.regexp_replace(fold(name), r"^(?:the |isle of |island of )", ""))


def bare_name_score(n: Column, query: str, area: Column, population: Column) -> Column:
    """Bare names for a lookup: the same 100, one begins the other 50 + shorter length, one holds the other 20 + it; plus size. Null: no fit."""
    q = F.lit(query)
    short = F.least(F.length(n), F.length(q))
    fit = F.when(n == q, F.lit(100)).when(n.startswith(query) | q.startswith(n), 50 + short).when(F.contains(n, q) | F.contains(q, n), 20 + short)
    grow = lambda c, most: F.least(F.lit(float(most)), F.log10(1 + F.coalesce(c.cast("double"), F.lit(0.0))))
    return F.when(n != "", fit + grow(area, 5) + grow(population, 3))


def keyword_tier(text: Column, tiers: Sequence[tuple[str, int]], rest: int) -> Column:
    out = F.lit(rest)
    for pattern, level in reversed(list(tiers)):
        out = F.when(fold(text).rlike(pattern), level).otherwise(out)
    return out


def richness(summary: Column, cap: int) -> Column:
    """A hundredth a character, up to ``cap``."""
    return F.least(F.length(F.coalesce(summary, F.lit(""))), F.lit(cap * 100)) / 100


def area_bands(area: Column, bands: Sequence[tuple[float, float, float]], unknown: float = 0, rest: float = 0) -> Column:
    """Points of the first band (least, below, points) that holds an area."""
    out = F.lit(float(rest))
    for lo, hi, points in reversed(list(bands)):
        out = F.when((area >= lo) & (area < hi), float(points)).otherwise(out)
    return F.when(area.isNull(), float(unknown)).otherwise(out)


def best_and_more(best: Column, n: Column, each: float, cap: int) -> Column:
    """The best item, and ``each`` for every further one up to ``cap``."""
    return F.coalesce(best, F.lit(0.0)) + each * F.least(F.greatest(n - 1, F.lit(0)), F.lit(cap))


def interest_share(slug: Column, raw: Column) -> Column:
    top = F.lit(CEILING)
    for name, value in CEILINGS.items():
        top = F.when(slug == name, value).otherwise(top)
    return F.least(F.greatest(raw, F.lit(0.0)), top) / top * 18


def atlas_score(area: Column, shares: Column, subject_picture: Column, has_image: Column) -> Column:
    """The strongest share and a little of the second, pictures, and a malus for mainlands. shares: array."""
    ranked = F.sort_array(shares, False)
    at = lambda i: F.coalesce(F.get(ranked, F.lit(i)), F.lit(0.0))
    return F.when(area > 8000, -50.0).otherwise(0.0) + at(0) + 0.08 * at(1) + F.when(subject_picture, 3.0).when(~has_image, -3.0).otherwise(0.0)


def second_source(first: Column, other: Column) -> Column:
    """Confidence in an area by a second source, with unit slips told by the ratio: hectares, square metres, acres."""
    r = F.try_divide(first, other)
    gap = F.abs(first - other) / F.greatest(first, other)
    return (
        F.when(first.isNull(), "n/a").when(other.isNull() | (other <= 0), "medium").when(gap <= 0.1, "high")
        .when(r.between(70, 150) | r.between(1 / 150, 1 / 70), "unit: hectares").when(r.between(1e5, 1e7) | r.between(1e-7, 1e-5), "unit: square metres").when(r.between(200, 400) | r.between(1 / 400, 1 / 200), "unit: acres")
        .when(gap <= 0.3, "medium").otherwise("low")
    )


def highest_point(peak: Column, other: Column, current: Column) -> Column:
    """struct(metres, source, confidence): a surveyed peak, high within 5 m or 5 % of a second source or without one, else an estimate; then the second source as an estimate, then what is there."""
    gap = F.abs(peak - other)
    near = (gap <= 5) | (gap / F.greatest(peak, F.lit(1.0)) <= 0.05)
    apart = other.isNotNull() & (peak > 0) & ~near
    return F.struct(
        F.coalesce(peak, other, current).alias("metres"), F.when(peak.isNotNull(), "peak").when(other.isNotNull(), "second").when(current.isNotNull(), "current").alias("source"),
        F.when(peak.isNotNull(), F.when(apart, "estimate").otherwise("high")).when(other.isNotNull(), "estimate").when(current.isNotNull(), "high").otherwise("n/a").alias("confidence"),
    )


def staged_name_score(confidence: Column, tier: Column, dual: Column, metres: Column) -> Column:
    base = F.when(confidence == "high", 90).when(confidence == "medium-high", 80).when(confidence == "medium", 70).when(confidence == "low", 50).otherwise(60)
    return base + F.when(tier == "A", 5).when(tier == "D", -40).otherwise(0) + F.when(dual, 10).otherwise(0) + F.when(metres <= 50, 5).when(metres > 300, -15).otherwise(0)


# Base confidence of a picture by its source, in the atlas and when staged
PHOTO_BASE = {"wikidata": 95, "wikidata-p18": 95, "wikipedia": 90, "osm-wikipedia": 90, "osm-image-tag": 92, "osm-commons-file": 92, "osm-commons-category": 85, "commons-text-search": 88, "commons-geosearch": 70, "curated": 98, "geograph": 90, "commons-category": 85}
STAGED_BASE = {
    "inaturalist-obs": 82, "openverse": 80, "commons-regional-category": 85, "commons-archipelago-category": 88, "commons-depicts-q": 92, "wikidata-depicts": 92, "wellcome-collection": 78, "ogl-tourism": 85, "geograph-native": 94, "wikipedia-embedded": 90,
    "flickr-statutory": 88, "commons-county-category": 88, "wikidata-nearby-p18": 82, "geograph-via-commons": 90, "flickr-commons": 85, "europeana": 80, "web-discovery": 75, "kartaview": 80, "panoramax": 80,
}
CATEGORY_SOURCES, NO_NAME_IN_CATEGORY = ("osm-commons-category", "commons-category"), 15
STAGED_CATEGORIES = ("commons-regional-category", "commons-archipelago-category", "commons-category", "ogl-tourism")


def _base(source: Column, table: dict[str, int]) -> Column:
    out = F.lit(None).cast("int")
    for k, v in table.items():
        out = F.when(source == k, v).otherwise(out)
    return out


def photo_confidence(source: Column, named: Column, metres: Column, geo_ok: Column, flagged: Column) -> Column:
    """struct(confidence, suspect) of a lead picture by its source: a base, with other figures where a name or a place is missing; legacy fields 50, unknown sources 45."""
    base, far = _base(source, PHOTO_BASE), ~F.coalesce(metres <= 500, F.lit(False))
    category, by_text, near = source.isin(*CATEGORY_SOURCES), source == "commons-text-search", source == "commons-geosearch"
    good_text = named & F.coalesce(geo_ok, F.lit(False))
    score = F.when(source == "legacy-image-field", 50).when(base.isNull(), 45).when(category & ~named, base - NO_NAME_IN_CATEGORY).when(by_text, F.when(good_text, 88).otherwise(60)).when(near, F.when(flagged, 75).when(named & ~far, 85).otherwise(70)).otherwise(base)
    doubt = (source == "legacy-image-field") | base.isNull() | flagged | (category & ~named) | (by_text & ~good_text) | (near & ~flagged & (~named | far))
    return F.struct(score.alias("confidence"), doubt.alias("suspect"))


def staged_photo_confidence(source: Column, named: Column, metres: Column, categorised: Column, depicted: Column, percent: Column) -> Column:
    """Confidence in a staged picture: observations by distance, categories by name and category, depictions by what was verified; null for sources that are not staged ones."""
    base = _base(source, STAGED_BASE)
    seen = F.when(metres <= 5000, 96).when(metres.isNotNull(), 70).otherwise(75)
    category = F.when(named & categorised, 92).when(named, 85).otherwise(70)
    depicts = F.when(source == "wikidata-depicts", F.when(depicted, F.coalesce(percent, F.lit(92))).otherwise(65)).otherwise(F.when(depicted & (percent >= 90), percent).otherwise(65))
    return (
        F.when(source == "inaturalist-obs", seen).when(source == "openverse", F.when(named, base).otherwise(55)).when(source == "wellcome-collection", F.when(named, base).otherwise(50))
        .when(source.isin(*STAGED_CATEGORIES), category).when(source.isin("commons-depicts-q", "wikidata-depicts"), depicts).otherwise(base).cast("int")
    )


def gallery_score(in_file: Column, in_caption: Column, in_categories: Column, badge: Column, width: Column, credited: Column, captioned: Column, refused: Column) -> Column:
    """A gallery picture: where the name stands, badges, resolution, credit and caption; -200 without a name, or if refused."""
    plus = lambda t, p: F.when(t, p).otherwise(0)
    score = 50 + plus(in_file, 25) + plus(in_caption, 15) + plus(in_categories, 10) + F.when(badge == "Featured", 60).when(badge == "Quality", 35).when(badge == "Valued", 20).otherwise(0)
    score = score + F.when(width >= 2800, 25).when(width >= 1600, 15).when((width > 0) & (width < 1024), -25).otherwise(0) + plus(credited, 5) + plus(captioned, 5)
    return F.when(refused | ~(in_file | in_caption | in_categories), -200).otherwise(score)


def featured_score(curated: Column, source: Column, described: Column, photo: Column, ferry: Column, area: Column, entity: Column, kind: Column) -> Column:
    plus = lambda t, p: F.when(t, float(p)).otherwise(0.0)
    return plus(curated, 1000) + plus(source == "curated", 400) + plus(described, 250) + plus(photo, 200) + plus(ferry, 120) + F.coalesce(F.least(F.lit(80.0), area * 0.05), F.lit(0.0)) + plus(F.trim(entity).rlike(r"^Q\d+$"), 30) + plus(kind == "sea", 15)


def name_confidence(confidence: Column, source: Column, entity: Column, map_type: Column, map_id: Column, name: Column) -> Column:
    """How sure a name is: unconfirmed, high, medium, low or none."""
    known = F.trim(F.coalesce(name, F.lit(""))) != ""
    return F.when(F.lower(confidence) == "unconfirmed", "unconfirmed").when(source == "curated", "high").when(entity.isNotNull() & (entity != ""), F.when(F.lower(confidence) == "high", "high").otherwise("medium")).when(map_type.isNotNull() & map_id.isNotNull() & known, "medium").when(known, "low").otherwise("none")


# Points of the three quality scores
MERGE_POINTS = {"curated": 100, "osm": 50, "osm-inland": 40, "wikidata": 30}


def record_quality(kind: str, source: Column, area: Column, population: Column, entity: Column, article: Column, photo: Column, map_type: Column) -> Column:
    """How rich a record is. discovery and merge: curated first, then fields (merge: other sources too); tagged: by the map object's type and fields."""
    has = lambda c: c.isNotNull() & (c != "")
    sized = area.isNotNull() & (area != 0)
    if kind == "tagged":
        tests = [(map_type == "relation", 3), (map_type == "way", 2), (map_type == "node", 1), (sized, 5), (has(article), 3), (photo, 2), (population.isNotNull(), 1)]
    else:
        sources = MERGE_POINTS if kind == "merge" else {"curated": MERGE_POINTS["curated"]}
        tests = [*((source == k, v) for k, v in sources.items()), (sized, 5), (population.isNotNull(), 3), (has(entity), 3), (has(article), 3), (photo, 2)]
    return quality(tests).cast("int")


def notability(area: Column, population: Column, article: Column, photo: Column, map_type: Column, place_kind: Column) -> Column:
    """What is kept when a list is cut: size and people on log scales, links, pictures and the kind of map object."""
    log = lambda c, f: F.when(c > 0, F.log10(c.cast("double") + 1) * f).otherwise(0.0)
    return log(area, 10) + log(population, 4) + quality([(article.isNotNull() & (article != ""), 8), (photo, 3), (map_type == "relation", 4), (map_type == "way", 2), (place_kind == "island", 3)])


def quality(tests: Sequence[tuple[Column, float]]) -> Column:
    """The sum of the points whose test holds."""
    return sum((F.when(t, F.lit(float(p))).otherwise(F.lit(0.0)) for t, p in tests), F.lit(0.0))
