"""Facet filters, gates with a first reason, and constraint checks (survey F-01 to F-36)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import haversine_km
from ..functions.sentences import FEATURES
from ..functions.text import fold, search_norm


@dataclass
class Facets:
    """A conjunction over place records; what is None does not constrain. ``id_sets``: DataFrames with column id, each a semi-join."""

    nation: str | None = None
    type: str | None = None
    subtype: str | None = None
    archipelago: str | None = None
    water: str | None = None
    min_area: float | None = None
    max_area: float | None = None
    min_elevation: float | None = None
    inhabited: bool | None = None
    remote: bool = False
    strict_remote: bool = False
    for_sale: bool = False
    has_photo: bool | None = None
    has_story: bool = False
    bounds: tuple[float, float, float, float] | None = None
    near: tuple[float, float, float] | None = None
    hide_unconfirmed: bool = False
    with_unnamed: bool = False
    id_sets: list[DataFrame] = field(default_factory=list)

    def constrained(self) -> bool:
        """Whether anything constrains; a search without is refused."""
        plain = (v for k, v in vars(self).items() if k not in ("id_sets", "with_unnamed", "inhabited"))
        return bool(self.id_sets) or self.inhabited is not None or any(v is not None and v is not False for v in plain)

    def check(self, nations: Sequence[str], types: Sequence[str], box=(48.0, -12.0, 62.5, 3.0)) -> None:
        """Raise for unknown values and points outside the atlas."""
        if self.nation is not None and self.nation not in nations:
            raise ValueError(f"unknown nation {self.nation!r}; one of {', '.join(nations)}")
        if self.type is not None and self.type not in types:
            raise ValueError(f"unknown type {self.type!r}; one of {', '.join(types)}")
        if self.near and not (box[0] <= self.near[0] <= box[2] and box[1] <= self.near[1] <= box[3]):
            raise ValueError("the point is outside the atlas")

    def apply(self, df: DataFrame) -> DataFrame:
        has = set(df.columns)
        c = F.col
        tests: list[Column] = []
        for name in ("nation", "type"):
            if getattr(self, name) is not None:
                tests.append(c(name) == getattr(self, name))
        if self.subtype is not None:
            tests.append(fold(c("subtype")) == fold(F.lit(self.subtype)))
        for name in ("archipelago", "water"):
            if getattr(self, name) is not None:
                tests.append(F.contains(fold(c(name)), fold(F.lit(getattr(self, name)))))
        if self.min_area is not None:
            tests.append(F.coalesce(c("area"), F.lit(0.0)) >= self.min_area)
        if self.max_area is not None:
            tests.append((c("area") > 0) & (c("area") <= self.max_area))
        if self.min_elevation is not None:
            tests.append(c("elevation") >= self.min_elevation)
        if self.inhabited is True:
            tests.append(c("population") > 0)
        if self.inhabited is False:
            tests.append(F.coalesce(c("population"), F.lit(0)) <= 0)
        if self.remote:
            lonely = (c("type") == "sea") & ~c("ferry")
            # as coded a recorded 0 passes without the other tests; strict: none of them is spared
            tests.append((F.coalesce(c("population"), F.lit(0)) <= 0) & lonely if self.strict_remote else (c("population") == 0) | (c("population").isNull() & lonely))
        if self.for_sale:
            tests.append(c("for_sale"))
        if self.has_photo is not None:
            tests.append(F.coalesce(c("has_photo"), F.lit(False)) == self.has_photo)
        if self.has_story:
            tests.append(F.trim(F.coalesce(c("description"), F.lit(""))) != "")
        if self.bounds:
            s, w, n, e = self.bounds
            tests.append(c("lat").between(s, n) & c("lng").between(w, e))
        if self.near:
            lat, lng, km = self.near
            tests.append(haversine_km(F.lit(lat), F.lit(lng), c("lat"), c("lng")) <= min(250.0, max(1.0, km)))
        if self.hide_unconfirmed:
            tests.append(~c("confidence").eqNullSafe("unconfirmed"))
        if not self.with_unnamed and "unnamed" in has:
            tests.append(~F.coalesce(c("unnamed"), F.lit(False)))
        for t in tests:
            df = df.filter(t)
        for ids in self.id_sets:
            df = df.join(ids.select("id").distinct(), "id", "left_semi")
        return df


def first_reason(rules: Sequence[tuple[str, Column]], ok: str | None = None) -> Column:
    """The name of the first rule that is broken (null counts as not broken), else ``ok``."""
    out = F.lit(ok)
    for name, broken in reversed(list(rules)):
        out = F.when(broken, F.lit(name)).otherwise(out)
    return out


def violations(df: DataFrame, id_col: str, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """(id, rule) for each rule that a row breaks, in one pass; a null test is no breach, as in SQL's CHECK."""
    broken = F.array_compact(F.array(*(F.when(~test, F.lit(name)) for name, test in rules)))
    return df.select(F.col(id_col), F.explode(broken).alias("rule"))


def generic_name(c: Column) -> Column:
    """Names that say little: two words that end in island or isle, or one short word."""
    n = search_norm(c)
    return n.rlike(r"^\S+ (?:island|isle)$") | ((F.length(n) <= 8) & ~F.contains(n, F.lit(" ")))


def dual_signal(named: Column, km: Column, generic: Column, far: float = 15, near: float = 5) -> Column:
    """Both a name and a place: within 15 km, or 5 for generic names."""
    return named & F.coalesce(km <= F.when(generic, near).otherwise(far), F.lit(False))


def visible(rows: DataFrame, published: DataFrame, key: str) -> DataFrame:
    """Accepted rows, not deleted, of published parents: a view for the public."""
    return rows.filter((F.col("status") == "accepted") & F.col("deleted_at").isNull()).join(published.filter("published").select(key), key, "left_semi")


def told(c=F.col) -> Column:
    """Whether something is written about a place: a description, or any section."""
    filled = lambda k: F.trim(F.coalesce(c(k), F.lit(""))) != ""
    return filled("description") | filled("history")


def elevation_known(elevation: Column, confidence: Column) -> Column:
    """A height, or a confidence other than n/a."""
    return (elevation.isNotNull() & ~F.isnan(elevation.cast("double"))) | (confidence.isNotNull() & (confidence != "n/a"))


#: Features that a place has by a list of its own, besides words for it.
LISTED = {"mountain": "hills", "lighthouse": "lighthouses", "wildlife": "colonies", "bridge": "causeways", "causeway": "causeways", "walkable": "causeways"}


def has_feature(feature: str, haystack: Column, c=F.col, columns: Sequence[str] = (), words: Mapping[str, Sequence[str]] = FEATURES) -> Column:
    """Whether a place has a feature: by its own field where it has one, else by a list of such things (where ``columns`` names its column), or a whole word for it in its text."""
    from ..functions.text import search_norm

    # the text is folded once, and has a space before and behind each word
    told_ = F.concat(F.lit(" "), search_norm(haystack), F.lit(" "))
    said = F.exists(F.array(*(search_norm(F.lit(w)) for w in words.get(feature, (feature,)) if len(w) >= 3)), lambda w: F.contains(told_, F.concat(F.lit(" "), w, F.lit(" "))))
    if LISTED.get(feature) in columns:
        said = said | F.coalesce(F.size(c(LISTED[feature])) > 0, F.lit(False))
    plain = {
        "inhabited": F.coalesce(c("population") > 0, F.lit(False)), "uninhabited": F.coalesce(c("population"), F.lit(0)) == 0,
        "tidal": c("subtype").eqNullSafe("tidal") | F.coalesce(c("tidal"), F.lit(False)), "photo": F.coalesce(c("has_photo"), F.lit(False)), "forsale": F.coalesce(c("for_sale"), F.lit(False)), "ferry": F.coalesce(c("ferry"), F.lit(False)),
        "mountain": F.coalesce(c("elevation") >= 500, F.lit(False)) | said,
    }
    return plain.get(feature, said)


def in_remit(lat: Column, lng: Column, box: tuple[float, float, float, float], nations) -> Column:
    """Inside the whole box and in one of the nations' boxes."""
    from ..functions.geo import first_box, in_box

    return in_box(lat, lng, box) & first_box(lat, lng, nations).isNotNull()


def coordinate_audit(df: DataFrame, id_col: str, box: tuple[float, float, float, float]) -> DataFrame:
    """(id, problem): missing (or NaN), outside the box, or a collision: another row stands at the same place to five digits."""
    from pyspark.sql import Window

    s, w, n, e = box
    bad = F.col("lat").isNull() | F.col("lng").isNull() | F.isnan("lat") | F.isnan("lng")
    judged = df.select(id_col, "lat", "lng", F.when(bad, "missing").when(~(F.col("lat").between(s, n) & F.col("lng").between(w, e)), "outside").alias("problem"))
    good = judged.filter("problem is null").withColumns({"_a": F.round("lat", 5), "_b": F.round("lng", 5)})
    shared = good.groupBy("_a", "_b").agg(F.count("*").alias("n")).filter("n > 1")
    crowd = good.join(shared, ["_a", "_b"], "left_semi").select(id_col, F.lit("collision").alias("problem"))
    return judged.filter("problem is not null").select(id_col, "problem").unionByName(crowd)


def too_broad(parts: dict) -> bool:
    """Whether a question would list nearly everything: no words, features, places, sizes or sort, and two scopes (nation, type, subtype) at most."""
    narrow = ("recommend", "sort", "near", "water", "ferry", "features", "tags", "words", "min_area", "max_area", "photo", "elevation", "curated", "archipelago")
    return not any(parts.get(k) for k in narrow) and sum(bool(parts.get(k)) for k in ("nation", "type", "subtype")) <= 2


def widened(scope: DataFrame, everything: DataFrame, also: Column, id_col: str = "id") -> DataFrame:
    """A scope with the rows that a chip adds to it from the whole table; each row once."""
    return scope.unionByName(everything.filter(also).join(scope.select(id_col), id_col, "left_anti"))


def contribution_problem(kind: Column, name: Column, note: Column, proposed: Column, photos: Column, source: Column) -> Column:
    """Why a contribution can't be taken, else null: nothing said, or a link that is none."""
    empty = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    silent = empty(name) & empty(note) & empty(photos)
    link = F.trim(F.coalesce(source, F.lit("")))
    whole = F.when(F.lower(link).startswith("www."), F.concat(F.lit("https://"), link)).otherwise(link)
    broken = link.rlike(r"(?i)^(?:https?://|www\.)") & ~whole.rlike(r"(?i)^https?://[^\s/?#:@]+")
    return F.when((kind == "fix_atlas") & silent & empty(proposed), "say what should change").when((kind != "fix_atlas") & silent, "add a name or a sentence").when(broken, "not a link")


def sitemap_eligible(curated: Column, featured: Column, unnamed: Column, described: Column) -> Column:
    return curated | featured | (~unnamed & described)


def accepted(rows: DataFrame, denied: DataFrame, overrides: DataFrame, dropped: DataFrame, order: str) -> DataFrame:
    """Accepted rows without denied claims and dropped places, with reviewed summaries, once a natural key (slug, place, facet or blank, title), the first in order. denied: slug, place, title; overrides: these and summary; dropped: place."""
    from .joins import first_of

    claim = ["slug", "place", "title"]
    kept = rows.filter((F.col("status") == "accepted") & F.col("place").isNotNull()).join(dropped.select("place"), "place", "left_anti").join(denied.select(*claim), claim, "left_anti")
    told_ = kept.join(overrides.select(*claim, F.col("summary").alias("_s")), claim, "left").withColumn("summary", F.coalesce("_s", "summary")).drop("_s")
    return first_of(told_.withColumn("_f", F.coalesce("facet", F.lit(""))), ["slug", "place", "_f", "title"], [F.col(order)]).drop("_f").select(*rows.columns)


def inland_rocks(points: DataFrame, land: DataFrame, point_id: str, least_m: float = 2000) -> DataFrame:
    """Ids of rocks that lie on land, further than ``least_m`` from its edge. land: polygon, outers, inners."""
    from ..functions.geo import in_polygon, ring_distance_m
    from .joins import polygon_cells

    cells, at = polygon_cells(land, "polygon")
    p = points.filter(F.lower("kind") == "rock").withColumns(at)
    hit = p.join(cells, ["_x", "_y"]).filter(in_polygon(F.col("lng"), F.col("lat"), F.col("outers"), F.col("inners")))
    edge = F.array_min(F.transform(F.concat("outers", F.coalesce("inners", F.array())), lambda r: ring_distance_m(F.col("lat"), F.col("lng"), r)))
    return hit.filter(edge > least_m).select(point_id).distinct()
