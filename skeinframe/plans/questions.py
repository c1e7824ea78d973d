"""Questions in plain words as plans: a rule-based parser on the driver, one DataFrame plan behind it (survey Q-01 to Q-17)."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import agg, graph, joins, scores, topk
from ..operators.filters import Facets
from .registry import query

# What a question may sort by, and the words for it
SORTS = {"largest": ("area", True), "biggest": ("area", True), "smallest": ("area", False), "tiniest": ("area", False), "highest": ("elevation", True), "tallest": ("elevation", True), "lowest": ("elevation", False), "most populated": ("population", True), "most populous": ("population", True), "least populated": ("population", False), "northernmost": ("lat", True), "southernmost": ("lat", False), "easternmost": ("lng", True), "westernmost": ("lng", False)}
TYPES = {"sea": ("sea", "coastal", "offshore"), "lake": ("lake", "loch", "lough", "llyn"), "river": ("river", "eyot", "ait")}
STOP = frozenset("a an and are any at by did do does far for from give has have how i in is island islands isle isles it its list many me most near of on or out per show than that the there these this to total what where which who with within".split())


def folded(value: str) -> str:
    bare = "".join(c for c in unicodedata.normalize("NFKD", value or "") if not unicodedata.combining(c))
    return re.sub(r"[^a-z0-9. ]+", " ", bare.lower()).strip()


@dataclass
class Question:
    """What a sentence asks for. intent: search, count, total, superlative, compare or lookup."""

    intent: str = "search"
    facets: Facets = field(default_factory=Facets)
    sort: str | None = None
    descending: bool = True
    limit: int = 8
    measure: str | None = None
    names: tuple[str, ...] = ()
    group_by: str | None = None
    near: str | None = None
    tokens: tuple[str, ...] = ()


def parse(sentence: str, nations: Sequence[str], places: dict[str, tuple[float, float]] | None = None) -> Question:
    """Facets are taken out of the sentence, the longest names first; what is left are search words."""
    s = f" {folded(sentence)} "
    q = Question()

    def take(pattern: str):
        nonlocal s
        m = re.search(pattern, s)
        if m:
            s = f"{s[: m.start()]} {s[m.end() :]}"
        return m

    if m := re.search(r" (?:compare )?(.+?) (?:vs\.?|versus|compared (?:to|with)) (.+?) $", s) or re.search(r" compare (.+?) (?:and|with|to) (.+?) $", s):
        q.intent, q.names = "compare", tuple(re.sub(r"^(?:the |isle of |island of )", "", x.strip()) for x in m.groups())
        return q
    if m := take(r" (?:top|best|give me|show me) (\d+) "):
        q.limit = min(12, max(1, int(m[1])))
    if take(r" how many | number of | count (?:of )?"):
        q.intent = "count"
    if m := take(r" (?:total|combined) (area|population) | how (?:much|many) (area|people) "):
        q.intent, q.measure = "total", {"people": "population"}.get(m[1] or m[2], m[1] or m[2])
    if m := take(r" (?:by|per|in each) (nation|type|archipelago|water) "):
        q.group_by = m[1]
    for words in sorted(SORTS, key=len, reverse=True):
        if take(rf" {words} "):
            q.sort, q.descending = SORTS[words]
            q.intent = "superlative" if q.intent == "search" else q.intent
            break
    for n in sorted(nations, key=len, reverse=True):
        if take(rf" {re.escape(folded(n))} "):
            q.facets.nation = n
            break
    for kind, words in TYPES.items():
        if take(rf" (?:{'|'.join(words)})s? "):
            q.facets.type = kind
            break
    if take(r" uninhabited "):
        q.facets.inhabited = False
    elif take(r" inhabited "):
        q.facets.inhabited = True
    if take(r" with (?:a |an )?(?:photos?|pictures?|images?) "):
        q.facets.has_photo = True
    if m := take(r" (?:over|larger than|bigger than|at least|more than) ([\d.]+) ?(?:km2|sq km|square kilometres) "):
        q.facets.min_area = float(m[1])
    if m := take(r" (?:under|smaller than|less than|at most) ([\d.]+) ?(?:km2|sq km|square kilometres) "):
        q.facets.max_area = float(m[1])
    if m := take(r" (?:higher than|above|over) (\d+) ?m(?:etres)? "):
        q.facets.min_elevation = float(m[1])
    if m := take(r" (?:within (\d+) ?km of|near|close to) ([a-z][a-z ]*?) $"):
        q.near = m[2].strip()
        known = {folded(k): v for k, v in (places or {}).items()}
        if q.near in known:
            q.facets.near = (*known[q.near], float(m[1] or 40))
    q.tokens = tuple(dict.fromkeys(t for t in s.split() if t not in STOP and len(t) > 1))
    if q.intent == "search" and re.match(r" (?:what|where|tell me|who) ", s) and q.tokens and not q.facets.constrained():
        q.intent, q.names = "lookup", (" ".join(q.tokens),)
    return q


def search(places: DataFrame, facets: Facets, tokens: Sequence[str], sort: str | None = None, descending: bool = True, limit: int = 8) -> DataFrame:
    """The tool's search: a constraint is asked for, words must each be in some field, the best come first."""
    if not facets.constrained() and not tokens:
        raise ValueError("a search needs a constraint or a word")
    hits = facets.apply(places)
    folds = [text.fold(F.col(c)) if c in places.columns else F.lit("") for c in ("name", "water", "archipelago", "summit", "description")]
    photo = F.coalesce(F.col("has_photo"), F.lit(False)) if "has_photo" in places.columns else F.lit(False)
    score = scores.token_score(*folds, list(tokens)) if tokens else scores.size_score(F.col("area"), photo)
    hits = hits.withColumn("score", score.cast("double")).filter("score is not null")
    by = F.coalesce(F.col(sort).cast("double"), F.lit(0.0)) if sort else F.col("score")
    order = [by.desc() if descending else by.asc(), F.coalesce(F.col("area"), F.lit(0.0)).desc(), F.col("id")]
    return topk.top(hits, order, min(12, max(1, limit)))


def count(places: DataFrame, facets: Facets, by: str | None = None) -> DataFrame:
    """(grp, n): all, or by a column; without a constraint by nation."""
    hits = facets.apply(places)
    by = by if by in ("nation", "type", "archipelago", "water") else None
    if by is None and not facets.constrained():
        by = "nation"
    return agg.groups_and_other(hits, F.col(by)) if by else hits.agg(F.count("*").alias("n")).select(F.lit("all").alias("grp"), "n")


def total(places: DataFrame, facets: Facets, measure: str) -> DataFrame:
    good = F.when(F.col(measure) > 0, F.col(measure))
    return facets.apply(places).agg(F.sum(good).alias("total"), F.count(good).alias("n"))


def superlative(places: DataFrame, facets: Facets, by: str, descending: bool, limit: int = 5) -> DataFrame:
    known = facets.apply(places).filter(F.col(by).isNotNull() & ((F.col(by) > 0) if by in ("area", "population", "elevation") else F.lit(True)))
    return topk.top(known, [F.col(by).desc() if descending else F.col(by).asc(), F.col("id")], limit)


def lookup(places: DataFrame, name: str) -> DataFrame:
    """The place that a name means best; without one a misspelt name by edit distance, larger places first. Both kinds are ranked in one pass."""
    n = folded(name)
    most = 2 if len(n) >= 8 else 1
    spelt = places.withColumns({"_bare": scores.bare_name(F.col("name")), "_norm": text.search_norm(F.col("name"))})
    spelt = spelt.withColumns({"_fit": scores.bare_name_score(F.col("_bare"), n, F.col("area"), F.col("population")), "_edits": text.banded_distance(F.col("_norm"), F.lit(n), most)})
    close = F.when(F.col("_edits") <= most, -F.col("_edits").cast("double"))
    rated = spelt.withColumns({"score": F.coalesce("_fit", close), "_second": F.col("_fit").isNull()})
    # what fits nothing comes last, and is looked at in the one row that is left: a filter before would be folded into the scan with all of the above
    best = topk.top(rated, [F.col("_second"), F.desc("score"), F.when(F.col("_second"), F.coalesce("area", F.lit(0.0))).desc(), F.col("id")], 1)
    return best.filter("score is not null").drop("_second", "_bare", "_norm", "_fit", "_edits")


def compare(places: DataFrame, names: Sequence[str], measure: str = "area") -> DataFrame:
    a, b = (lookup(places, n).select(F.col("name").alias(x), F.col(measure).cast("double").alias(f"{x}_value")) for n, x in zip(names, ("a", "b")))
    return a.join(b, F.lit(True)).withColumn("ratio", F.round(F.try_divide(F.greatest("a_value", "b_value"), F.least("a_value", "b_value")), 2))


def answer(places: DataFrame, sentence: str, nations: Sequence[str], known: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    q = parse(sentence, nations, known)
    if q.intent == "compare":
        return compare(places, q.names)
    if q.intent == "lookup":
        return lookup(places, q.names[0])
    if q.intent == "count":
        return count(places, q.facets, q.group_by)
    if q.intent == "total":
        return total(places, q.facets, q.measure)
    if q.intent == "superlative":
        return superlative(places, q.facets, q.sort, q.descending, q.limit if q.limit != 8 else 5)
    return search(places, q.facets, q.tokens, q.sort, q.descending, q.limit)


def collections(memberships: DataFrame) -> DataFrame:
    """(category, places, entries) of accepted memberships."""
    return memberships.filter("status = 'accepted'").groupBy("category").agg(F.countDistinct("place").alias("places"), F.count("*").alias("entries"))


def trip(routes: DataFrame, places: DataFrame, start: str, end: str) -> DataFrame:
    """The quickest way between the places that two names mean; no row without one."""
    a, b = lookup(places, start).first(), lookup(places, end).first()
    if a is None or b is None:
        return graph.shortest_paths(graph.undirected(routes), "").limit(0)
    return graph.shortest_paths(graph.undirected(routes), a["id"]).filter(F.col("node") == b["id"])


def _places(t) -> DataFrame:
    n = joins.small(t("nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation")))
    kind = F.when(F.col("c_custkey") % 3 == 0, "sea").when(F.col("c_custkey") % 3 == 1, "lake").otherwise("river")
    c: Column = F.col("c_acctbal")
    return t("customer").join(n, "c_nationkey").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), "nation", kind.alias("type"), c.alias("area"), (F.col("c_custkey") % 5).alias("population"), F.col("c_mktsegment").alias("description"))


_NATIONS = [f"NATION_{i}" for i in range(25)]
_P = "(SELECT c_custkey AS id, c_name AS name, n_name AS nation, CASE c_custkey % 3 WHEN 0 THEN 'sea' WHEN 1 THEN 'lake' ELSE 'river' END AS type, c_acctbal AS area, c_custkey % 5 AS population, c_mktsegment AS description FROM customer JOIN nation ON c_nationkey = n_nationkey) p"


@query(f"SELECT 'all' AS grp, count(*) AS n FROM {_P} WHERE nation = 'NATION_3' AND type = 'lake' AND coalesce(population, 0) <= 0")
def question_count(t):
    places = _places(t).withColumn("nation", F.replace("nation", F.lit("_"), F.lit(" ")))
    return answer(places, "How many uninhabited lake islands are there in nation 3?", [n.replace("_", " ") for n in _NATIONS])


@query(f"SELECT id, name, area FROM {_P} WHERE type = 'sea' AND area > 0 ORDER BY area DESC, id LIMIT 3")
def question_superlative(t):
    return answer(_places(t), "Give me 3 largest sea islands", _NATIONS).select("id", "name", "area")


@query(f"SELECT round(sum(area) FILTER (WHERE area > 0), 2) AS total, count(*) FILTER (WHERE area > 0) AS n FROM {_P} WHERE type = 'river' AND population > 0")
def question_total(t):
    got = answer(_places(t), "What is the total area of inhabited river islands?", _NATIONS)
    return got.select(F.round("total", 2).alias("total"), "n")


@query(f"SELECT nation AS grp, count(*) AS n FROM {_P} GROUP BY nation HAVING nation IN (SELECT nation FROM {_P} GROUP BY nation ORDER BY count(*) DESC, nation LIMIT 12) UNION ALL SELECT 'other', CAST(sum(c) AS BIGINT) FROM (SELECT count(*) AS c, row_number() OVER (ORDER BY count(*) DESC, nation) AS rk FROM {_P} GROUP BY nation) q WHERE rk > 12")
def question_groups(t):
    return answer(_places(t), "How many islands are there by nation", _NATIONS)


@query(f"SELECT id, nation, CAST(1 + 6 + 2 AS DOUBLE) AS score FROM {_P} WHERE type = 'lake' AND contains(lower(description), 'building') ORDER BY area DESC, id LIMIT 8")
def question_search(t):
    return answer(_places(t), "lake islands with building", _NATIONS).select("id", "nation", "score")
