"""Bringing rows into the atlas: gated updates, names, duplicates of imports, scores, audits (survey A-18, A-21, A-24, M-12 to M-19, X-21)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import name_key
from .graph import first_come
from .joins import first_of, nearest, within_km
from .tables import durable


def site_update(candidates: DataFrame, places: DataFrame, rocks: DataFrame, include_uncertain: bool = False, near_km: float = 0.5) -> DataFrame:
    """(candidate, outcome, place): what becomes of each candidate, by the first rule that holds.

    An inland rock is skipped. A match (same map object, same entity, same key
    within 1 km, or any place within ``near_km`` if no review is needed) is merged,
    or kept for review if it is curated. Without one, what needs review waits
    unless ``include_uncertain``. The rest are taken in order of their ids: one is
    a duplicate if one that was added before has its key and lies within
    ``near_km``, and else is added. candidates: candidate, name,
    lat, lng, map_type, map_id, entity, review; places: place, name, lat, lng,
    map_type, map_id, entity, source; rocks: candidate.
    """
    skipped = candidates.join(rocks.select("candidate"), "candidate", "left_semi").select("candidate", F.lit("inland rock").alias("outcome"), F.lit(None).cast(dict(places.dtypes)["place"]).alias("place"))
    # names are keyed once; tables as long as the candidates are merged, not broadcast, which their estimated sizes would allow
    rest = durable(candidates.join(rocks.select("candidate"), "candidate", "left_anti").withColumn("_k", name_key(F.col("name"))).drop("name"), "candidates").hint("merge")
    p = durable(places.withColumn("_pk", name_key(F.col("name"))).drop("name"), "keyed-places").hint("merge")
    by = lambda hit, tier: hit.select("candidate", "place", F.lit(tier).alias("_n"), F.lit(0.0).alias("_d") if "km" not in hit.columns else F.col("km").alias("_d"))
    objects = by(rest.filter("map_type is not null").join(p.select("map_type", "map_id", "place"), ["map_type", "map_id"]), 0)
    entities = by(rest.filter("entity is not null").join(p.select("entity", "place"), "entity"), 1)
    close = within_km(rest.select("candidate", "review", "_k", "lat", "lng"), p.select("place", "_pk", "lat", "lng"), max(1.0, near_km))
    named = by(close.filter((F.col("_k") == F.col("_pk")) & (F.col("_k") != "") & (F.col("km") <= 1)), 2)
    loose = by(close.filter(~F.col("review") & (F.col("km") <= near_km)), 3)
    match = durable(objects.unionByName(entities).unionByName(named).unionByName(loose).groupBy("candidate").agg(F.min(F.struct("_n", "_d", "place"))["place"].alias("place")), "matches")
    matched = match.hint("merge").join(places.select("place", "source"), "place").select("candidate", F.when(F.col("source") == "curated", "curated match").otherwise("merged").alias("outcome"), "place")
    new = rest.join(match.select("candidate").hint("merge"), "candidate", "left_anti")
    wait = F.lit(False) if include_uncertain else F.coalesce(F.col("review"), F.lit(False))
    waiting = new.filter(wait)
    open_ = durable(new.filter(~wait).select("candidate", "review", "_k", "lat", "lng"), "open-candidates")
    twins = within_km(open_.select("candidate", "_k", "lat", "lng"), open_.select(F.col("candidate").alias("_other"), F.col("_k").alias("_ck"), "lat", "lng"), near_km)
    clashes = twins.filter((F.col("_other") < F.col("candidate")) & (F.col("_k") == F.col("_ck"))).select(F.col("candidate").alias("u"), F.col("_other").alias("v"))
    later = first_come(clashes).select(F.col("node").alias("candidate"), F.lit(True).alias("_later"))
    none = F.lit(None).cast(dict(places.dtypes)["place"]).alias("place")
    added = open_.join(later, "candidate", "left").select("candidate", F.when(F.col("_later"), "duplicate").when(F.col("review"), "added unconfirmed").otherwise("added").alias("outcome"), none)
    return skipped.unionByName(matched).unionByName(waiting.select("candidate", F.lit("needs review").alias("outcome"), none)).unionByName(added)


def named_places(places: DataFrame, proposals: DataFrame, score: str = "score") -> DataFrame:
    """Places with the best proposed name, if theirs is unknown and they are not curated; an empty name is none. places: id, name, name_status, source, tags (array); proposals: id, proposed, score, ord."""
    best = first_of(proposals.filter(F.trim(F.coalesce("proposed", F.lit(""))) != ""), ["id"], [F.col(score).desc(), F.col("ord")]).select("id", F.trim("proposed").alias("_new"))
    j = places.join(best, "id", "left")
    use = F.col("_new").isNotNull() & (F.col("name_status") == "unknown") & ~F.coalesce(F.col("source") == "curated", F.lit(False))
    tags = F.array_union(F.array_except(F.coalesce("tags", F.array().cast("array<string>")), F.array(F.lit("unnamed"), F.lit("needs-name"))), F.array(F.lit("named-via-staging")))
    use = F.coalesce(use, F.lit(False))
    return j.withColumns({"tags": F.when(use, tags).otherwise(F.col("tags")), "name": F.when(use, F.col("_new")).otherwise(F.col("name")), "name_status": F.when(~use, F.col("name_status"))}).drop("_new")


def import_duplicates(imported: DataFrame, places: DataFrame, max_km: float = 30.0) -> DataFrame:
    """(imported, place, km): the nearest place of the same key within ``max_km`` of an imported row. imported: imported, key, lat, lng; places: place, key, lat, lng."""
    return nearest(imported, places, "imported", "place", max_km, ["key"])


def backfilled(places: DataFrame, objects: DataFrame) -> DataFrame:
    """Places without a map object take that of their entity, if it has just one. places: id, entity, map_type, map_id; objects: entity, map_type, map_id."""
    sole = objects.groupBy("entity").agg(F.count("*").alias("_n"), F.min("map_type").alias("_t"), F.min("map_id").alias("_i")).filter("_n = 1").drop("_n")
    j = places.join(sole, "entity", "left")
    need = F.col("map_type").isNull() | F.col("map_id").isNull()
    return j.withColumns({"map_type": F.when(need, F.coalesce("_t", "map_type")).otherwise(F.col("map_type")), "map_id": F.when(need, F.coalesce("_i", "map_id")).otherwise(F.col("map_id"))}).drop("_t", "_i").select(*places.columns)


def registry_pass(old: DataFrame, now: DataFrame, key: str, at: Column) -> DataFrame:
    """(key, first_seen, last_seen, listings): what is listed now, first seen when it was, last seen at ``at``; what is gone leaves."""
    seen = now.groupBy(key).agg(F.count("*").alias("listings"))
    return seen.join(old.select(key, "first_seen"), key, "left").select(key, F.coalesce("first_seen", at).alias("first_seen"), at.alias("last_seen"), "listings")


def score_problems(scores: DataFrame, prompts: DataFrame, hosts: Sequence[str]) -> DataFrame:
    """(id, problem) of imported scores that can't be taken, one row a breach: duplicate or unknown ids, another text, a state or mark that is none, marks without an answer, and addresses that are missing, foreign or not asked for. scores: id, prompt, status, cited, correct (text, as they came), url; prompts: id, prompt."""
    twice = scores.groupBy("id").agg(F.count("*").alias("_n"))
    j = scores.join(twice, "id").join(prompts.select("id", F.col("prompt").alias("_p"), F.lit(True).alias("_known")), "id", "left")
    c = F.col
    mark = lambda k: c(k).isNull() | c(k).isin("true", "false")
    scored = c("cited").isNotNull() | c("correct").isNotNull()
    status = F.coalesce(c("status"), F.when(scored, "completed").otherwise("unrun"))
    cited, url = F.coalesce(c("cited") == "true", F.lit(False)), F.trim(F.coalesce(c("url"), F.lit("")))
    home = url.rlike("^https?://(?:" + "|".join(h.replace(".", "[.]") for h in hosts) + r")(?:[/?#]\S*)?$")
    rules = (
        ("duplicate id", c("_n") > 1), ("unknown id", c("_known").isNull()), ("text differs", c("prompt").isNotNull() & (c("prompt") != c("_p"))), ("mark is no boolean", ~(mark("cited") & mark("correct"))), ("unknown status", ~status.isin("completed", "failed", "unrun")),
        ("scored without an answer", status.isin("failed", "unrun") & scored), ("citation without an address", cited & (url == "")), ("foreign address", cited & (url != "") & ~home), ("address without a citation", ~cited & (url != "")),
    )
    return j.select("id", F.explode(F.array_compact(F.array(*(F.when(test, F.lit(n)) for n, test in rules)))).alias("problem")).distinct()


def protected_changes(old: DataFrame, new: DataFrame, key: str, free: Sequence[str]) -> DataFrame:
    """(key, column) of columns that differ though only ``free`` ones may be changed by their owner."""
    names = [c for c in old.columns if c != key and c not in free]
    j = old.alias("o").join(new.alias("n"), key)
    return j.select(key, F.explode(F.array_compact(F.array(*(F.when(~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")), F.lit(c)) for c in names)))).alias("column"))


def ledger(rows: DataFrame, outstanding: DataFrame, confidence: Column) -> DataFrame:
    """(part, n): rows by how sure their name is, and how many candidates are outstanding."""
    by = rows.groupBy(confidence.alias("part")).agg(F.count("*").alias("n"))
    return by.unionByName(outstanding.agg(F.count("*").alias("n")).select(F.lit("outstanding").alias("part"), "n"))


def headline(df: DataFrame, tests: Mapping[str, Column]) -> DataFrame:
    """(stat, n): all rows, and those for which each test holds, in one pass."""
    one = df.agg(F.count("*").alias("all"), *(F.count(F.when(t, 1)).alias(k) for k, t in tests.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("stat"), F.col(k).alias("n")) for k in ("all", *tests)))).alias("s")).select("s.*")


def moderation(rows: DataFrame, user: str, status: str) -> DataFrame:
    """(user, contributed, accepted, rejected)."""
    n = lambda v: F.count(F.when(F.col(status) == v, 1))
    return rows.groupBy(user).agg(F.count("*").alias("contributed"), n("accepted").alias("accepted"), n("rejected").alias("rejected"))


def collection_members(places: DataFrame, collections: DataFrame) -> DataFrame:
    """(collection, id): places whose archipelago or water holds a collection's words. collections: collection, archipelago, parent.

    Texts meet words over their runs of that many letters, so that the join is an equi-join.
    """
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    words = collections.select("collection", F.explode(F.array(F.struct(F.lit("a").alias("_f"), low("archipelago").alias("_w")), F.struct(F.lit("p").alias("_f"), low("parent").alias("_w")))).alias("w")).select("collection", "w.*").filter("_w <> ''")
    sizes = sorted(r[0] for r in words.select(F.length("_w")).distinct().collect())
    texts = places.select("id", F.explode(F.array(F.struct(F.lit("a").alias("_f"), low("archipelago").alias("_t")), F.struct(F.lit("p").alias("_f"), low("water").alias("_t")))).alias("t")).select("id", "t.*").filter("_t <> ''")
    starts = lambda k: F.when(F.length("_t") >= k, F.sequence(F.lit(1), F.length("_t") - k + 1)).otherwise(F.array().cast("array<int>"))
    runs_of = lambda k: F.transform(starts(k), lambda i: F.substring(F.col("_t"), i, F.lit(k)))
    runs = [runs_of(k) for k in sizes] or [F.array().cast("array<string>")]
    return texts.withColumn("_w", F.explode(F.array_distinct(F.concat(*runs)))).join(words, ["_f", "_w"]).select("collection", "id").distinct()
