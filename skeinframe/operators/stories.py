"""Cited stories of places: packs, keys, duplicates, references, relations (survey A-13, U-04, W-26, X-07 to X-16, Q-13, Q-14, Q-17)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold, search_norm
from .joins import first_of


def story_packs(items: DataFrame, order: str) -> DataFrame:
    """(slug, place, n, titles): each place's stories of an interest, one a title, in order."""
    once = first_of(items.filter("place is not null"), ["slug", "place", "title"], [F.col(order)])
    return once.groupBy("slug", "place").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "title"))), lambda x: x["title"]), "|").alias("titles"))


def natural_keys(items: DataFrame, order: str) -> DataFrame:
    """One row a (slug, place, facet or blank, title): the first in order."""
    return first_of(items.withColumn("_f", F.coalesce("facet", F.lit(""))), ["slug", "place", "_f", "title"], [F.col(order)]).drop("_f")


def stories_of(items: DataFrame, place: Column | None = None, slug: str | None = None, facet: str | None = None) -> DataFrame:
    """Stories, of a collection and a facet if these are given. A distillery's subdivision counts only for working ones."""
    out = items if place is None else items.filter(place)
    if slug is not None:
        out = out.filter(F.col("slug") == slug)
    if facet is not None:
        want, by_facet = fold(F.lit(facet)), fold(F.col("facet")) == fold(F.lit(facet))
        by_division = fold(F.col("subdivision")) == want
        working = (F.col("slug") != "whisky-distilleries") | F.coalesce(F.col("facet") == "distillery", F.lit(False))
        divided = (F.col("slug") != "film-art-music") & by_division & working
        out = out.filter(by_facet | divided)
    return out


def interest_groups(items: DataFrame, most: int = 3) -> DataFrame:
    """(place, slug, n, first): how many stories of each interest a place has, and the titles of the first few."""
    g = items.groupBy("place", "slug").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("item", "title"))).alias("_t"))
    return g.select("place", "slug", "n", F.array_join(F.transform(F.slice("_t", 1, most), lambda x: x["title"]), "|").alias("first"))


def safe_url(c: Column) -> Column:
    """A web address without a user and password; empty for anything else."""
    u = F.trim(F.coalesce(c, F.lit("")))
    return F.when(u.rlike(r"(?i)^https?://[^\s/?#@]+(?:[/?#]\S*)?$"), u).otherwise("")


def references(cited: DataFrame, key: str, order: Sequence[str], most: int = 8) -> DataFrame:
    """(key, url, label, place): safe addresses of each key in order, each once, at most so many. cited: key, url, label and the order."""
    from .topk import per_group

    safe = cited.withColumn("url", safe_url(F.col("url"))).filter("url <> ''")
    return per_group(first_of(safe, [key, "url"], [F.col(c) for c in order]), [key], [F.col(c) for c in order], most, "at").select(key, "url", "label", "at")


def answer_references(answers: DataFrame, refs: DataFrame, background: DataFrame, key: str) -> DataFrame:
    """(key, url, how): references whose address stands in the answer; where none does, those that are background of what was read. answers: key, text; refs: key, url; background: key, url."""
    j = refs.join(answers, key)
    cited = j.filter(F.contains(F.col("text"), F.col("url"))).select(key, "url", F.lit("cited").alias("how"))
    rest = refs.join(cited.select(key).distinct(), key, "left_anti")
    return cited.unionByName(rest.join(background.select(key, "url").distinct(), [key, "url"], "left_semi").select(key, "url", F.lit("background").alias("how")))


# What a work has to do with a place, by words of the property that links them
RELATIONS = (("depict", "It depicts {}."), ("main subject", "The work takes {} as its subject."), ("named after", "It is named after {}."), ("filming", "It was filmed on {}."), ("narrative", "It is set on {}."), ("creation", "It was created on {}."), ("formation", "It was formed on {}."), ("birth", "The artist was born on {}."), ("work location", "The artist worked on {}."))


def relation_clause(properties: Column, place: Column) -> Column:
    """A sentence on what links a work and a place."""
    say = lambda text: F.concat(F.lit(text.split("{}")[0]), place, F.lit(text.split("{}")[1]))
    out = say("It is connected with {}.")
    for word, text in reversed(RELATIONS):
        out = F.when(F.contains(F.lower(properties), F.lit(word)), say(text)).otherwise(out)
    return out


def region_of(place: Column, name: Column, rules: Sequence[tuple[Sequence[str], Sequence[str], str]], rest: str) -> Column:
    """The region of the first rule whose ids hold the place, or one of whose words stands in its name. rules: (ids, words, region)."""
    n, out = fold(name), F.lit(rest)
    for ids, words, region in reversed(list(rules)):
        test = place.isin(*ids) if ids else F.lit(False)
        for w in words:
            test = test | F.contains(n, F.lit(w))
        out = F.when(test, F.lit(region)).otherwise(out)
    return out


# Words that set something on the place whose name follows, with what may stand between, and words that follow its name
LOCATED = r" (?:on|in|at|from|of|off|to|after|across|around|throughout|held|played|celebrated|observed|originated) (?:the )?(?:isle of |island of )?@ | (?:and|or) @ | @ (?:island|isle|islanders) |^ @ is "


def located(sentence: Column, alias: Column) -> Column:
    """Whether a sentence sets something on a place: a preposition or a list before its name, island or islanders after it, or its name and 'is' at the start."""
    x = search_norm(alias)
    marked = F.replace(F.concat(F.lit(" "), search_norm(sentence), F.lit(" ")), F.concat(F.lit(" "), x, F.lit(" ")), F.lit(" @ "))
    return (x != "") & marked.rlike(LOCATED)


def best_sentence(body: Column, alias: Column, most: int = 520) -> Column:
    """The first sentence that sets something on a place, with the next one if both are short; null if none does."""
    sentences = F.filter(F.transform(F.split(F.coalesce(body, F.lit("")), r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")
    at = F.array_position(F.transform(sentences, lambda s: located(s, alias)), True).cast("int")
    one, two = F.get(sentences, at - 1), F.get(sentences, at)
    return F.when(at > 0, F.when(two.isNotNull() & (F.length(one) + F.length(two) + 1 < most), F.concat_ws(" ", one, two)).otherwise(one))


def without_repeats(items: DataFrame, place: str = "place", most: int = 3) -> DataFrame:
    """Stories of a place without repeats: of one folded title the longest summary, then no Latin title that another story's text holds, then the best ``most`` by reason, living before extinct, and length. items: place, item, title, summary, latin (whether the title is a Latin name), reason (points)."""
    told = F.length(F.coalesce("summary", F.lit("")))
    once = first_of(items.withColumn("_k", fold(F.col("title"))), [place, "_k"], [told.desc(), F.col("item")])
    # a Latin title meets the texts of its place over its two words
    words = lambda c: F.split(search_norm(c), " ")
    plain = once.filter("not latin").select(place, words(F.concat_ws(" ", "title", "summary")).alias("_w"))
    pairs = plain.select(place, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size("_w") - 1, F.lit(1))), lambda i: F.array_join(F.slice("_w", i, 2), " ")))).alias("_g")).distinct()
    latin = once.filter("latin").withColumn("_g", F.array_join(F.slice(words(F.col("title")), 1, 2), " ")).join(pairs, [place, "_g"], "left_anti").drop("_g")
    left = once.filter("not latin").unionByName(latin).drop("_k")
    from .topk import per_group

    extinct = F.coalesce(F.col("summary").rlike(r"(?i)\bextinct\b"), F.lit(False))
    return per_group(left, [place], [F.col("reason").desc(), extinct, told.desc(), F.col("item")], most, "rank")


def resolved_aliases(hits: DataFrame, item: str) -> DataFrame:
    """(item, place) of the best alias: its length, and 100 if it or the name stands in the title; a tie goes to the place that was asked for, else to none. hits: item, place, alias, in_title, asked (the place of the query)."""
    points = F.length("alias") + F.when(F.col("in_title"), 100).otherwise(0)
    best = hits.groupBy(item, "place").agg(F.max(points).alias("p"), F.max(F.col("asked").eqNullSafe(F.col("place"))).alias("own"))
    top = best.groupBy(item).agg(F.max("p").alias("_top"))
    tied = best.join(top, item).filter(F.col("p") == F.col("_top")).groupBy(item).agg(F.count("*").alias("n"), F.min("place").alias("only"), F.max(F.when(F.col("own"), F.col("place"))).alias("own"))
    return tied.select(item, F.when(F.col("n") == 1, F.col("only")).otherwise(F.col("own")).alias("place")).filter("place is not null")


def point_in_place(hits: DataFrame, item: str, deep: float = 0.45) -> DataFrame:
    """(item, place, how) of a point within some places: the only one that its title names, else the nearest that its text confirms, else the only one if the point is deep inside. hits: item, place, km, radius_km, titled, confirmed."""
    g = hits.groupBy(item).agg(
        F.count("*").alias("n"), F.count(F.when(F.col("titled"), 1)).alias("n_titled"), F.min(F.when(F.col("titled"), F.col("place"))).alias("titled"),
        F.min(F.when(F.col("confirmed"), F.struct("km", "place"))).alias("confirmed"), F.min(F.struct("km", "place", "radius_km")).alias("near"),
    )
    inside = (F.col("n") == 1) & (F.col("near.km") <= deep * F.col("near.radius_km"))
    how = F.when(F.col("n_titled") == 1, "titled").when(F.col("confirmed").isNotNull(), "confirmed").when(inside, "inside")
    place = F.when(how == "titled", F.col("titled")).when(how == "confirmed", F.col("confirmed.place")).otherwise(F.col("near.place"))
    return g.select(item, place.alias("place"), how.alias("how")).filter("how is not null")


def lead_of(articles: DataFrame, tried: DataFrame, key: str, most: int = 600) -> DataFrame:
    """(key, description): the first paragraph of an article's plain text, without footnote marks, cut at a sentence; keys that were tried and given up before are left out. articles: key, text; tried: key."""
    lead = F.trim(F.regexp_replace(F.substring_index(F.trim("text"), "\n", 1), r"\[\d+\]", ""))
    cut = F.when(F.length(lead) <= most, lead).otherwise(F.regexp_extract(F.substring(lead, 1, most), r"(?s)^(.*[.!?])", 1))
    return articles.join(tried.select(key), key, "left_anti").select(key, cut.alias("description")).filter("description <> ''")
