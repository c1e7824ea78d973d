"""Counts, rollups, buckets, agreement and timetables (survey A-01 to A-25)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def groups_and_other(df: DataFrame, key: Column, most: int = 12, blank: str = "unrecorded") -> DataFrame:
    """(grp, n): the ``most`` largest groups, and the rest as ``other`` if it has rows. Equal counts stand in the order of their names."""
    counts = df.groupBy(F.coalesce(key, F.lit(blank)).alias("grp")).agg(F.count("*").alias("n"))
    ranked = counts.withColumn("_r", F.row_number().over(Window.orderBy(F.desc("n"), "grp")))
    return ranked.groupBy(F.when(F.col("_r") <= most, F.col("grp")).otherwise("other").alias("grp")).agg(F.sum("n").alias("n"))


def rate(part: Column, whole: Column, digits: int = 4) -> Column:
    """part / whole, null for a whole of 0."""
    return F.bround(F.try_divide(part, whole), digits)


def kpi_rollup(df: DataFrame, keys: Sequence[str], done: Column, cited: Column, correct: Column, canonical: Column) -> DataFrame:
    """Completed rows and rates whose denominators leave out what was not scored; nothing scored: null, not 0."""
    n = lambda c: F.count(F.when(c, 1))
    citation, accuracy = done & cited.isNotNull(), done & correct.isNotNull()
    scored = lambda c, base: F.when(n(base) > 0, n(base & c))
    return df.groupBy(*keys).agg(
        n(done).alias("completed"), n(citation).alias("citation_scored"), n(accuracy).alias("accuracy_scored"),
        scored(cited, citation).alias("cited"), rate(n(citation & cited), n(citation)).alias("citation_rate"),
        rate(n(accuracy & correct), n(accuracy)).alias("accuracy_rate"), rate(n(citation & cited & canonical), n(citation & cited)).alias("canonical_share"),
    )


def completeness(parts: Sequence[tuple[str, Column, int]]) -> tuple[Column, Column]:
    """The summed weight of what is there, and the names of what is not. parts: (name, whether it is there, weight)."""
    score, gaps = F.lit(0), []
    for name, there, weight in parts:
        ok = F.coalesce(there, F.lit(False))
        score = score + F.when(ok, weight).otherwise(0)
        gaps.append(F.when(~ok, F.lit(name)))
    return score, F.array_compact(F.array(*gaps))


def buckets(value: Column, edges: Sequence[tuple[float, str]], rest: str) -> Column:
    """The label of the first edge that a value reaches. edges: (least, label), highest first."""
    out = F.lit(rest)
    for least, label in reversed(list(edges)):
        out = F.when(value >= least, F.lit(label)).otherwise(out)
    return out


def agreement(df: DataFrame, keys: Sequence[str], source: str, distance: str, confidence: str, extra: str, least: int = 2, spread: float = 200.0) -> DataFrame:
    """Keys on which ``least`` sources agree within ``spread``: sources joined, the least distance, and the template's extra column.

    The template is the row of the highest confidence (high, medium-high,
    medium, other), the nearest of equals; a missing distance counts as 0.
    """
    level = F.when(F.col(confidence) == "high", 4).when(F.col(confidence) == "medium-high", 3).when(F.col(confidence) == "medium", 2).otherwise(1)
    first = F.min(F.struct((-level).alias("l"), F.coalesce(distance, F.lit(0.0)).alias("d"), F.col(source), F.col(extra).alias("x")))
    out = df.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(source)), "|").alias("sources"), F.countDistinct(source).alias("n_sources"), F.min(distance).alias("distance"), F.max(distance).alias("_far"), first.alias("_t"))
    return out.filter((F.col("n_sources") >= least) & F.coalesce(F.col("_far") - F.col("distance") <= spread, F.lit(True))).select(*keys, "sources", "n_sources", "distance", F.col("_t.x").alias(extra))


def timetable(stops: DataFrame) -> DataFrame:
    """Weekly departures by route and first and last stop.

    stops: route, trip, seq (int), stop, minutes (of day), weekday (text). Trips
    of one stop are left out; the mean duration is modulo a day.
    """
    trips = stops.groupBy("route", "trip", "weekday").agg(F.min(F.struct("seq", "stop", "minutes")).alias("a"), F.max(F.struct("seq", "stop", "minutes")).alias("b"), F.count("*").alias("n")).filter("n > 1")
    day = 24 * 60
    flat = trips.select("route", "weekday", F.col("a.stop").alias("origin"), F.col("b.stop").alias("destination"), F.col("a.minutes").alias("dep"), F.pmod(F.col("b.minutes") - F.col("a.minutes"), F.lit(day)).alias("took"))
    times = F.array_join(F.transform(F.array_sort(F.collect_set("dep")), lambda m: F.format_string("%02d:%02d", F.floor(m / 60), F.pmod(m, F.lit(60)))), " ")
    return flat.groupBy("route", "origin", "destination", "weekday").agg(times.alias("departures"), F.bround(F.avg("took"), 0).cast("int").alias("minutes"))


def ordered_distinct(df: DataFrame, keys: Sequence[str], order: str, value: str, name: str) -> DataFrame:
    """The distinct values of a group in the order in which they are first seen."""
    seen = F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value])
    return df.groupBy(*keys).agg(F.array_distinct(seen).alias(name))


def transitions(df: DataFrame, before: Column, after: Column) -> DataFrame:
    return df.groupBy(before.alias("before"), after.alias("after")).agg(F.count("*").alias("n"))


def consensus(df: DataFrame, keys: Sequence[str], value: str, order: str, least: int) -> DataFrame:
    """The commonest value of a group if it has ``least`` votes; of equals the first seen."""
    votes = df.groupBy(*keys, value).agg(F.count("*").alias("votes"), F.min(order).alias("_o"))
    return votes.groupBy(*keys).agg(F.min(F.struct((-F.col("votes")).alias("v"), "_o", value)).alias("m")).select(*keys, f"m.{value}", (-F.col("m.v")).alias("votes")).filter(F.col("votes") >= least)


def worst(df: DataFrame, keys: Sequence[str], value: str, good: str = "high", bad: str = "medium") -> DataFrame:
    return df.groupBy(*keys).agg(F.when(F.bool_and(F.col(value) == good), good).otherwise(bad).alias(value))


def within_budget(df: DataFrame, group: str, order: str, size: str, most: int) -> DataFrame:
    """Rows of a group in order, with the running sum of their sizes, as long as it stays within ``most``. Of rows that take something no more than ``most`` can matter, so a hot group is cut before it is shuffled."""
    w = Window.partitionBy(group).orderBy(order)
    some = df.filter(F.col(size) > 0).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most).drop("_r")
    every = some.unionByName(df.filter(F.col(size) == 0))
    return every.withColumn("running", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("running") <= most)


def facet_counts(df: DataFrame, guide: str, facet: str, source: str) -> DataFrame:
    """(guide, facet, n, sources): rows and distinct sources of each facet of a guide."""
    return df.groupBy(guide, F.coalesce(facet, F.lit("")).alias(facet)).agg(F.count("*").alias("n"), F.countDistinct(source).alias("sources"))


def grouping_sets(df: DataFrame, a: str, b: str, value: str) -> DataFrame:
    """(a, b, level, n, total): counts and sums by both columns, each alone, and over all."""
    return df.cube(a, b).agg(F.grouping_id(a, b).alias("level"), F.count("*").alias("n"), F.sum(value).alias("total"))


def quantiles(df: DataFrame, key: str, value: str, shares: Sequence[float]) -> DataFrame:
    """(key, share, value): exact quantiles with interpolation."""
    q = df.groupBy(key).agg(F.percentile(value, F.array(*map(F.lit, shares))).alias("_q"))
    return q.select(key, F.posexplode("_q").alias("_i", value)).withColumn("share", F.element_at(F.array(*map(F.lit, shares)), F.col("_i") + 1)).drop("_i")


def height_range(cells: DataFrame, key: str) -> DataFrame:
    """(key, low, high, cells) of the raster cells inside a shape's mask. cells: key, x, y, metres, outers, inners."""
    from ..functions.geo import in_polygon

    inside = cells.filter(in_polygon(F.col("x"), F.col("y"), F.col("outers"), F.col("inners")))
    return inside.groupBy(key).agg(F.min("metres").alias("low"), F.max("metres").alias("high"), F.count("*").alias("cells"))
