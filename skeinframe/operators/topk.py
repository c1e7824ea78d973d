"""Ranking, capping and best-per-key selection (survey W-01 to W-26)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import first_of
from .tables import durable, release


def top(df: DataFrame, order: Sequence[Column], most: int) -> DataFrame:
    return df.orderBy(*order).limit(most)


def unique_names(df: DataFrame, name: str, order: Sequence[Column], most: int) -> DataFrame:
    """The first ``most`` rows in order, one a name (trimmed, in lower case); blank names are never taken for each other."""
    key = F.lower(F.trim(F.coalesce(F.col(name), F.lit(""))))
    ranked = df.withColumn("_k", key).withColumn("_n", F.row_number().over(Window.partitionBy("_k").orderBy(*order)))
    return ranked.filter((F.col("_n") == 1) | (F.col("_k") == "")).drop("_k", "_n").orderBy(*order).limit(most)


def per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], most: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= most)


def relevance_cutoff(df: DataFrame, score: str, order: Sequence[Column], floor: float, share: float, gap: float, most: int) -> DataFrame:
    """Rows in order that reach max(floor, share * the first row's score), ``most`` at most; the walk ends at the first of them, after one is kept, that is more than ``gap`` below the first row.

    Only the first row and the first ``most`` that reach the floor are ranked, both as distributed top-k.
    """
    s = F.col(score)
    lead = df.orderBy(*order).limit(1).select(s).first()
    if lead is None or lead[0] is None:
        return df.limit(0)
    top_ = float(lead[0])
    head = df.filter(s >= max(float(floor), top_ * share)).orderBy(*order).limit(most)
    w = Window.orderBy(*order)  # over at most ``most`` rows
    marked = head.withColumn("_far", (F.row_number().over(w) > 1) & (F.lit(top_) - s > gap))
    return marked.withColumn("_stop", F.max("_far").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter(~F.col("_stop")).orderBy(*order).drop("_far", "_stop")


def keeper(df: DataFrame, keys: Sequence[str], tests: Sequence[Column], id_col: str) -> DataFrame:
    """One row a group: the lexicographic best of ``tests``, the largest id of equals."""
    return first_of(df, keys, [*(t.desc() for t in tests), F.col(id_col).desc()])


def first_last_seen(old: DataFrame, now: DataFrame, key: str, at: str) -> DataFrame:
    """(key, first_seen, last_seen): carried forward from ``old``, widened by what is seen ``now``."""
    both = old.select(key, "first_seen", "last_seen").unionByName(now.select(key, F.col(at).alias("first_seen"), F.col(at).alias("last_seen")))
    return both.groupBy(key).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def diverse(df: DataFrame, category: str, series: str, order: Sequence[Column], most: int) -> DataFrame:
    """Picks in three passes: the best of each category, one a series; then the best of the series not taken; then the rest."""
    lead = first_of(first_of(df, [category], order), [series], order).withColumn("_pass", F.lit(1))
    ids = lead.select(series).distinct()
    fresh = first_of(df.join(ids, series, "left_anti"), [series], order).withColumn("_pass", F.lit(2))
    taken = lead.unionByName(fresh)
    rest = df.join(taken.select(*df.columns), list(df.columns), "left_anti").withColumn("_pass", F.lit(3))
    return taken.unionByName(rest).orderBy("_pass", *order).limit(most).drop("_pass")


def unique_slugs(df: DataFrame, place: str, slug: str, more: Sequence[str], id_col: str, most: int = 90) -> DataFrame:
    """A path for each row, unique in its place: the slug itself for the first id, else the first free of slug-with-``more``, else a number.

    Rows whose slug nobody shares never leave the JVM; only colliding slugs, a
    place at a time, go through the greedy chain.
    """
    import pandas as pd

    shared = F.count("*").over(Window.partitionBy(place, slug)) > 1
    marked = df.withColumn("_shared", shared)
    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + ", path string"

    def chain(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values([slug, id_col])
        used: set[str] = set()
        paths = []
        for r in group.to_dict("records"):
            options = [r[slug], *(f"{r[slug]}-{r[m]}"[:most] for m in more if r[m]), f"{r[slug]}-{r[id_col]}"[:most]]
            n = 2
            while (pick := next((o for o in options if o not in used), None)) is None:
                options, n = [f"{r[slug]}-{n}"], n + 1
            used.add(pick)
            paths.append(pick)
        return group.drop(columns="_shared").assign(path=paths)

    alone = marked.filter(~F.col("_shared")).drop("_shared").withColumn("path", F.col(slug))
    return alone.unionByName(marked.filter("_shared").groupBy(place).applyInPandas(chain, schema))


def at_position(df: DataFrame, order: str, position: Callable[[int], int]) -> DataFrame:
    """The row at a position in the order of a column without repeats; ``position`` gets the number of rows. No rows: none.

    Only the column is sorted, in ranges; a count for each range comes to the driver,
    which tells the range and the place in it. Nulls come first and count too.
    """
    ranged = df.select(order).repartitionByRange(F.col(order).asc_nulls_first()).sortWithinPartitions(F.col(order).asc_nulls_first())
    # a task's rows are numbered on from the task's number times 2 ** 33
    keys = durable(ranged.withColumn("_at", F.monotonically_increasing_id()), "order")
    counts = sorted((r["p"], r["n"]) for r in keys.groupBy(F.shiftright("_at", 33).alias("p")).agg(F.count("*").alias("n")).collect())
    rows = sum(n for _, n in counts)
    if not rows:
        release(keys)
        return df.limit(0)
    left = min(rows - 1, max(0, int(position(rows))))
    for part, n in counts:
        if left < n:
            break
        left -= n
    value = keys.filter(F.col("_at") == (part << 33) + left).first()[order]
    release(keys)
    return df.filter(F.col(order).eqNullSafe(F.lit(value))).limit(1)


def weekly_pick(df: DataFrame, epoch_seconds: Column, order: str) -> DataFrame:
    """The row whose turn it is: rows in order, the week's number modulo their count."""
    week = df.sparkSession.range(1).select(F.floor(epoch_seconds / 604_800)).first()[0]
    return at_position(df, order, lambda n: week % n)


def random_pick(df: DataFrame, excluded: DataFrame, id_col: str, last: object, u: float, order: str) -> DataFrame:
    """A row by a number in [0, 1), of those that are not excluded; if all are, of those that are not the last one."""
    open_ = df.join(excluded.select(id_col), id_col, "left_anti")
    pool = open_ if open_.limit(1).count() else df.filter(F.col(id_col) != F.lit(last))
    return at_position(pool, order, lambda n: int(u * n))


def best_per_place(df: DataFrame, name: str, quality: Column, order: str) -> DataFrame:
    """One row a folded-case name and place to two digits: the best; of equals the first."""
    keyed = df.withColumns({"_n": F.lower(name), "_a": F.round("lat", 2), "_b": F.round("lng", 2)})
    return first_of(keyed, ["_n", "_a", "_b"], [quality.desc(), F.col(order)]).drop("_n", "_a", "_b")


def featured(df: DataFrame, curated: DataFrame, id_col: str, name: str, score: str, most: int) -> DataFrame:
    """Curated rows in their order, then the others by score and name; one a name, ``most`` at most. curated: id, ord."""
    j = df.join(curated.select(id_col, "ord"), id_col, "left").withColumn("_g", F.col("ord").isNull())
    order = [F.col("_g"), F.col("ord"), F.col(score).desc(), F.lower(F.coalesce(name, F.lit(""))), F.col(id_col)]
    return unique_names(j, name, order, most).withColumn("tier", F.when(F.col("_g"), "atlas").otherwise("curated")).drop("_g", "ord")


def topic_picks(df: DataFrame, id_col: str, most: int) -> DataFrame:
    """Pictured rows first, then by height, area and name; one an id."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    order = [F.col("has_photo").desc(), blank("elevation").desc(), blank("area").desc(), F.lower(F.coalesce("name", F.lit(""))), F.col(id_col)]
    return first_of(df, [id_col], order).orderBy(*order).limit(most)


def home_picks(df: DataFrame, name: str, own: Column, cited: Column, has_photo: Column, order: Sequence[Column], most: int = 3) -> DataFrame:
    """Rows in order with a picture to show: their own, else what is cited of a place that has none; one a name, unnamed ones never."""
    thumb = F.coalesce(F.nullif(own, F.lit("")), F.when(~has_photo, F.nullif(cited, F.lit(""))))
    shown = df.withColumn("thumb", thumb).filter(F.col("thumb").isNotNull() & (F.trim(F.coalesce(F.col(name), F.lit(""))) != ""))
    return unique_names(shown, name, order, most)


def newest(df: DataFrame, at: str, id_col: str, most: int | None = None) -> DataFrame:
    """Rows by falling time, of equals the larger id first."""
    out = df.orderBy(F.col(at).desc(), F.col(id_col).desc())
    return out.limit(most) if most else out


def related(df: DataFrame, group: str, id_col: str, order: Sequence[Column], most: int) -> DataFrame:
    """(id, other) of the best other rows of a group for each row; each row meets only the group's first ``most`` + 1."""
    best = per_group(df.select(group, id_col, *[c for c in df.columns if c not in (group, id_col)]), [group], order, most + 1, "_r").select(group, F.col(id_col).alias("other"), "_r")
    pairs = df.select(group, id_col).join(best, group).filter(F.col(id_col) != F.col("other"))
    return per_group(pairs, [id_col], [F.col("_r")], most, "rank").select(id_col, "other", "rank")
