"""Joins by keys, tiers, cells, polygons and names (survey J-01 to J-28).

Distance joins go over cells: one side is put in its cell, the other into the
cells around, so Spark sees an equi-join; hot cells are left to AQE's skew join.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import KM_A_DEGREE, haversine_km
from .tables import durable

BROADCAST_ROWS = 200_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is checked to have at most ``rows`` rows; else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def first_of(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row a key: the first in ``order``."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


#: Ids in one list at most, so a pair of lists makes LISTED * LISTED rows at a time.
LISTED = 128
#: Rows of a key in one part of its lists, about.
PARTED = 1024


def listed(df: DataFrame, key: str, id_col: str, name: str) -> DataFrame:
    """(key, name): the ids of each key in lists of up to LISTED; a null id is one too."""
    block = F.floor((F.row_number().over(Window.partitionBy(key).orderBy(id_col)) - 1) / LISTED)
    nulls = F.array_repeat(F.lit(None).cast(dict(df.dtypes)[id_col]), (F.count("*") - F.count(id_col)).cast("int"))
    return df.select(key, id_col, block.alias("_b")).groupBy(key, "_b").agg(F.concat(F.collect_list(id_col), nulls).alias(name)).drop("_b")


def parts(df: DataFrame, n: Column) -> Column:
    """Parts of a key that ``n`` rows have; there are never more than two for each core, as what looks for the key is sent to all of them."""
    return F.least(F.ceil(n / PARTED), F.lit(2 * df.sparkSession.sparkContext.defaultParallelism))


def meet_parts(left: DataFrame, right: DataFrame, key: str, n: str) -> DataFrame:
    """Rows of equal ``key``, of which the right has ``n``: left rows go to all parts of the key, right rows lie in one, ``part``."""
    every = left.withColumn("part", F.explode(F.sequence(F.lit(0), (parts(left, F.col(n)) - 1).cast("int")))).drop(n)
    # a few keys make many rows: they are dealt to all tasks, and never left to the one that a small table fits in
    return every.repartition(8 * left.sparkSession.sparkContext.defaultParallelism, key, "part").hint("merge").join(right, [key, "part"])


def exploded(met: DataFrame, left: tuple[str, str], right: tuple[str, str], *more: str) -> DataFrame:
    """All rows of pairs of lists; left and right: the list's name and that of its ids."""
    (many, one), (most, other) = left, right
    return met.select(F.explode(many).alias(one), most, *more).select(one, F.explode(most).alias(other), *more)


def same_key(left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str) -> DataFrame:
    """(left_id, right_id) of all rows of a key; ids are distinct within it. Lists of ids meet, so few keys with many rows on both sides are shuffled as lists and made rows of where they meet."""
    counts = right.groupBy(key).agg(F.count("*").alias("_n"))
    part = F.pmod(F.xxhash64(key, F.col("_right")[0]), parts(right, F.col("_n"))).cast("int")
    b = listed(right, key, right_id, "_right").join(counts, key).select(key, part.alias("part"), "_right")
    return exploded(meet_parts(listed(left, key, left_id, "_left").join(counts, key), b, key, "_n"), ("_left", left_id), ("_right", right_id))


class Within(NamedTuple):
    """A condition of a tier: the left and the right number differ by ``most`` at most."""

    left: Column
    right: Column
    most: float


#: Parts into which the width of a Within is cut at least.
PARTS = 512


def _first_within(left: DataFrame, right: DataFrame, left_id: str, near: Within, first: Column) -> DataFrame:
    """(left_id, _b): the first right row of the same _k and a near number.

    Right rows lie in parts of the number line, and parts in spans of 2, 4 and so on,
    each with its first row. What is near for certain is covered by some spans, twenty or so; the parts at
    either end are looked at row by row, of one number and key the first row only.
    """
    width = near.most / PARTS if near.most > 0 else 1.0
    part = lambda c: F.floor(c / width).cast("long")
    real = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < width * 2.0**52)
    r = right.withColumn("_n", near.right.cast("double")).filter(real(F.col("_n"))).groupBy("_k", "_n").agg(first.alias("_f"))
    l = left.select(left_id, "_k", near.left.cast("double").alias("_m")).filter(real(F.col("_m")))  # noqa: E741
    low, high = part(F.col("_m") - near.most), part(F.col("_m") + near.most)
    ends = F.array_distinct(F.flatten(F.array(*(F.array(e - 1, e, e + 1) for e in (low, high)))))
    edge = l.withColumn("_x", F.explode(ends)).join(r.withColumn("_x", part(F.col("_n"))), ["_k", "_x"]).filter(F.abs(F.col("_m") - F.col("_n")) <= near.most).select(left_id, "_f")
    # from low + 2 to high - 2 all rows are near: two spans a length cover them at most
    spans, table = [], []
    for v in range((2 * PARTS + 2).bit_length()):
        size = 2**v
        start, end = F.ceil((low + 2) / F.lit(float(size))).cast("long"), F.floor((high - 1) / F.lit(float(size))).cast("long")
        span = lambda x, v=v: F.struct(F.lit(v).alias("v"), x.alias("x"))
        spans += [F.when((start < end) & (F.pmod(start, F.lit(2)) == 1), span(start)), F.when((start < end) & (F.pmod(end, F.lit(2)) == 1), span(end - 1))]
        table.append(span(F.floor(F.col("_x") / F.lit(float(size))).cast("long")))
    cut = r.groupBy("_k", part(F.col("_n")).alias("_x")).agg(F.min("_f").alias("_f"))
    table = cut.withColumn("_s", F.explode(F.array(*table))).groupBy("_k", "_s").agg(F.min("_f").alias("_f"))
    covered = l.withColumn("_s", F.explode(F.array_compact(F.array(*spans)))).join(table, ["_k", "_s"]).select(left_id, "_f")
    return edge.unionByName(covered).groupBy(left_id).agg(F.min("_f").alias("_b"))


def tiered_match(left: DataFrame, right: DataFrame, left_id: str, right_id: str, tiers: Sequence[tuple[str, Column, Column, Column | Within | None]], order: Column | None = None) -> DataFrame:
    """(left_id, right_id, tier) of each left row's match: the first tier with one, in it the least ``order`` (by default the right id).

    tiers: (name, left key, right key, further condition, a Within, or None). Each is an
    equi-join of its own, over the rows that no earlier tier has matched; null
    keys match nothing. Only tiers with a condition meet all right rows of a key.
    """
    out, rest = None, left
    first = F.min(F.struct((F.col(right_id) if order is None else order).alias("_o"), F.col(right_id).alias("_r")))
    for name, lk, rk, more in tiers:
        a, b = rest.withColumn("_k", lk), right.withColumn("_k", rk)
        if more is None:
            best = a.join(b.groupBy("_k").agg(first.alias("_f")), "_k").groupBy(F.col(left_id)).agg(F.min("_f").alias("_b"))
        elif isinstance(more, Within):
            best = _first_within(a, b, left_id, more, first)
        else:
            best = a.join(b, "_k").filter(more).groupBy(F.col(left_id)).agg(first.alias("_b"))
        found = best.select(F.col(left_id), F.col("_b._r").alias(right_id), F.lit(name).alias("tier"))
        out = found if out is None else out.unionByName(found)
        rest = rest.join(found.select(left_id), left_id, "left_anti")
    return out


def rank_match(left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str, rank: str) -> DataFrame:
    """Matches by key with the best rank; keys whose best rank has several rows are ambiguous and match nothing."""
    w = Window.partitionBy("_l")
    hit = left.select(F.col(left_id).alias("_l"), key).join(right.select(key, F.col(right_id).alias("_r"), F.col(rank).alias("_k")), key)
    top = hit.withColumn("_b", F.min("_k").over(w)).filter("_k = _b").withColumn("_n", F.count("*").over(w)).filter("_n = 1")
    return top.select(F.col("_l").alias(left_id), F.col("_r").alias(right_id))


def cells(max_km: float, lat: Column, lng: Column) -> tuple[Column, Column]:
    """A point's cell (row of latitude, column), and the cells in which any point within ``max_km`` of it lies.

    Columns of a row are as wide as ``max_km`` reaches at the row's end that is
    nearer to a pole, a row further on, and run around the globe.
    """
    high = max_km / KM_A_DEGREE * 1.01
    row = F.floor(lat / high)

    def column(r: Column, steps: Sequence[int]) -> list[Column]:
        top = F.least(F.lit(90.0), (F.greatest(F.abs(r), F.abs(r + 1)) + 1) * high)
        reach = F.sin(F.radians(F.lit(min(180.0, high)) / 2)) / F.greatest(F.cos(F.radians(top)), F.lit(1e-12))
        n = F.greatest(F.lit(1), F.floor(360 / (1.01 * F.degrees(2 * F.asin(F.least(F.lit(1.0), reach))))))
        at = F.floor(F.pmod(lng + 180, F.lit(360.0)) / 360 * n)
        return [F.struct(r.alias("y"), F.pmod(at + i, n).alias("x")) for i in steps]

    return column(row, [0])[0], F.array_distinct(F.array(*(c for d in (-1, 0, 1) for c in column(row + d, (-1, 0, 1)))))


def within_km(left: DataFrame, right: DataFrame, max_km: float, keys: Sequence[str] = ()) -> DataFrame:
    """Pairs of rows within ``max_km``, with ``km``, anywhere on the globe. Sides have columns lat and lng and otherwise distinct names; points without coordinates take no part. keys: columns of the left that equal those of the right named _q and so."""
    ok = lambda d: d.filter(F.col("lat").between(-90, 90) & F.col("lng").isNotNull() & ~F.isnan("lng"))
    own, around = cells(max_km, F.col("lat"), F.col("lng"))
    a = ok(left).withColumn("_c", F.explode(around)).withColumnsRenamed({"lat": "_lat1", "lng": "_lng1"})
    b = ok(right).withColumn("_c", own).withColumnsRenamed({"lat": "_lat2", "lng": "_lng2"} | {f"_q{k}": k for k in keys})
    km = haversine_km(F.col("_lat1"), F.col("_lng1"), F.col("_lat2"), F.col("_lng2"))
    # Spark's estimate of a side leaves out how often its rows are exploded, so it would be broadcast at any size
    return a.hint("merge").join(b, ["_c", *keys]).withColumn("km", km).filter(F.col("km") <= max_km).drop("_c", "_lat1", "_lng1", "_lat2", "_lng2")


def proximity_pairs(points: DataFrame, id_col: str, max_km: float) -> DataFrame:
    """(a, b, km) of points within ``max_km``, each pair once with a < b."""
    p = points.select(F.col(id_col), "lat", "lng")
    found = within_km(p.withColumnRenamed(id_col, "a"), p.withColumnRenamed(id_col, "b"), max_km)
    return found.filter("a < b").select("a", "b", "km")


#: How much further each round of a search for the nearest looks, and how many candidates a point may have in a round.
FURTHER, CROWD = 4.0, 64


def nearest(left: DataFrame, right: DataFrame, left_id: str, right_id: str, max_km: float, keys: Sequence[str] = ()) -> DataFrame:
    """(left_id, right_id, km) of the nearest right row within ``max_km``, of those with the same ``keys``; ties to the smaller id.

    By rounds of growing distance: what lies closest is looked for first, and only
    rows that found nothing look further, so that a point meets some rows around it, and
    not all within ``max_km``. The first distance is where right rows get as dense as
    CROWD around a point. Rows of one place and keys are one, with the least id.
    """
    at = ["lat", "lng", *keys]
    ok = F.col("lat").between(-90, 90) & F.col("lng").isNotNull() & ~F.isnan("lng")
    r = durable(right.filter(ok).groupBy(*at).agg(F.min(right_id).alias(right_id)), "near-right")
    named = lambda d: d.withColumnsRenamed({k: f"_q{k}" for k in keys})
    rest, out = durable(left.filter(ok).select(left_id, *at), "near-left"), None
    steps = [max_km]
    while steps[-1] > 0.25 and _crowded(r, keys, steps[-1]):
        steps.append(steps[-1] / FURTHER)
    for km in reversed(steps):
        hit = within_km(rest, named(r), km, keys)
        found = hit.groupBy(left_id).agg(F.min(F.struct("km", right_id)).alias("m")).select(left_id, f"m.{right_id}", "m.km")
        if km != max_km:
            found = durable(found, "nearest")
            rest = durable(rest.join(found.select(left_id), left_id, "left_anti"), "near-left")
        out = found if out is None else out.unionByName(found)
    return out


def _crowded(points: DataFrame, keys: Sequence[str], km: float) -> bool:
    """Whether points of the same keys have more than CROWD others around them in their cells of ``km``, on the average of points."""
    own, _ = cells(km, F.col("lat"), F.col("lng"))
    n = points.groupBy(own.alias("_c"), *keys).agg(F.count("*").cast("double").alias("n"))
    met = n.agg((F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("m")).first()["m"]
    return bool(met) and met * 9 > CROWD


def name_and_distance(left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str, alone_km: float = 25, many_km: float = 10) -> DataFrame:
    """Matches by key: the only candidate within ``alone_km``, or the nearest of several within ``many_km``; without coordinates only the only one. Candidates are counted by key; only keys with one are joined as a whole."""
    found = right.groupBy(key).agg(F.count("*").alias("_n"), F.min(F.struct(F.col(right_id), F.col("lat").alias("_c"), F.col("lng").alias("_d"))).alias("_r"))
    hit = left.select(left_id, key, F.col("lat").alias("_a"), F.col("lng").alias("_b")).join(found, key).withColumn("_n", F.sum("_n").over(Window.partitionBy(left_id)))
    km = haversine_km(F.col("_a"), F.col("_b"), F.col("_r._c"), F.col("_r._d"))
    alone = hit.filter("_n = 1").select(left_id, F.col(f"_r.{right_id}").alias(right_id), km.alias("km")).filter(F.col("km").isNull() | (F.col("km") <= alone_km))
    several = hit.filter("_n > 1").select(left_id, key, F.col("_a").alias("lat"), F.col("_b").alias("lng"))
    return alone.unionByName(nearest(several, right.select(right_id, key, "lat", "lng"), left_id, right_id, many_km, [key]))


def contained_name(texts: DataFrame, names: DataFrame, text_id: str, text: str, name_id: str, name: str, least: int = 5) -> DataFrame:
    """(text_id, name_id) of the longest name of ``least`` letters or more whose words stand in the text.

    Runs of as many words as some name has are joined to the names, so that the
    join is an equi-join, and a text is not copied for each of its words.
    """
    from ..functions.text import search_norm

    n = names.select(F.col(name_id), search_norm(F.col(name)).alias("_n")).filter(F.length("_n") >= least)
    n = small(n.groupBy("_n").agg(F.min(F.struct(name_id)).alias("_i")))
    counts = sorted(r[0] for r in n.select(F.size(F.split("_n", " "))).distinct().collect())
    t = texts.select(F.col(text_id), F.split(search_norm(F.col(text)), " ").alias("_t"))
    starts = lambda k: F.when(F.size("_t") >= k, F.sequence(F.lit(1), F.size("_t") - k + 1)).otherwise(F.array().cast("array<int>"))
    run = lambda k: F.array_distinct(F.transform(starts(k), lambda i: F.array_join(F.slice("_t", i, k), " ")))
    runs = F.concat(F.array().cast("array<string>"), *(run(k) if k > 1 else F.array_distinct("_t") for k in counts))
    hit = t.select(text_id, F.explode(runs).alias("_n")).join(n, "_n")
    best = hit.groupBy(text_id).agg(F.min(F.struct((-F.length("_n")).alias("_l"), "_i")).alias("_b"))
    return best.select(text_id, F.col(f"_b._i.{name_id}").alias(name_id))


def polygon_cells(polygons: DataFrame, polygon_id: str, cell_degrees: float = 0.5, reach_m: float = 0.0) -> tuple[DataFrame, dict[str, Column]]:
    """Polygons once for each cell that their boxes, widened by ``reach_m``, touch, and the columns that put a point (lat, lng) in its cell. polygons: outers and inners, arrays of rings of x, y."""
    from ..functions.geo import ring_box

    up = reach_m / (KM_A_DEGREE * 1000) * 1.01
    high = F.greatest(F.abs("_b.south"), F.abs("_b.north")) + up
    wide = up / F.greatest(F.cos(F.radians(F.least(high, F.lit(89.0)))), F.lit(0.01))
    boxes = polygons.withColumn("_b", F.explode(F.transform("outers", ring_box)))
    cell = lambda c: F.floor(c / cell_degrees).cast("int")
    cells = boxes.withColumn("_x", F.explode(F.sequence(cell(F.col("_b.west") - wide), cell(F.col("_b.east") + wide))))
    cells = cells.withColumn("_y", F.explode(F.sequence(cell(F.col("_b.south") - up), cell(F.col("_b.north") + up)))).drop("_b")
    return cells.dropDuplicates([polygon_id, "_x", "_y"]), {"_x": cell(F.col("lng")), "_y": cell(F.col("lat"))}


#: Parts into which a cell's side is cut where an edge crosses the cell.
SPLIT = 10


def shape_cells(polygons: DataFrame, keep: Sequence[str], cell_degrees: float = 0.5, reach_m: float = 0.0) -> tuple[DataFrame, DataFrame, dict[str, Column]]:
    """Where polygons lie: (whole, cut, at).

    whole: ``keep`` and (_bx, _by) of the cells that lie in a polygon as a whole. cut:
    ``keep``, outers, inners, _all and (_x, _y) of the parts of other cells, SPLIT a side,
    that lie in it (_all) or that an edge widened by ``reach_m`` touches; what is in neither
    is further away. at: the columns that put a point (lat, lng) in its cell and part.
    polygons: outers and inners, arrays of rings of x, y.
    """
    from ..functions.geo import in_polygon, ring_box, ring_edges

    # parts overlap by more than the rounding of a coordinate
    slack = 1e-9
    up, fine = reach_m / (KM_A_DEGREE * 1000) * 1.01, cell_degrees / SPLIT
    wide = lambda lat: up / F.greatest(F.cos(F.radians(F.least(lat, F.lit(89.0)))), F.lit(0.01))
    at = lambda c: F.floor(c / fine).cast("int")
    big = lambda c: F.floor(at(c) / SPLIT).cast("int")

    def grid(b: Column) -> Column:
        w = wide(F.greatest(F.abs(b["south"]), F.abs(b["north"])) + up)
        ys = F.sequence(big(b["south"] - up - slack), big(b["north"] + up + slack))
        return F.flatten(F.transform(F.sequence(big(b["west"] - w - slack), big(b["east"] + w + slack)), lambda x: F.transform(ys, lambda y: F.struct(x.alias("x"), y.alias("y")))))

    def met(edges: Column, x: Column, y: Column, side: float, widened: bool, of=F.exists) -> Column:
        """Whether an edge's box touches a cell; by F.filter, which do."""
        south, north = y * side - slack, (y + 1) * side + slack
        a, b = (up, wide(F.greatest(F.abs(south), F.abs(north)))) if widened else (0.0, F.lit(0.0))
        hit = lambda e: (F.least(e["a"]["x"], e["b"]["x"]) <= (x + 1) * side + slack + b) & (F.greatest(e["a"]["x"], e["b"]["x"]) >= x * side - slack - b) & (F.least(e["a"]["y"], e["b"]["y"]) <= north + a) & (F.greatest(e["a"]["y"], e["b"]["y"]) >= south - a)
        return of(edges, hit)

    middle = lambda x, y, side: in_polygon((x + 0.5) * side, (y + 0.5) * side, F.col("outers"), F.coalesce("inners", F.array()))
    cells = polygons.select(*keep, "outers", "inners", F.explode(F.array_distinct(F.flatten(F.transform("outers", lambda r: grid(ring_box(r)))))).alias("_c")).select(*keep, "outers", "inners", F.col("_c.x").alias("_bx"), F.col("_c.y").alias("_by"))
    # few polygons make many cells: they are dealt to all tasks before edges are looked at, and that is done once
    cells = cells.repartition(4 * polygons.sparkSession.sparkContext.defaultParallelism)
    rings = F.concat("outers", F.coalesce("inners", F.array()))
    cells = cells.withColumn("_e", met(F.flatten(F.transform(rings, ring_edges)), F.col("_bx"), F.col("_by"), cell_degrees, True, F.filter))
    crossed = met(F.col("_e"), F.col("_bx"), F.col("_by"), cell_degrees, False)
    cells = durable(cells.withColumn("_in", ~crossed & middle(F.col("_bx"), F.col("_by"), cell_degrees)), "cells")
    whole = cells.filter("_in").select(*keep, "_bx", "_by")
    steps = F.sequence(F.lit(0), F.lit(SPLIT - 1))
    parts = cells.filter(~F.col("_in") & (F.size("_e") > 0)).withColumn("_x", F.explode(F.transform(steps, lambda i: F.col("_bx") * SPLIT + i))).withColumn("_y", F.explode(F.transform(steps, lambda i: F.col("_by") * SPLIT + i)))
    x, y = F.col("_x"), F.col("_y")
    parts = parts.withColumn("_all", F.when(met(F.col("_e"), x, y, fine, False), False).otherwise(middle(x, y, fine)))
    cut = durable(parts.filter(F.col("_all") | met(F.col("_e"), x, y, fine, True)).select(*keep, "outers", "inners", "_all", "_x", "_y"), "parts")
    return whole, cut, {"_x": at(F.col("lng")), "_y": at(F.col("lat")), "_bx": big(F.col("lng")), "_by": big(F.col("lat"))}


_AT = ("_x", "_y", "_bx", "_by")


def points_in_polygons(points: DataFrame, polygons: DataFrame, polygon_id: str, cell_degrees: float = 0.5) -> DataFrame:
    """Points joined to each polygon that holds them; where a whole cell lies in a polygon, no point of it is tested."""
    from ..functions.geo import in_polygon

    keep = [c for c in polygons.columns if c not in ("outers", "inners")]
    whole, cut, at = shape_cells(polygons, keep, cell_degrees)
    p = points.withColumns(at)
    near = p.join(cut, ["_x", "_y"]).filter(F.col("_all") | in_polygon(F.col("lng"), F.col("lat"), F.col("outers"), F.coalesce("inners", F.array())))
    return p.join(whole, ["_bx", "_by"]).drop(*_AT).unionByName(near.drop(*_AT, "_all", "outers", "inners"))


def _first_polygon(points: DataFrame, polygons: DataFrame, point_id: str, polygon_id: str, max_m: float, cell_degrees: float) -> DataFrame:
    """(point_id, m: metres, area, polygon_id): the least for each point that has a polygon within ``max_m``.

    Polygons of one shape are one, with the least area and id. In a part that some
    polygon holds as a whole, only those that would come before it are tested.
    """
    from ..functions.geo import in_polygon, polygon_distance_m

    shapes = polygons.groupBy("outers", "inners").agg(F.min(F.struct("area", polygon_id)).alias("_o"))
    whole, cut, at = shape_cells(shapes, ["_o"], cell_degrees, max_m)
    cells = whole.groupBy("_bx", "_by").agg(F.min("_o").alias("_w"))
    parts = cut.filter("_all").groupBy("_x", "_y").agg(F.min("_o").alias("_v"))
    best = F.least("_w", "_v")
    up = lambda c: F.floor(F.col(c) / SPLIT).cast("int")
    rest = cut.filter("not _all").withColumns({"_bx": up("_x"), "_by": up("_y")}).join(cells, ["_bx", "_by"], "left").join(parts, ["_x", "_y"], "left")
    rest = rest.filter(best.isNull() | (F.col("_o") < best)).select("_x", "_y", "_o", "outers", "inners")
    p = points.select(point_id, "lat", "lng").withColumns(at)
    held = p.join(cells, ["_bx", "_by"], "left").join(parts, ["_x", "_y"], "left").filter(best.isNotNull()).select(point_id, F.lit(0.0).alias("metres"), best.alias("_o"))
    inner = F.coalesce("inners", F.array())
    metres = polygon_distance_m(F.col("lat"), F.col("lng"), F.col("outers"), inner) if max_m > 0 else F.when(in_polygon(F.col("lng"), F.col("lat"), F.col("outers"), inner), 0.0)
    tested = p.join(rest, ["_x", "_y"]).select(point_id, metres.alias("metres"), "_o").filter(F.col("metres") <= max_m)
    return held.unionByName(tested).groupBy(point_id).agg(F.min(F.struct("metres", "_o.area", f"_o.{polygon_id}")).alias("m"))


def smallest_polygon(points: DataFrame, polygons: DataFrame, point_id: str, polygon_id: str, cell_degrees: float = 0.5) -> DataFrame:
    """(point_id, polygon_id) of the smallest polygon that holds a point. polygons: outers and inners (arrays of rings of x, y) and area."""
    return _first_polygon(points, polygons, point_id, polygon_id, 0.0, cell_degrees).select(point_id, f"m.{polygon_id}")


def polygon_points(polygons: DataFrame, points: DataFrame, polygon_id: str, point_id: str, value: str, cell_degrees: float = 0.5) -> DataFrame:
    """For each polygon that holds points: the one of the largest ``value`` (of equals the least id), and all of them in falling order. Points are listed once for polygons of one shape."""
    known = polygons.select(polygon_id, "outers", F.coalesce("inners", F.array()).alias("inners")).distinct()
    shapes = known.groupBy("outers", "inners").agg(F.min(polygon_id).alias("_s"))
    hit = points_in_polygons(points, shapes, "_s", cell_degrees).select("_s", F.struct((-F.col(value)).alias("v"), point_id).alias("p"))
    found = hit.groupBy("_s").agg(F.array_sort(F.collect_list("p")).alias("_p"))
    found = found.select("_s", F.get("_p", F.lit(0))[point_id].alias(point_id), (-F.get("_p", F.lit(0))["v"]).alias(value), F.transform("_p", lambda p: p[point_id]).alias("points"))
    members = known.join(shapes, ["outers", "inners"]).select(polygon_id, "_s")
    return members.join(found, "_s").drop("_s")


def nearest_polygon(points: DataFrame, polygons: DataFrame, point_id: str, polygon_id: str, max_m: float, cell_degrees: float = 0.5) -> DataFrame:
    """(point_id, polygon_id, metres) of the nearest polygon within ``max_m``, 0 inside one; of several the smallest, then the least id. polygons: area too."""
    return _first_polygon(points, polygons, point_id, polygon_id, max_m, cell_degrees).select(point_id, f"m.{polygon_id}", "m.metres")


def place_listing(points: DataFrame, polygons: DataFrame, names: DataFrame, point_id: str, place: str, title: str, offshore_m: float = 200) -> DataFrame:
    """(point_id, place, how): the polygon that holds a point, else the nearest within ``offshore_m``, else the longest name in its title. polygons and names: place."""
    near = nearest_polygon(points.filter("lat is not null and lng is not null"), polygons, point_id, place, offshore_m)
    placed = near.select(point_id, place, F.when(F.col("metres") == 0, "polygon").otherwise("proximity").alias("how"))
    rest = points.join(placed.select(point_id), point_id, "left_anti")
    return placed.unionByName(contained_name(rest, names, point_id, title, place, "name").withColumn("how", F.lit("name")))


def name_cascade(left: DataFrame, right: DataFrame, left_id: str, right_id: str, least_ratio: float = 0.88) -> DataFrame:
    """(left_id, right_id, tier): by the whole key, by the key with ' island' after it, else the best matching ratio of ``least_ratio`` at least; of equals the least right id. Both sides: nation and key."""
    from .spelling import similar_keys

    k, other = F.col("_kl"), F.col("_kr")
    l, r = left.select(left_id, "nation", F.col("key").alias("_kl")), right.select(right_id, "nation", F.col("key").alias("_kr"))  # noqa: E741
    exact = tiered_match(l, r, left_id, right_id, [("exact", F.concat_ws("|", "nation", k), F.concat_ws("|", "nation", other), None), ("expanded", F.concat_ws("|", "nation", F.concat(k, F.lit(" island"))), F.concat_ws("|", "nation", other), None)])
    rest = l.join(exact.select(left_id), left_id, "left_anti")
    near = similar_keys(rest.select("nation", k.alias("key")), right, "nation", "key", least_ratio)
    rows = r.groupBy("nation", "_kr").agg(F.min(right_id).alias(right_id))
    rated = near.withColumnsRenamed({"left_key": "_kl", "right_key": "_kr"}).join(rows, ["nation", "_kr"])
    best = rated.groupBy("nation", "_kl").agg(F.min(F.struct((-F.col("ratio")).alias("q"), right_id)).alias("m")).join(rest, ["nation", "_kl"])
    return exact.unionByName(best.select(left_id, f"m.{right_id}", F.lit("fuzzy").alias("tier")))


def fuzzy_name(targets: DataFrame, places: DataFrame, target: str, place_id: str) -> DataFrame:
    """(target, place_id, edits) of the place whose folded name is within one edit, two from 8 letters on; of equals the larger one, then the least id. Targets of 4 to 40 letters; places: name, area.

    Names meet targets over their pieces: with d edits, one of d + 1 pieces of the
    target stands unchanged in the name, at most d places away.
    """
    from ..functions.text import fold

    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(fold(c), r"\b(?:the|isle of|island of)\b", " "), r"\s+", " "))
    t = targets.select(target, plain(F.col(target)).alias("_t")).filter(F.length("_t").between(4, 40)).withColumn("_d", F.when(F.length("_t") >= 8, 2).otherwise(1))
    n = F.length("_t")
    piece = lambda i: F.struct((F.floor(n * i / (F.col("_d") + 1)) + 1).alias("s"), (F.floor(n * (i + 1) / (F.col("_d") + 1)) - F.floor(n * i / (F.col("_d") + 1))).alias("k"))
    parts = t.withColumn("_p", F.explode(F.when(F.col("_d") == 2, F.array(*(piece(F.lit(i)) for i in range(3)))).otherwise(F.array(*(piece(F.lit(i)) for i in range(2))))))
    parts = parts.select(target, "_t", "_d", F.substring(F.col("_t"), F.col("_p.s").cast("int"), F.col("_p.k").cast("int")).alias("_g"))
    sizes = [r[0] for r in parts.select(F.length("_g")).distinct().collect()]  # 20 lengths at most
    names = places.select(F.col(place_id), "area", plain(F.col("name")).alias("_n")).filter("_n <> ''")
    starts = lambda k: F.when(F.length("_n") >= k, F.sequence(F.lit(1), F.length("_n") - k + 1)).otherwise(F.array().cast("array<int>"))
    runs_of = lambda k: F.transform(starts(k), lambda i: F.substring(F.col("_n"), i, F.lit(k)))
    grams = [runs_of(k) for k in sizes] or [F.array().cast("array<string>")]
    hit = names.withColumn("_g", F.explode(F.array_distinct(F.concat(*grams)))).join(parts, "_g").select(target, place_id, "area", "_n", "_t", "_d").distinct()
    close = hit.withColumn("_e", F.levenshtein("_n", "_t", 2)).filter((F.col("_e") >= 0) & (F.col("_e") <= F.col("_d")))
    best = close.groupBy(target).agg(F.min(F.struct("_e", (-F.coalesce("area", F.lit(0.0))).alias("a"), place_id)).alias("m"))
    return best.select(target, f"m.{place_id}", F.col("m._e").alias("edits"))


def token_pairs(df: DataFrame, keys: Sequence[str], id_col: str, tokens: str) -> DataFrame:
    """(a, b, score) of rows of one key that share a token, a < b, with the Jaccard score of their token sets; rows meet over keys and tokens, so those without a token in common never do. Equal sets of one key are compared once; the pairs of their rows are the result itself."""
    rows = df.select(*keys, id_col, F.array_sort(F.array_distinct(tokens)).alias("_v")).filter(F.size("_v") > 0)
    sets = rows.select(*keys, "_v").distinct().withColumn("_t", F.explode("_v"))
    side = lambda d, v: d.withColumnRenamed("_v", v)
    met = side(sets, "_x").join(side(sets, "_y"), [*keys, "_t"]).filter("_x <= _y").select(*keys, "_x", "_y").distinct()
    c = F.size(F.array_intersect("_x", "_y"))
    rated = met.withColumn("score", c / (F.size("_x") + F.size("_y") - c))
    return _rows_of(rated, rows, keys, id_col, "_v", "score")


def _rows_of(pairs: DataFrame, rows: DataFrame, keys: Sequence[str], id_col: str, value: str, found: str) -> DataFrame:
    """(a, b, found) with a < b of all rows whose values are a pair (_x <= _y) of one key."""
    side = lambda v, i: rows.select(*keys, F.col(value).alias(v), F.col(id_col).alias(i))
    # a few pairs of values make many rows: they are dealt to all tasks, and never left to the one that a small table fits in
    n = 4 * rows.sparkSession.sparkContext.defaultParallelism
    one = pairs.repartition(n, *keys, "_x").hint("merge").join(side("_x", "_i"), [*keys, "_x"])
    both = one.repartition(n, *keys, "_y").hint("merge").join(side("_y", "_j"), [*keys, "_y"])
    both = both.filter((F.col("_i") < F.col("_j")) | ((F.col("_x") != F.col("_y")) & (F.col("_i") != F.col("_j"))))
    return both.select(F.least("_i", "_j").alias("a"), F.greatest("_i", "_j").alias("b"), found)


def near_spellings(df: DataFrame, keys: Sequence[str], id_col: str, text: str, most: int) -> DataFrame:
    """(a, b, distance) of rows of one key whose texts differ by ``most`` edits at most, a < b. Equal texts of one key are compared once; the pairs of their rows are the result itself."""
    from ..functions.text import banded_distance

    rows = df.select(*keys, id_col, F.col(text).alias("_v")).filter("_v is not null")
    texts = rows.select(*keys, "_v").distinct()
    side = lambda v: texts.withColumnRenamed("_v", v)
    met = side("_x").join(side("_y"), list(keys)).filter((F.col("_x") <= F.col("_y")) & (F.abs(F.length("_x") - F.length("_y")) <= most))
    rated = met.withColumn("distance", banded_distance(F.col("_x"), F.col("_y"))).filter(F.col("distance") <= most)
    return _rows_of(rated, rows, keys, id_col, "_v", "distance")


def rounded_match(left: DataFrame, right: DataFrame, digits: int = 4, how: str = "full_outer") -> DataFrame:
    """Equi-join on coordinates rounded to ``digits``; the other columns' names must differ."""
    cut = lambda d: d.withColumns({"lat": F.round("lat", digits), "lng": F.round("lng", digits)})
    return cut(left).join(cut(right), ["lat", "lng"], how)


def changed(old: DataFrame, new: DataFrame, key: str, value: str, least: float) -> DataFrame:
    """Metrics that are new, gone or changed by at least ``least`` of the old value."""
    j = old.select(key, F.col(value).alias("old")).join(new.select(key, F.col(value).alias("new")), key, "full_outer")
    return j.filter(F.col("old").isNull() | F.col("new").isNull() | (F.abs(F.col("new") - F.col("old")) >= least * F.abs("old")) & (F.col("new") != F.col("old")))


def missing(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right.select(*keys).distinct(), list(keys), "left_anti")


def alias_index(df: DataFrame, id_col: str, aliases: Sequence[Column], order: str) -> DataFrame:
    """(alias, id): who has an alias first in ``order`` keeps it."""
    long = df.select(F.col(id_col), F.col(order).alias("_o"), F.posexplode(F.array(*aliases)).alias("_p", "alias")).filter("alias is not null and alias <> ''")
    return first_of(long, ["alias"], [F.col("_o"), F.col("_p")]).select("alias", id_col)
