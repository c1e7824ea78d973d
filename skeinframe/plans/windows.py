"""Queries of picks, lists, windows, aggregates and sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import agg, joins, merge, topk
from .base import ITEMS_SQL, PLACES_SQL, items, places
from .registry import query

_P, _I = PLACES_SQL, ITEMS_SQL


@query(f"SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY lower(w), round(lat, 2), round(lng, 2) ORDER BY coalesce(elevation, 0) DESC, id) AS r FROM (SELECT w, round(lat, 0) AS lat, round(lng, 0) AS lng, elevation, id FROM {_P} p) a) q WHERE r = 1")
def best_per_place(t):
    """One row a name and place: the best (W-08)."""
    p = places(t).select("id", "w", F.round("lat", 0).alias("lat"), F.round("lng", 0).alias("lng"), "elevation")
    return topk.best_per_place(p, "w", F.coalesce("elevation", F.lit(0.0)), "id").select("id")


@query(
    f"""WITH j AS (SELECT id, lower(trim(name)) AS k, name, CASE WHEN id % 29 = 0 THEN id % 7 END AS ord, coalesce(area, 0) AS score FROM {_P} p), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ord IS NULL, ord, score DESC, lower(name), id) AS r FROM j) SELECT id, CASE WHEN ord IS NULL THEN 'atlas' ELSE 'curated' END AS tier FROM r WHERE r = 1 OR k = '' ORDER BY ord IS NULL, ord, score DESC, lower(name), id LIMIT 20"""
)
def featured_places(t):
    """Curated places in their order, then the best; one a name (W-11)."""
    p = places(t).select("id", "name", F.coalesce("area", F.lit(0.0)).alias("score"))
    curated = p.filter("id % 29 = 0").select("id", (F.col("id") % 7).alias("ord"))
    return topk.featured(p, curated, "id", "name", "score", 20).select("id", "tier")


@query(f"SELECT id FROM {_P} p ORDER BY has_photo DESC, coalesce(elevation, 0) DESC, coalesce(area, 0) DESC, lower(name), id LIMIT 15")
def topic_picks(t):
    """Pictured, high and large places (W-12)."""
    return topk.topic_picks(places(t), "id", 15).select("id")


@query(
    f"""WITH s AS (SELECT id, lower(trim(name)) AS k, coalesce(CASE WHEN id % 3 = 0 THEN 'own' || id END, CASE WHEN NOT has_photo AND id % 5 = 0 THEN 'cited' || id END) AS thumb, coalesce(area, 0) AS a FROM {_P} p WHERE name <> ''), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY a DESC, id) AS r FROM s WHERE thumb IS NOT NULL) SELECT id, thumb FROM r WHERE r = 1 ORDER BY a DESC, id LIMIT 3"""
)
def home_picks(t):
    """Three places with a picture to show (W-25)."""
    i = F.col("id").cast("string")
    p = places(t).withColumns({"own": F.when(F.col("id") % 3 == 0, F.concat(F.lit("own"), i)), "cited": F.when(F.col("id") % 5 == 0, F.concat(F.lit("cited"), i))})
    return topk.home_picks(p, "name", F.col("own"), F.col("cited"), F.col("has_photo"), [F.coalesce("area", F.lit(0.0)).desc(), F.col("id")]).select("id", "thumb")


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 400")
def newest_notes(t):
    """The newest 400 notes (W-22, W-24)."""
    return topk.newest(t("orders"), "o_orderdate", "o_orderkey", 400).select("o_orderkey", "o_custkey")


@query(f"SELECT slug, n, CAST(row_number() OVER (ORDER BY n DESC, slug) AS INTEGER) AS place FROM (SELECT slug, count(*) AS n FROM {_I} i GROUP BY slug) q")
def guides_in_order(t):
    """Guides by rows and name (W-17)."""
    g = items(t).groupBy("slug").agg(F.count("*").alias("n"))
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "slug")))  # one row a guide


@query("SELECT c_custkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS i, count(*) OVER () AS n FROM customer) q WHERE i = 2840 % n")
def weekly_pick(t):
    """The row whose week it is (W-20)."""
    return topk.weekly_pick(t("customer").select("c_custkey"), F.lit(2840 * 604800 + 5), "c_custkey")


@query("SELECT c_custkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS i, count(*) OVER () AS n FROM customer WHERE c_custkey % 4 <> 0) q WHERE i = CAST(floor(0.37 * n) AS BIGINT)")
def random_pick(t):
    """A row by a number, of those not excluded (W-20)."""
    c = t("customer").select("c_custkey")
    return topk.random_pick(c, c.filter("c_custkey % 4 = 0"), "c_custkey", 4, 0.37, "c_custkey")


@query(
    """WITH l AS (SELECT cat, first(p_partkey ORDER BY p_retailprice DESC, p_partkey) AS p FROM (SELECT *, p_size % 5 AS cat FROM part) a GROUP BY cat), s AS (SELECT first(p_partkey ORDER BY p_retailprice DESC, p_partkey) AS p, p_brand FROM part WHERE p_partkey IN (SELECT p FROM l) GROUP BY p_brand),
 f AS (SELECT first(p_partkey ORDER BY p_retailprice DESC, p_partkey) AS p, p_brand FROM part WHERE p_brand NOT IN (SELECT p_brand FROM s) GROUP BY p_brand), u AS (SELECT p, 1 AS pass FROM s UNION ALL SELECT p, 2 FROM f UNION ALL SELECT p_partkey, 3 FROM part WHERE p_partkey NOT IN (SELECT p FROM s UNION SELECT p FROM f))
 SELECT p AS p_partkey FROM u JOIN part ON p = p_partkey ORDER BY pass, p_retailprice DESC, p_partkey LIMIT 10"""
)
def diverse_picks(t):
    """One of each category, then one of each series, then the rest (W-13)."""
    p = t("part").select("p_partkey", "p_brand", (F.col("p_size") % 5).alias("cat"), "p_retailprice")
    return topk.diverse(p, "cat", "p_brand", [F.desc("p_retailprice"), F.col("p_partkey")], 10).select("p_partkey")


@query("SELECT o_orderkey, lag(o_totalprice) OVER w AS before, lead(o_totalprice) OVER w AS after, CAST(ntile(4) OVER w AS INTEGER) AS quarter, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS mean3 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def window_frames(t):
    """Neighbours, quarters and moving means (W-23)."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    p = F.col("o_totalprice")
    return t("orders").select("o_orderkey", F.lag(p).over(w).alias("before"), F.lead(p).over(w).alias("after"), F.ntile(4).over(w).alias("quarter"), F.round(F.avg(p).over(w.rowsBetween(-2, 0)), 4).alias("mean3"))


@query(f"SELECT slug, coalesce(facet, '') AS facet, count(*) AS n, count(DISTINCT source_title) AS sources FROM {_I} i GROUP BY 1, 2")
def facet_counts(t):
    """Facets of guides and their sources (A-20)."""
    return agg.facet_counts(items(t), "slug", "facet", "source_title")


@query("SELECT o_orderstatus, o_orderpriority, CAST(grouping_id(o_orderstatus, o_orderpriority) AS BIGINT) AS level, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def grouping_sets(t):
    """Counts and sums by two columns, each alone, and over all (A-26)."""
    return agg.grouping_sets(t("orders"), "o_orderstatus", "o_orderpriority", "o_totalprice").withColumn("total", F.round("total", 2))


@query("SELECT o_orderstatus, share, round(v, 4) AS o_totalprice FROM (SELECT o_orderstatus, unnest([0.1, 0.5, 0.9]) AS share, unnest(quantile_cont(o_totalprice, [0.1, 0.5, 0.9])) AS v FROM orders GROUP BY o_orderstatus) q")
def quantiles(t):
    """Exact quantiles of a group (A-26)."""
    return agg.quantiles(t("orders"), "o_orderstatus", "o_totalprice", [0.1, 0.5, 0.9]).withColumn("o_totalprice", F.round("o_totalprice", 4)).select("o_orderstatus", F.col("share").cast("double").alias("share"), "o_totalprice")


@query(
    """SELECT s_suppkey AS k, min(l_quantity) AS low, max(l_quantity) AS high, count(*) AS cells FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE abs(l_linenumber - 3.5) < 2 AND abs(CAST(l_partkey % 10 AS DOUBLE) - 4.5) < 3 AND NOT (abs(l_linenumber - 3.5) < 1 AND abs(CAST(l_partkey % 10 AS DOUBLE) - 4.5) < 1) GROUP BY s_suppkey"""
)
def height_ranges(t):
    """The lowest and highest cells inside a mask with a hole (A-23)."""
    ring = lambda h, d: F.array(*(F.struct(F.lit(4.5 + b * d).alias("x"), F.lit(3.5 + a * h).alias("y")) for a, b in ((-1, -1), (-1, 1), (1, 1), (1, -1))))
    c = t("lineitem").select(F.col("l_suppkey").alias("k"), (F.col("l_partkey") % 10).cast("double").alias("x"), F.col("l_linenumber").cast("double").alias("y"), F.col("l_quantity").alias("metres"), F.array(ring(2.0, 3.0)).alias("outers"), F.array(ring(1.0, 1.0)).alias("inners"))
    return agg.height_range(c, "k")


@query(
    f"""SELECT id, list_aggregate(list_sort(list_distinct(list_filter([lower(type), lower(source), 'a', lower(type)], lambda x: x IS NOT NULL))), 'string_agg', ',') AS tags, 'v1|' || coalesce(wikidata, 'v2') AS names, CASE WHEN id % 2 = 0 THEN 'n1,n2' ELSE 'n1,n2,n3' END AS sources FROM {_P} p"""
)
def unions_of_fields(t):
    """Tags, names and sources of two records as unions (U-03, U-06)."""
    src = lambda n: F.struct(F.lit(n).alias("name"), F.lit("r").alias("ref"))
    a, b = F.array(src("n1"), src("n2")), F.when(F.col("id") % 2 == 0, F.array(src("n2"))).otherwise(F.array(src("n1"), src("n3")))
    names = merge.names_union(F.create_map(F.lit("en"), F.lit("v1")), F.create_map(F.lit("en"), F.lit("x"), F.lit("gd"), F.coalesce("wikidata", F.lit("v2"))))
    return places(t).select("id", F.array_join(F.array_sort(F.array_union(F.array(F.lower("type"), F.lower("source")), F.array(F.lit("a"), F.lower("type")))), ",").alias("tags"), F.concat_ws("|", F.element_at(names, "en"), F.element_at(names, "gd")).alias("names"), F.array_join(F.transform(merge.provenance_union(a, b), lambda s: s["name"]), ",").alias("sources"))


@query(f"SELECT CASE WHEN id % 10 = 0 THEN 'new-' || id ELSE CAST(id - id % 10 + CASE WHEN id % 10 IN (1, 2) THEN 1 ELSE id % 10 END AS VARCHAR) END AS key, count(*) AS n FROM {_P} p WHERE id % 10 NOT IN (1, 2) GROUP BY 1 UNION ALL SELECT 'wd-Q' || id, 1 FROM {_P} p WHERE id % 10 IN (1, 2) AND wikidata IS NOT NULL UNION ALL SELECT CAST(id - id % 10 + 1 AS VARCHAR), count(*) FROM {_P} p WHERE id % 10 IN (1, 2) AND wikidata IS NULL GROUP BY 1")
def rekeyed_duplicates(t):
    """Rows that share a key take a better one (M-15)."""
    i = F.col("id")
    key = F.when(i % 10 == 0, F.concat(F.lit("new-"), i)).otherwise((i - i % 10 + F.when((i % 10).isin(1, 2), 1).otherwise(i % 10)).cast("string"))
    out = merge.rekey_duplicates(places(t).withColumn("key", key), "key", F.concat(F.lit("wd-"), "wikidata"))
    return out.groupBy("key").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey AS k, CASE WHEN bool_and(l_returnflag = 'N') THEN 'high' ELSE 'medium' END AS confidence FROM lineitem GROUP BY l_orderkey")
def worst_of_listings(t):
    """The worst confidence of a place's listings (A-17)."""
    li = t("lineitem").select(F.col("l_orderkey").alias("k"), F.when(F.col("l_returnflag") == "N", "high").otherwise("medium").alias("confidence"))
    return agg.worst(li, ["k"], "confidence")


@query(f"SELECT a.id AS a, b.id AS b FROM {_P} a JOIN {_P} b ON a.id % 2 = 0 AND b.id = a.id + 1")
def joined_by_id(t):
    """Staged rows onto places by id; missing ids are skipped (J-01)."""
    p = places(t).select("id")
    return joins.missing(p.filter("id % 2 = 0"), p.filter("id < 0"), ["id"]).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).join(p.withColumnRenamed("id", "b"), "b")
