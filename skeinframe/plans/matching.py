"""Matching, spatial, graph and merge queries over the star tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, text
from ..operators import graph, joins, merge
from .registry import query

HAV = "2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))))"
_PTS = "SELECT vec_id, 55.0 + 10 * embedding[1] AS lat, -4.0 + 10 * embedding[2] AS lng FROM embeddings"


def _points(t):
    return t("embeddings").select("vec_id", (F.lit(55.0) + 10 * F.col("embedding")[0].cast("double")).alias("lat"), (F.lit(-4.0) + 10 * F.col("embedding")[1].cast("double")).alias("lng"))


_PTS = _PTS.replace("embedding[1]", "CAST(embedding[1] AS DOUBLE)").replace("embedding[2]", "CAST(embedding[2] AS DOUBLE)")
_KM = HAV.format(a="a.lat", b="a.lng", c="b.lat", d="b.lng")


@query(f"SELECT a.vec_id AS a, b.vec_id AS b, round({_KM}, 6) AS km FROM ({_PTS}) a JOIN ({_PTS}) b ON a.vec_id < b.vec_id WHERE {_KM} <= 5")
def grid_proximity_pairs(t):
    return joins.proximity_pairs(_points(t), "vec_id", 5).withColumn("km", F.round("km", 6))


@query(f"SELECT q AS vec_id, p AS near_id, round(km, 6) AS km FROM (SELECT a.vec_id AS q, b.vec_id AS p, {_KM} AS km, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_KM}, b.vec_id) AS rk FROM ({_PTS}) a JOIN ({_PTS}) b ON a.vec_id % 2 = 0 AND b.vec_id % 2 = 1) x WHERE rk = 1 AND km <= 25")
def nearest_neighbour(t):
    p = _points(t)
    return joins.nearest(p.filter("vec_id % 2 = 0"), p.filter("vec_id % 2 = 1").withColumnRenamed("vec_id", "near_id"), "vec_id", "near_id", 25).withColumn("km", F.round("km", 6))


_BAND = HAV.format(a="55.0", b="-4.0", c="lat", d="lng")


@query(f"SELECT vec_id, CASE WHEN km <= 10 THEN '10' WHEN km <= 40 THEN '40' ELSE 'far' END AS band, round(km, 6) AS km FROM (SELECT vec_id, {_BAND} AS km FROM ({_PTS}) p) q")
def haversine_bands(t):
    km = geo.haversine_km(F.lit(55.0), F.lit(-4.0), F.col("lat"), F.col("lng"))
    return _points(t).select("vec_id", F.when(km <= 10, "10").when(km <= 40, "40").otherwise("far").alias("band"), F.round(km, 6).alias("km"))


@query(f"SELECT vec_id, CASE WHEN lat BETWEEN 54 AND 55 AND lng BETWEEN -5 AND -4 THEN 'south-west' WHEN lat BETWEEN 54 AND 56 AND lng BETWEEN -5 AND -3 THEN 'middle' ELSE 'elsewhere' END AS nation, CAST(floor(lat / 0.02) AS INTEGER) AS cell FROM ({_PTS}) p")
def nation_boxes(t):
    boxes = [("south-west", (54, -5, 55, -4)), ("middle", (54, -5, 56, -3))]
    return _points(t).select("vec_id", geo.first_box(F.col("lat"), F.col("lng"), boxes, "elsewhere").alias("nation"), geo.cell(F.col("lat"), 0.02).alias("cell"))


@query(f"SELECT vec_id, CASE WHEN abs(lat - 55) + abs(lng + 4) < 0.5 THEN 'inner' WHEN lat > 54 AND lat < 56 AND lng > -5 AND lng < -3 THEN 'outer' END AS name FROM ({_PTS}) p WHERE abs(lat - 55) + abs(lng + 4) < 0.5 OR (lat > 54 AND lat < 56 AND lng > -5 AND lng < -3)")
def smallest_polygon(t):
    ring = lambda *p: F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in p))
    none = F.array().cast("array<array<struct<x:double,y:double>>>")
    one = t("region").limit(1)
    outer = one.select(F.lit("outer").alias("name"), F.array(ring((-5, 54), (-3, 54), (-3, 56), (-5, 56))).alias("outers"), none.alias("inners"), F.lit(4.0).alias("area"))
    inner = one.select(F.lit("inner").alias("name"), F.array(ring((-4.5, 55), (-4, 54.5), (-3.5, 55), (-4, 55.5))).alias("outers"), none.alias("inners"), F.lit(0.5).alias("area"))
    return joins.smallest_polygon(_points(t), outer.unionByName(inner), "vec_id", "name")


@query("SELECT n_nationkey, round(abs(s) / 2, 6) AS area FROM (SELECT n_nationkey, (n_nationkey + 1.0) * 2 + 0 AS s FROM nation) q")
def shoelace_area(t):
    w = F.col("n_nationkey") + 1.0
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    zero = F.lit(0.0)
    return t("nation").select("n_nationkey", F.round(geo.shoelace(F.array(p(zero, zero), p(w, zero), p(w, F.lit(1.0)), p(zero, F.lit(1.0)))), 6).alias("area"))


@query("SELECT s_suppkey, c_custkey, tier FROM (SELECT s_suppkey, c_custkey, tier, row_number() OVER (PARTITION BY s_suppkey ORDER BY n, c_custkey) AS rk FROM (SELECT s_suppkey, c_custkey, 'number' AS tier, 0 AS n FROM supplier JOIN customer ON CAST(substr(s_name, 10) AS INTEGER) = CAST(substr(c_name, 10) AS INTEGER) AND s_nationkey = c_nationkey UNION ALL SELECT s_suppkey, c_custkey, 'nation', 1 FROM supplier JOIN customer ON s_nationkey = c_nationkey WHERE abs(s_acctbal - c_acctbal) <= 500) a) b WHERE rk = 1")
def tiered_match(t):
    s, c = t("supplier"), t("customer")
    number = lambda col: F.expr(f"try_cast(substr({col}, 10) as int)")
    both = lambda side, nation: F.when(side.isNotNull() & F.col(nation).isNotNull(), F.struct(side.alias("number"), F.col(nation).alias("nation")))
    tiers = [("number", both(number("s_name"), "s_nationkey"), both(number("c_name"), "c_nationkey"), None), ("nation", F.col("s_nationkey"), F.col("c_nationkey"), joins.Within(F.col("s_acctbal"), F.col("c_acctbal"), 500))]
    return joins.tiered_match(s, c, "s_suppkey", "c_custkey", tiers)


@query("SELECT n_nationkey, s_suppkey FROM (SELECT s_nationkey AS n_nationkey, s_suppkey, rk, count(*) OVER (PARTITION BY s_nationkey, rk) AS c FROM (SELECT *, rank() OVER (PARTITION BY s_nationkey ORDER BY floor(s_acctbal / 1000)) AS rk FROM supplier) a) b WHERE rk = 1 AND c = 1")
def rank_join_ambiguous(t):
    n = t("nation").select("n_nationkey", F.col("n_nationkey").alias("k"))
    s = t("supplier").select("s_suppkey", F.col("s_nationkey").alias("k"), F.floor(F.col("s_acctbal") / 1000).alias("rk"))
    return joins.rank_match(n, s, "k", "n_nationkey", "s_suppkey", "rk")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
def missing_anti(t):
    return joins.missing(t("customer").select("c_custkey"), t("orders").filter("o_totalprice > 250000").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("SELECT o_orderkey, c_name, n_name, r_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def lookup_enrich(t):
    o = t("orders").select("o_orderkey", "o_custkey")
    c = t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_nationkey")
    places = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "r_name")
    return o.join(c, "o_custkey", "left").join(places, "c_nationkey", "left").select("o_orderkey", "c_name", "n_name", "r_name")


@query("SELECT a.p_partkey AS a, b.p_partkey AS b, CAST(levenshtein(a.p_name, b.p_name) AS INTEGER) AS distance FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey WHERE levenshtein(a.p_name, b.p_name) <= 2")
def edit_distance_match(t):
    p = t("part").select("p_partkey", "p_name", "p_brand", "p_size")
    return joins.near_spellings(p, ["p_brand", "p_size"], "p_partkey", "p_name", 2)


_TOK = "list_distinct(list_filter(string_split(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> ''))"


@query(f"SELECT a.p_partkey AS a, b.p_partkey AS b, round(len(list_intersect(a.tk, b.tk)) / len(list_distinct(a.tk || b.tk)), 6) AS score FROM (SELECT p_partkey, p_brand, p_size, {_TOK} AS tk FROM part) a JOIN (SELECT p_partkey, p_brand, p_size, {_TOK} AS tk FROM part) b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey WHERE len(list_intersect(a.tk, b.tk)) > 0")
def token_jaccard(t):
    p = t("part").select("p_partkey", "p_brand", "p_size", text.tokens(text.search_norm(F.col("p_name"))).alias("tk"))
    return joins.token_pairs(p, ["p_brand", "p_size"], "p_partkey", "tk").withColumn("score", F.round("score", 6))


def _names(t):
    names = t("part").select(F.col("p_partkey").alias("name_id"), F.col("p_name").alias("name"))
    one = t("region").limit(1)
    return names.unionByName(one.select(F.lit(-1).cast("long").alias("name_id"), F.lit("en la").alias("name"))).unionByName(one.select(F.lit(-2).cast("long").alias("name_id"), F.lit("the of").alias("name")))


@query("WITH x AS (SELECT conv_id * 1000 + turn AS text_id, ' ' || trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', ' ', 'g')) || ' ' AS s FROM conversations), w AS (SELECT DISTINCT lower(p_name) AS nm FROM part), v AS (SELECT n, min(name_id) AS name_id FROM (SELECT trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS n, p_partkey AS name_id FROM part UNION ALL SELECT 'en la', -1 UNION ALL SELECT 'the of', -2) q WHERE length(n) >= 5 GROUP BY n) SELECT text_id, name_id FROM (SELECT text_id, name_id, row_number() OVER (PARTITION BY text_id ORDER BY length(n) DESC, name_id) AS rk FROM x JOIN v ON contains(s, ' ' || n || ' ')) q WHERE rk = 1")
def substring_join(t):
    texts = t("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("text_id"), "text")
    return joins.contained_name(texts, _names(t), "text_id", "text", "name_id", "name")


@query()
def substring_join_documents(t):
    """Names in every document's whole text; ``substring_join`` has the turns of conversations."""
    return joins.contained_name(t("documents").select("doc_id", "text"), _names(t), "doc_id", "text", "name_id", "name")


@query("SELECT coalesce(a.p_brand, b.p_brand) AS p_brand, a.v AS \"old\", b.v AS \"new\" FROM (SELECT p_brand, round(avg(p_retailprice), 4) AS v FROM part WHERE p_size <= 25 GROUP BY 1) a FULL JOIN (SELECT p_brand, round(avg(p_retailprice), 4) AS v FROM part WHERE p_size > 25 GROUP BY 1) b ON a.p_brand = b.p_brand WHERE a.v IS NULL OR b.v IS NULL OR (abs(b.v - a.v) >= 0.01 * abs(a.v) AND a.v <> b.v)")
def changed_metrics(t):
    mean = lambda c: t("part").filter(c).groupBy("p_brand").agg(F.round(F.avg("p_retailprice"), 4).alias("v"))
    return joins.changed(mean("p_size <= 25"), mean("p_size > 25"), "p_brand", "v", 0.01)


@query("SELECT alias, p_partkey FROM (SELECT alias, p_partkey, row_number() OVER (PARTITION BY alias ORDER BY p_partkey, p) AS rk FROM (SELECT p_name AS alias, p_partkey, 0 AS p FROM part UNION ALL SELECT p_brand, p_partkey, 1 FROM part) a) b WHERE rk = 1")
def alias_index(t):
    return joins.alias_index(t("part"), "p_partkey", [F.col("p_name"), F.col("p_brand")], "p_partkey")


_EDGES = "SELECT DISTINCT l_suppkey AS u, l_partkey + 1000000 AS v FROM lineitem"


@query(
    f"""WITH RECURSIVE e AS MATERIALIZED (SELECT u, v FROM ({_EDGES}) x UNION ALL SELECT v, u FROM ({_EDGES}) y), cc(node, component) USING KEY (node) AS (SELECT DISTINCT u, u FROM e
 UNION (SELECT e.u, min(cc.component) FROM cc JOIN e ON cc.node = e.v JOIN recurring.cc AS r ON r.node = e.u WHERE cc.component < r.component GROUP BY e.u)) SELECT node, component FROM cc"""
)
def components(t):
    return graph.components(t("lineitem").select(F.col("l_suppkey").alias("u"), (F.col("l_partkey") + 1_000_000).alias("v")))


@query()
def components_all_edges(t):
    """Components over every lineitem row, as ``components``, without SQL."""
    return graph.components(t("lineitem").select(F.col("l_suppkey").alias("u"), (F.col("l_partkey") + 1_000_000).alias("v")))


_FERRY = "SELECT n_nationkey AS src, (n_nationkey * 7 + 3) % 25 AS dst, 10.0 + n_nationkey AS w FROM nation UNION ALL SELECT n_nationkey, (n_nationkey + 1) % 25, 120.0 FROM nation WHERE n_nationkey % 3 = 0"


@query(f"WITH RECURSIVE f AS (SELECT src, dst, w FROM ({_FERRY}) x WHERE src <> dst UNION ALL SELECT dst, src, w FROM ({_FERRY}) y WHERE src <> dst), p(node, total, seen, hops) AS (SELECT 0, CAST(0.0 AS DOUBLE), [0], 0 UNION ALL SELECT f.dst, p.total + CAST(f.w AS DOUBLE), list_append(p.seen, f.dst), p.hops + 1 FROM p JOIN f ON p.node = f.src WHERE NOT list_contains(p.seen, f.dst) AND p.hops < 8) SELECT CAST(node AS INTEGER) AS node, min(total) AS total FROM p GROUP BY node")
def shortest_path(t):
    n = t("nation")
    a = n.select(F.col("n_nationkey").alias("src"), ((F.col("n_nationkey") * 7 + 3) % 25).alias("dst"), (F.lit(10.0) + F.col("n_nationkey")).alias("w"))
    b = n.filter("n_nationkey % 3 = 0").select(F.col("n_nationkey").alias("src"), ((F.col("n_nationkey") + 1) % 25).alias("dst"), F.lit(None).cast("double").alias("w"))
    return graph.shortest_paths(graph.undirected(a.unionByName(b)), 0).select("node", "total")


@query("SELECT 'c' || c_custkey AS node, 'r' || n_regionkey AS root, 2 AS depth FROM customer JOIN nation ON c_nationkey = n_nationkey")
def hierarchy_climb(t):
    c = t("customer").select(F.concat(F.lit("c"), "c_custkey").alias("child"), F.concat(F.lit("n"), "c_nationkey").alias("parent"))
    n = t("nation").select(F.concat(F.lit("n"), "n_nationkey").alias("child"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    return graph.climb(c.unionByName(n), c.select(F.col("child").alias("node")), t("region").select(F.concat(F.lit("r"), "r_regionkey").alias("node")))


@query("SELECT doc_id, lang, coalesce(CASE WHEN doc_id % 3 <> 0 THEN quality END, 9) AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def fill_blanks(t):
    d = t("documents").select("doc_id", "lang", F.lit(None).cast("int").alias("quality"))
    staged = t("labels").filter("doc_id % 3 <> 0").select("doc_id", F.col("quality").cast("int").alias("quality"))
    filled = merge.fill_blanks(d, staged, "doc_id")
    return filled.withColumn("quality", F.coalesce("quality", F.lit(9)))


@query("SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, coalesce(b.seg, a.seg) AS seg FROM (SELECT c_custkey, c_mktsegment AS seg FROM customer WHERE c_custkey % 3 <> 0) a FULL JOIN (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'new' END AS seg FROM customer WHERE c_custkey % 2 = 0) b ON a.c_custkey = b.c_custkey")
def later_wins(t):
    old = t("customer").filter("c_custkey % 3 <> 0").select("c_custkey", F.col("c_mktsegment").alias("seg"))
    new = t("customer").filter("c_custkey % 2 = 0").select("c_custkey", F.when(F.col("c_acctbal") > 0, "new").alias("seg"))
    return merge.later_wins(old, new, "c_custkey")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 AND NOT year(o_orderdate) > 1995 THEN o_totalprice * 2 ELSE o_totalprice END AS price, CAST(CASE WHEN o_orderkey % 2 = 0 AND NOT year(o_orderdate) > 1995 THEN 1995 ELSE year(o_orderdate) END AS INTEGER) AS yr FROM orders")
def newer_guard(t):
    now = t("orders").select("o_orderkey", F.col("o_totalprice").alias("price"), F.year("o_orderdate").alias("yr"))
    staged = t("orders").filter("o_orderkey % 2 = 0").select("o_orderkey", (F.col("o_totalprice") * 2).alias("price"), F.lit(1995).alias("yr"))
    return merge.newer_guard(now, staged, "o_orderkey", ["price"], "yr")


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 AND c_custkey % 20 <> 0 THEN 'sea' ELSE 'lake' END AS type FROM customer")
def manual_overrides(t):
    df = t("customer").select("c_custkey", F.lit("lake").alias("type"))
    manual = t("customer").filter("c_custkey % 10 = 0").select("c_custkey", F.when(F.col("c_custkey") % 20 == 0, "moon").otherwise("sea").alias("type"), F.lit("m").alias("source"), F.lit("high").alias("confidence"))
    return merge.overrides(df, manual, "c_custkey", ["sea", "lake", "river"])[0].select("c_custkey", "type")


@query("SELECT l_orderkey, l_linenumber, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS rk FROM lineitem) q WHERE rk = 1")
def best_staged(t):
    return merge.best_staged(t("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"), "l_orderkey", "l_extendedprice", ["l_linenumber"]).drop("l_extendedprice")
