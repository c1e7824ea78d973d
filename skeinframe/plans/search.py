"""Search, ranking and selection queries over the star tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import agg, filters, scores, topk
from .registry import query

SEARCH_SCORE_SQL = """CASE WHEN nm = 'blue' THEN 1000 WHEN starts_with(nm, 'blue') THEN 800 - length(nm) WHEN contains(nm, ' blue') THEN 600 - length(nm) WHEN strpos(nm, 'blue') > 0 THEN 401 - strpos(nm, 'blue')
 WHEN regexp_matches(nm, '^.*b.*l.*u.*e') THEN 200 - (length(regexp_extract(nm, '^[^b]*b([^l]*)l', 1)) + length(regexp_extract(nm, '^[^b]*b[^l]*l([^u]*)u', 1)) + length(regexp_extract(nm, '^[^b]*b[^l]*l[^u]*u([^e]*)e', 1))) - (length(nm) - 4)
 WHEN contains(hay, 'blue') THEN 50 END"""


def _parts(t):
    return t("part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice", text.search_norm(F.col("p_name")).alias("nm"), text.search_norm(F.concat_ws(" ", "p_brand", "p_type")).alias("hay"))


_PARTS_SQL = "SELECT *, trim(regexp_replace(lower(strip_accents(p_name)), '[^a-z0-9]+', ' ', 'g')) AS nm, trim(regexp_replace(lower(p_brand || ' ' || p_type), '[^a-z0-9]+', ' ', 'g')) AS hay FROM part"


@query(f"SELECT * FROM (SELECT p_partkey, p_name, {SEARCH_SCORE_SQL} AS score FROM ({_PARTS_SQL}) p WHERE p_size >= 10) q WHERE score IS NOT NULL ORDER BY score DESC, p_name, p_partkey LIMIT 24")
def facet_search(t):
    hits = _parts(t).filter("p_size >= 10").withColumn("score", scores.search_score(F.col("nm"), F.col("hay"), "blue")).filter("score is not null")
    return topk.top(hits.select("p_partkey", "p_name", "score"), [F.desc("score"), F.col("p_name"), F.col("p_partkey")], 24)


@query(f"SELECT p_partkey, {SEARCH_SCORE_SQL} AS score FROM ({_PARTS_SQL}) p WHERE {SEARCH_SCORE_SQL} IS NOT NULL")
def search_scores(t):
    return _parts(t).select("p_partkey", scores.search_score(F.col("nm"), F.col("hay"), "blue").alias("score")).filter("score is not null")


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_6' AND c_acctbal >= 1000 AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')")
def facet_filter(t):
    place = t("customer").join(t("nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey")).withColumns({"id": F.col("c_custkey"), "nation": F.col("n_name"), "area": F.col("c_acctbal")})
    open_orders = t("orders").filter("o_orderstatus = 'O'").select(F.col("o_custkey").alias("id"))
    return filters.Facets(nation="NATION_6", min_area=1000, id_sets=[open_orders]).apply(place).select("c_custkey", "c_name", "c_mktsegment")


@query("SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'inhabited' ELSE 'uninhabited' END AS kind FROM customer WHERE (c_acctbal > 0 OR coalesce(c_acctbal, 0) <= 0)")
def inhabited_split(t):
    c = t("customer").withColumn("population", F.col("c_acctbal"))
    yes = filters.Facets(inhabited=True).apply(c).select("c_custkey", F.lit("inhabited").alias("kind"))
    return yes.unionByName(filters.Facets(inhabited=False).apply(c).select("c_custkey", F.lit("uninhabited").alias("kind")))


@query(f"SELECT * FROM (SELECT p_partkey, p_name, p_size, row_number() OVER (PARTITION BY lower(trim(p_name)) ORDER BY p_retailprice DESC, p_partkey) AS rn, p_retailprice FROM part) q WHERE rn = 1 OR trim(p_name) = '' ORDER BY p_retailprice DESC, p_partkey LIMIT 24".replace("SELECT * FROM", "SELECT p_partkey, p_name, p_size, p_retailprice FROM", 1))
def capped_unique_names(t):
    p = t("part").select("p_partkey", "p_name", "p_size", "p_retailprice")
    return topk.unique_names(p, "p_name", [F.desc("p_retailprice"), F.col("p_partkey")], 24)


_CUT = f"SELECT p_partkey, {SEARCH_SCORE_SQL} AS score FROM ({_PARTS_SQL}) p WHERE {SEARCH_SCORE_SQL} IS NOT NULL"


@query(f"SELECT p_partkey, score FROM (SELECT *, max(score) OVER () AS top FROM ({_CUT}) a) b WHERE score >= greatest(7, 0.65 * top) AND (top - score <= 7 OR score = top) ORDER BY score DESC, p_partkey LIMIT 24")
def relevance_cutoff(t):
    return topk.relevance_cutoff(search_scores(t), "score", [F.desc("score"), F.col("p_partkey")], 7, 0.65, 7, 24)


@query("SELECT p_brand, p_partkey, p_name FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_size > 25 THEN 1 ELSE 0 END DESC, CASE WHEN p_type LIKE '%STEEL%' THEN 1 ELSE 0 END DESC, p_retailprice DESC, p_partkey DESC) AS rn FROM part) q WHERE rn = 1")
def keeper_per_group(t):
    p = t("part")
    return topk.keeper(p, ["p_brand"], [(F.col("p_size") > 25).cast("int"), F.col("p_type").like("%STEEL%").cast("int"), F.col("p_retailprice")], "p_partkey").select("p_brand", "p_partkey", "p_name")


@query("SELECT c_custkey, tier, c_acctbal FROM (SELECT *, CASE WHEN c_mktsegment = 'BUILDING' THEN 0 WHEN c_mktsegment = 'AUTOMOBILE' THEN 1 ELSE 2 END AS tier FROM customer) q ORDER BY tier, c_acctbal DESC, c_custkey LIMIT 800")
def priority_queue(t):
    tier = agg.buckets((F.col("c_mktsegment") == "BUILDING").cast("int") * 2 + (F.col("c_mktsegment") == "AUTOMOBILE").cast("int"), [(2, "0"), (1, "1")], "2").cast("int")
    return topk.top(t("customer").select("c_custkey", tier.alias("tier"), "c_acctbal"), [F.col("tier"), F.desc("c_acctbal"), F.col("c_custkey")], 800)


@query("SELECT o_custkey, o_orderkey, CAST(rk AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rk FROM orders) q WHERE rk <= 3")
def best_per_group(t):
    return topk.per_group(t("orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", "rank")


@query("SELECT n_nationkey, other, CAST(row_number() OVER (PARTITION BY n_nationkey ORDER BY n2) AS INTEGER) AS rank FROM (SELECT a.n_nationkey, b.n_nationkey AS other, b.n_name AS n2, row_number() OVER (PARTITION BY a.n_nationkey ORDER BY b.n_name, b.n_nationkey) AS rk FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey) q WHERE rk <= 3")
def related_places(t):
    return topk.related(t("nation").select("n_regionkey", "n_nationkey", "n_name"), "n_regionkey", "n_nationkey", [F.col("n_name"), F.col("n_nationkey")], 3)


@query("SELECT s_suppkey, CASE WHEN row_number() OVER (PARTITION BY s_nationkey, sl ORDER BY s_suppkey) = 1 THEN sl ELSE sl || '-' || s_suppkey END AS path FROM (SELECT *, 'area-' || CAST(floor(s_acctbal / 1000) AS BIGINT) AS sl FROM supplier) q")
def unique_paths(t):
    s = t("supplier").select("s_suppkey", "s_nationkey", F.concat(F.lit("area-"), F.floor(F.col("s_acctbal") / 1000).cast("string")).alias("slug"))
    return topk.unique_slugs(s, "s_nationkey", "slug", [], "s_suppkey").select("s_suppkey", "path")


@query("SELECT p_partkey, CASE WHEN starts_with(nm, 'blue') OR starts_with('blue', nm) THEN 50 + least(length(nm), 4) ELSE 20 + least(length(nm), 4) END + least(5.0, log10(1 + CAST(p_size AS DOUBLE))) AS score FROM (SELECT *, trim(lower(p_name)) AS nm FROM part) q WHERE nm <> 'blue' AND (contains(nm, 'blue') OR contains('blue', nm))")
def name_lookup(t):
    s = scores.bare_name_score(scores.bare_name(F.col("p_name")), "blue", F.col("p_size"), F.lit(None))
    return t("part").select("p_partkey", s.alias("score")).filter("score is not null")


@query("SELECT p_partkey, score FROM (SELECT p_partkey, 1 + CASE WHEN h1 + h2 = 2 THEN 42 WHEN h1 + h2 > 0 THEN 18 ELSE 0 END + CASE WHEN w1 + w2 = 2 THEN 28 WHEN w1 + w2 > 0 THEN 10 ELSE 0 END AS score, h1, h2, w1, w2 FROM (SELECT p_partkey, CAST(contains(lower(p_name), 'blue') AS INT) AS h1, CAST(contains(lower(p_name), 'small') AS INT) AS h2, CAST(contains(lower(p_type), 'blue') AS INT) AS w1, CAST(contains(lower(p_type), 'small') AS INT) AS w2 FROM part) a) b WHERE (h1 > 0 OR w1 > 0) AND (h2 > 0 OR w2 > 0)")
def tool_token_score(t):
    no = F.lit("")
    s = scores.token_score(text.fold(F.col("p_name")), text.fold(F.col("p_type")), no, no, no, ["blue", "small"])
    return t("part").select("p_partkey", s.alias("score")).filter("score is not null")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 5 THEN 'too few' WHEN l_discount > 0.08 THEN 'discounted' WHEN l_returnflag = 'R' THEN 'returned' WHEN l_tax > 0.07 THEN 'taxed' ELSE 'ok' END AS reason FROM lineitem")
def accept_reject_reason(t):
    rules = [("too few", F.col("l_quantity") < 5), ("discounted", F.col("l_discount") > 0.08), ("returned", F.col("l_returnflag") == "R"), ("taxed", F.col("l_tax") > 0.07)]
    return t("lineitem").select("l_orderkey", "l_linenumber", filters.first_reason(rules, "ok").alias("reason"))


@query("SELECT o_orderkey, 'price' AS rule FROM orders WHERE NOT o_totalprice < 300000 UNION ALL SELECT o_orderkey, 'priority' FROM orders WHERE NOT regexp_matches(o_orderpriority, '^[1-4]') UNION ALL SELECT o_orderkey, 'status' FROM orders WHERE NOT o_orderstatus IN ('O', 'F')")
def constraint_violations(t):
    return filters.violations(t("orders"), "o_orderkey", [("price", F.col("o_totalprice") < 300000), ("priority", F.col("o_orderpriority").rlike("^[1-4]")), ("status", F.col("o_orderstatus").isin("O", "F"))])


@query("SELECT p_partkey, CAST(CASE WHEN p_size > 40 THEN 20 ELSE 0 END + CASE WHEN p_type LIKE '%BRASS%' THEN 5 ELSE 0 END + CASE WHEN p_retailprice > 1000 THEN 3 ELSE 0 END AS DOUBLE) AS score FROM part")
def quality_metrics(t):
    return t("part").select("p_partkey", F.round(scores.quality([(F.col("p_size") > 40, 20), (F.col("p_type").like("%BRASS%"), 5), (F.col("p_retailprice") > 1000, 3)]), 1).alias("score"))


@query("SELECT s_suppkey, round(CAST(CASE WHEN s_acctbal > 8000 THEN -50 ELSE 0 END AS DOUBLE) + a + CAST(0.08 AS DOUBLE) * b + CAST(CASE WHEN s_nationkey % 2 = 0 THEN 3 ELSE -3 END AS DOUBLE), 8) AS score FROM (SELECT *, greatest(x, y) AS a, least(x, y) AS b FROM (SELECT *, least(greatest(s_acctbal / 200, 0), 48) / 48 * 18 AS x, least(greatest(s_acctbal / 300, 0), 24) / 24 * 18 AS y FROM supplier) q) r")
def atlas_scores(t):
    shares = F.array(scores.interest_share(F.lit("unusual-news"), F.col("s_acctbal") / 200), scores.interest_share(F.lit("island-books"), F.col("s_acctbal") / 300))
    return t("supplier").select("s_suppkey", F.round(scores.atlas_score(F.col("s_acctbal"), shares, F.col("s_nationkey") % 2 == 0, F.lit(False)), 8).alias("score"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN 90 WHEN l_returnflag = 'N' THEN 70 ELSE 60 END + CASE WHEN l_linestatus = 'O' THEN 5 ELSE 0 END + CASE WHEN l_discount > 0.05 THEN 10 ELSE 0 END + CASE WHEN l_quantity <= 5 THEN 5 WHEN l_quantity > 45 THEN -15 ELSE 0 END AS score FROM lineitem")
def staged_name_scores(t):
    conf = F.when(F.col("l_returnflag") == "A", "high").when(F.col("l_returnflag") == "N", "medium").otherwise("?")
    s = scores.staged_name_score(conf, F.when(F.col("l_linestatus") == "O", "A").otherwise("B"), F.col("l_discount") > 0.05, F.when(F.col("l_quantity") <= 5, 10).when(F.col("l_quantity") > 45, 400).otherwise(100))
    return t("lineitem").select("l_orderkey", "l_linenumber", s.alias("score"))


@query("SELECT o_orderkey, CASE WHEN abs(a - b) / greatest(a, b) <= 0.1 THEN 'high' WHEN a / b BETWEEN 70 AND 150 OR a / b BETWEEN 1 / 150.0 AND 1 / 70.0 THEN 'unit: hectares' WHEN a / b BETWEEN 1e5 AND 1e7 OR a / b BETWEEN 1e-7 AND 1e-5 THEN 'unit: square metres' WHEN a / b BETWEEN 200 AND 400 OR a / b BETWEEN 1 / 400.0 AND 1 / 200.0 THEN 'unit: acres' WHEN abs(a - b) / greatest(a, b) <= 0.3 THEN 'medium' ELSE 'low' END AS confidence FROM (SELECT o_orderkey, o_totalprice AS a, o_totalprice * (1 + o_orderkey % 7 / 10.0) * CASE WHEN o_orderkey % 11 = 0 THEN 100 ELSE 1 END AS b FROM orders) q")
def second_source_confidence(t):
    a = F.col("o_totalprice")
    b = a * (1 + F.col("o_orderkey") % 7 / 10.0) * F.when(F.col("o_orderkey") % 11 == 0, 100).otherwise(1)
    return t("orders").select("o_orderkey", scores.second_source(a, b).alias("confidence"))


@query("SELECT doc_id, CASE WHEN regexp_matches(lower(text), '\\b(the|and)\\b') THEN 'english' WHEN regexp_matches(lower(text), '\\b(der|die|und)\\b') THEN 'german' ELSE 'other' END AS label FROM (SELECT doc_id, strip_accents(text) AS text FROM documents) q")
def keyword_label(t):
    return t("documents").select("doc_id", text.classify(F.col("text"), [(r"\b(the|and)\b", "english"), (r"\b(der|die|und)\b", "german")], "other").alias("label"))


@query("SELECT doc_id, n_chars, running FROM (SELECT doc_id, n_chars, CAST(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS running FROM documents) q WHERE running <= 14000")
def budget_pack(t):
    return agg.within_budget(t("documents").select("doc_id", "n_chars", "source"), "source", "doc_id", "n_chars", 14000).select("doc_id", "n_chars", "running")
