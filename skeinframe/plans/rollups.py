"""Aggregation queries over the star tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import agg, topk
from .registry import query


@query("WITH g AS (SELECT n_name AS grp, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, grp) AS rk FROM g) SELECT CASE WHEN rk <= 12 THEN grp ELSE 'other' END AS grp, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1")
def group_count_other(t):
    s = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return agg.groups_and_other(s, F.col("n_name"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 5")
def superlative_top5(t):
    return topk.top(t("orders").filter("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 5)


@query("SELECT c_mktsegment, round(sum(c_acctbal) FILTER (WHERE c_acctbal > 0), 2) AS total, count(*) FILTER (WHERE c_acctbal > 0) AS n FROM customer GROUP BY c_mktsegment")
def totals_positive(t):
    good = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))
    return t("customer").groupBy("c_mktsegment").agg(F.round(F.sum(good), 2).alias("total"), F.count(good).alias("n"))


_KPI = "count(*) FILTER (WHERE q) AS completed, count(*) FILTER (WHERE q AND toxic IS NOT NULL) AS citation_scored, count(*) FILTER (WHERE q AND quality IS NOT NULL) AS accuracy_scored, CASE WHEN count(*) FILTER (WHERE q AND toxic IS NOT NULL) > 0 THEN count(*) FILTER (WHERE q AND toxic = 1) END AS cited"


@query(f"SELECT lang, {_KPI}, round(count(*) FILTER (WHERE q AND toxic = 1) / nullif(count(*) FILTER (WHERE q AND toxic IS NOT NULL), 0), 4) AS citation_rate, round(count(*) FILTER (WHERE q AND quality = 1) / nullif(count(*) FILTER (WHERE q AND quality IS NOT NULL), 0), 4) AS accuracy_rate, round(count(*) FILTER (WHERE q AND toxic = 1 AND n_chars > 1000) / nullif(count(*) FILTER (WHERE q AND toxic = 1), 0), 4) AS canonical_share FROM (SELECT *, n_chars > 500 AS q FROM documents LEFT JOIN labels USING (doc_id)) x GROUP BY lang")
def kpi_rollup(t):
    d = t("documents").drop("text").join(t("labels"), "doc_id", "left")
    return agg.kpi_rollup(d, ["lang"], F.col("n_chars") > 500, F.col("toxic") == 1, F.col("quality") == 1, F.col("n_chars") > 1000)


@query("WITH s AS (SELECT doc_id, 40 * CAST(n_chars > 1000 AS INT) + 30 * CAST(quality IS NOT NULL AS INT) + 15 * CAST(lang = 'en' AS INT) + 10 * CAST(source <> 'src0' AS INT) + 5 AS score FROM documents LEFT JOIN labels USING (doc_id)) SELECT CASE WHEN score >= 100 THEN '100' WHEN score >= 70 THEN '70-99' WHEN score >= 40 THEN '40-69' ELSE '0-39' END AS bucket, count(*) AS n, round(avg(score), 1) AS mean FROM s GROUP BY 1")
def coverage_buckets(t):
    d = t("documents").drop("text").join(t("labels"), "doc_id", "left")
    score, _ = agg.completeness([("description", F.col("n_chars") > 1000, 40), ("photo", F.col("quality").isNotNull(), 30), ("same as", F.col("lang") == "en", 15), ("point", F.col("source") != "src0", 10), ("nation", F.lit(True), 5)])
    b = agg.buckets(F.col("score"), [(100, "100"), (70, "70-99"), (40, "40-69")], "0-39")
    return d.withColumn("score", score).groupBy(b.alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg("score"), 1).alias("mean"))


@query("SELECT gap, count(*) AS n FROM (SELECT unnest([CASE WHEN NOT n_chars > 1000 THEN 'description' END, CASE WHEN quality IS NULL THEN 'photo' END]) AS gap FROM documents LEFT JOIN labels USING (doc_id)) x WHERE gap IS NOT NULL GROUP BY gap")
def gap_counts(t):
    d = t("documents").drop("text").join(t("labels"), "doc_id", "left")
    _, gaps = agg.completeness([("description", F.col("n_chars") > 1000, 40), ("photo", F.col("quality").isNotNull(), 30)])
    return d.select(F.explode(gaps).alias("gap")).groupBy("gap").agg(F.count("*").alias("n"))


@query('SELECT l_returnflag AS "before", l_linestatus AS "after", count(*) AS n FROM lineitem GROUP BY 1, 2')
def transition_matrix(t):
    return agg.transitions(t("lineitem"), F.col("l_returnflag"), F.col("l_linestatus"))


@query("SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY user_id")
def first_last_seen(t):
    e = t("events").select("user_id", "ts")
    old = e.filter("user_id % 2 = 0").groupBy("user_id").agg(F.min("ts").alias("first_seen"), F.min("ts").alias("last_seen"))
    return topk.first_last_seen(old, e, "user_id", "ts")


@query("WITH tr AS (SELECT user_id AS route, event_id // 20 AS trip, CAST(dayofweek(ts) AS VARCHAR) AS weekday, event_id AS seq, event_type AS stop, CAST(hour(ts) * 60 + minute(ts) AS INTEGER) AS minutes FROM events), ab AS (SELECT route, trip, weekday, arg_min(stop, seq) AS origin, arg_max(stop, seq) AS destination, arg_min(minutes, seq) AS dep, arg_max(minutes, seq) AS arr, count(*) AS n FROM tr GROUP BY route, trip, weekday HAVING count(*) > 1), d AS (SELECT *, (arr - dep + 1440) % 1440 AS took FROM ab), u AS (SELECT DISTINCT route, origin, destination, weekday, dep FROM d), l AS (SELECT route, origin, destination, weekday, string_agg(printf('%02d:%02d', dep // 60, dep % 60), ' ' ORDER BY dep) AS departures FROM u GROUP BY 1, 2, 3, 4), m AS (SELECT route, origin, destination, weekday, CAST(round_even(avg(took), 0) AS INTEGER) AS minutes FROM d GROUP BY 1, 2, 3, 4) SELECT l.route, l.origin, l.destination, l.weekday, departures, minutes FROM l JOIN m ON l.route = m.route AND l.origin = m.origin AND l.destination = m.destination AND l.weekday = m.weekday")
def timetable(t):
    e = t("events").select(F.col("user_id").alias("route"), F.floor(F.col("event_id") / 20).alias("trip"), (F.dayofweek("ts") - 1).cast("string").alias("weekday"), F.col("event_id").alias("seq"), F.col("event_type").alias("stop"), (F.hour("ts") * 60 + F.minute("ts")).alias("minutes"))
    return agg.timetable(e)


@query("SELECT lang, CAST(doc_id % 50 AS BIGINT) AS island, string_agg(DISTINCT source, '|' ORDER BY source) AS sources, count(DISTINCT source) AS n_sources, min(CAST(n_chars AS DOUBLE)) AS distance, arg_min(doc_id, n_chars * 1000000 + doc_id) AS best FROM documents GROUP BY lang, doc_id % 50 HAVING count(DISTINCT source) >= 2 AND max(n_chars) - min(n_chars) <= 2000")
def agreement(t):
    d = t("documents").select("lang", (F.col("doc_id") % 50).alias("island"), "source", F.col("n_chars").cast("double").alias("distance"), F.lit("high").alias("confidence"), F.col("doc_id").alias("best"))
    first = d.groupBy("lang", "island").agg(F.min(F.struct("distance", "best")).alias("m")).select("lang", "island", F.col("m.best").alias("lead"))
    found = agg.agreement(d, ["lang", "island"], "source", "distance", "confidence", "best", 2, 2000.0)
    return found.drop("best").join(first, ["lang", "island"]).withColumnRenamed("lead", "best")


@query("SELECT conv_id, string_agg(role, ',' ORDER BY fst) AS roles FROM (SELECT conv_id, role, min(turn) AS fst FROM conversations GROUP BY conv_id, role) q GROUP BY conv_id")
def ordered_agg(t):
    return agg.ordered_distinct(t("conversations"), ["conv_id"], "turn", "role", "roles").select("conv_id", F.array_join("roles", ",").alias("roles"))


@query("SELECT source, lang, votes FROM (SELECT source, lang, count(*) AS votes, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, min(doc_id)) AS rk FROM documents GROUP BY source, lang) q WHERE rk = 1 AND votes >= 3")
def title_consensus(t):
    return agg.consensus(t("documents").select("source", "lang", "doc_id"), ["source"], "lang", "doc_id", 3)


@query("SELECT o_custkey, CASE WHEN bool_and(o_orderstatus = 'F') THEN 'high' ELSE 'medium' END AS confidence FROM orders GROUP BY o_custkey")
def worst_confidence(t):
    return agg.worst(t("orders").select("o_custkey", F.when(F.col("o_orderstatus") == "F", "high").otherwise("low").alias("confidence")), ["o_custkey"], "confidence")


@query("SELECT event_type, CASE WHEN value <= 10 THEN '<=10' WHEN value <= 50 THEN '<=50' ELSE '>50' END AS band, count(*) AS n FROM events GROUP BY 1, 2")
def proximity_histogram(t):
    band = F.when(F.col("value") <= 10, "<=10").when(F.col("value") <= 50, "<=50").otherwise(">50")
    return t("events").groupBy("event_type", band.alias("band")).agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN a AND b THEN 'both' WHEN a THEN 'first' WHEN b THEN 'second' ELSE 'neither' END AS verdict, count(*) AS n FROM (SELECT l_discount > 0.05 AS a, l_quantity > 25 AS b FROM lineitem) q GROUP BY 1")
def yield_simulation(t):
    a, b = F.col("l_discount") > 0.05, F.col("l_quantity") > 25
    verdict = F.when(a & b, "both").when(a, "first").when(b, "second").otherwise("neither")
    return t("lineitem").groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))
