"""Event and text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parse, text
from ..streaming import state
from .registry import query


@query("SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER w AS b, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) q WHERE n = 1 OR event_type IS DISTINCT FROM b")
def consecutive_dedupe(t):
    return state.without_repeats(t("events"), "user_id", "event_type", [F.col("ts"), F.col("event_id")]).select("event_id", "user_id", "event_type")


@query("WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS u, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), r(user_id, i, event_id, opened, n) AS (SELECT user_id, i, event_id, u, 1 FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.i, e.event_id, CASE WHEN r.opened + 86400000000 < e.u THEN e.u ELSE r.opened END, CASE WHEN r.opened + 86400000000 < e.u THEN 1 ELSE r.n + 1 END FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1) SELECT event_id, n <= 3 AS allowed FROM r")
def rate_limit_first_event_window(t):
    return state.rate_limited(t("events").select("event_id", "user_id", "ts"), "user_id", "ts", "event_id", 3, 86_400).select("event_id", "allowed")


@query("SELECT user_id, event_type, CAST(row_number() OVER (PARTITION BY user_id ORDER BY mt DESC, me DESC) AS INTEGER) AS place FROM (SELECT user_id, event_type, max(ts) AS mt, arg_max(event_id, ts) AS me FROM events GROUP BY 1, 2) q QUALIFY place <= 3")
def recent_lru(t):
    return state.recent(t("events"), "user_id", "event_type", "ts", "event_id", 3)


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rk FROM events) q WHERE rk = 1")
def latest_per_user(t):
    return state.latest(t("events").select("user_id", "event_id", "event_type", "ts"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


@query("SELECT CAST(time_bucket(INTERVAL '1 day', ts) AS TIMESTAMP) AS opened, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_counts(t):
    return state.windowed_counts(t("events"), "ts", "event_type", window="1 day").select(F.col("window.start").alias("opened"), "event_type", "n")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(t):
    return t("events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


_TEXT = r"regexp_replace(html, '(?is)<(script|style)\b.*?</(?:script|style)>|(?s:<!--.*?-->)', ' ', 'g')"
for _entity, _value in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
    _TEXT = f"replace({_TEXT if _entity != '&nbsp;' else f'regexp_replace({_TEXT}, $$(?s)<[^>]*>$$, $$ $$, $$g$$)'}, '{_entity}', '{_value}')"


@query(f"SELECT page_id, trim(regexp_replace({_TEXT}, '\\s+', ' ', 'g')) AS body FROM pages")
def html_text(t):
    return t("pages").select("page_id", text.strip_html(F.col("html")).alias("body"))


@query("SELECT page_id, lower(regexp_extract(url, '^https?://(?:www\\.)?([^/?#:]+)', 1)) AS host, regexp_matches(url, '^https://tionsh[.]example[.]net/(?:[a-z0-9-]+/)*[a-z0-9-]*$') AS canonical FROM pages")
def url_parts(t):
    return t("pages").select("page_id", text.url_host(F.col("url")).alias("host"), text.canonical_url(F.col("url"), "tionsh.example.net").alias("canonical"))


@query("SELECT page_id, len(regexp_extract_all(html, '(?i)\\bhref\\s*=\\s*[\"'']([^\"'']+)[\"'']', 1)) AS n FROM pages")
def html_links(t):
    from ..sources.readers import html_links as links

    return t("pages").select("page_id", F.size(links(F.col("html"))).cast("long").alias("n"))


@query("SELECT p_partkey, trim(regexp_replace(lower(strip_accents(p_name)), '[^a-z0-9]+', ' ', 'g')) AS norm, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '-') AS slug, substr(sha256(p_brand || ':' || p_partkey), 1, 16) AS listing FROM part")
def text_keys(t):
    p = t("part")
    return p.select("p_partkey", text.search_norm(F.col("p_name")).alias("norm"), text.ascii_slug(F.col("p_type")).alias("slug"), text.listing_id(F.col("p_brand"), F.col("p_partkey").cast("string")).alias("listing"))


@query("SELECT doc_id, trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', ' ', 'g')) AS norm FROM documents")
def folded_text(t):
    return t("documents").select("doc_id", text.search_norm(F.col("text")).alias("norm"))


@query()
def folded_whole_text(t):
    """The whole of each text, as ``folded_text``, without SQL."""
    return t("documents").select("doc_id", text.search_norm(F.col("text")).alias("norm"))


@query("SELECT doc_id, regexp_matches(text, '[^\\s@]+@[^\\s@]+\\.[^\\s@]+') OR regexp_matches(text, '(?:\\+?\\d[\\s().-]?){9,}') AS contact FROM documents")
def contact_details(t):
    return t("documents").select("doc_id", text.has_contact(F.col("text")).alias("contact"))


@query("SELECT doc_id, trim(regexp_extract(text, '(?s)^\\s*(.*?[.!?])(?:\\s|$)', 1)) AS first FROM documents")
def first_sentence(t):
    return t("documents").select("doc_id", text.first_sentence(F.col("text")).alias("first"))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL WHEN c_acctbal < 1 THEN 1 WHEN c_acctbal < 100 THEN 2 ELSE 3 END AS band, CASE WHEN c_acctbal * 0.3048 BETWEEN -50 AND 2000 THEN round(c_acctbal * 0.3048, 4) END AS metres FROM customer")
def parsed_units(t):
    return _units(t("customer"))


@query()
def parsed_units_all(t):
    """Every customer, as ``parsed_units``, without SQL."""
    return _units(t("customer"))


def _units(c):
    m = parse.elevation_m(F.concat(F.format_string("%.2f", F.col("c_acctbal")), F.lit(" ft")))
    return c.select("c_custkey", F.when(F.col("c_acctbal") < 0, None).when(F.col("c_acctbal") < 1, 1).when(F.col("c_acctbal") < 100, 2).otherwise(3).alias("band"), F.round(m, 4).alias("metres"))


@query("SELECT o_orderkey, CAST(hour(o_orderdate) * 60 + minute(o_orderdate) AS INTEGER) AS minutes, CAST(o_orderdate AS DATE) AS day, date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-01-01') > 180 AS stale FROM orders")
def parsed_times(t):
    d = F.col("o_orderdate")
    day = parse.compact_date(F.date_format(d, "yyyyMMdd"))
    return t("orders").select("o_orderkey", parse.clock_minutes(F.date_format(d, "HH:mm")).alias("minutes"), day.alias("day"), parse.stale(day, F.to_date(F.lit("1998-01-01"))).alias("stale"))
