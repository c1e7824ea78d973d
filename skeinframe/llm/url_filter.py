"""URL rules with redirect equivalence, in DataFrame expressions only.

A URL's own rule (longest that fits) decides it. For the others, redirect and
canonical-link edges are closed into groups of aliases by distributed connected
components; a block decision of any alias holds for the group, unless an alias
is explicitly allowed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable
from ..operators.graph import components

#: (verdict, host, path prefix)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CANONICAL = r"""(?is)<link\b[^>]*\brel\s*=\s*(?:"[^"]*\bcanonical\b[^"]*"|'[^']*\bcanonical\b[^']*'|canonical\b)[^>]*>"""
REFRESH = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
HREF = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH_URL = r"""(?is)\burl\s*=\s*["']?([^"'\s>]+)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or end, A-Z lower-cased; path: then up to ``?``, ``#`` or end. Both empty without ``://`` or for null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """struct(verdict, rule) of the longest rule that fits; null if none does. A rule fits its host and all subdomains, if the path starts with its own. Of two as long, the first listed."""
    fits: Column | None = None
    for verdict, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        test = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))
        fits = F.when(test, value) if fits is None else fits.when(test, value)
    return fits


def _key(url: Column) -> Column:
    """A URL as a node: without its fragment, scheme and host in lower case."""
    bare = F.regexp_extract(url, r"(?s)^([^#]*)", 1)
    head = F.regexp_extract(bare, r"(?s)^([^:/?#]*://[^/?#]*)", 1)
    return F.concat(F.translate(head, UPPER, LOWER), F.substring(bare, F.length(head) + 1, F.length(bare)))


def _without_dots(url: Column) -> Column:
    """``url`` with the segments ``.`` and ``..`` of its path resolved."""
    head = F.regexp_extract(url, r"(?s)^([^:/?#]*://[^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^[^:/?#]*://[^/?#]*([^?#]*)", 1)
    tail = F.substring(url, F.length(head) + F.length(path) + 1, F.length(url))
    parts = F.split(path, "/", -1)
    step = lambda acc, x: F.when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(x == ".", acc).otherwise(F.array_append(acc, x))
    kept = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.array().cast("array<string>"), step)
    end = F.when(path.rlike(r"/\.\.?$") & (F.size(kept) > 0), "/").otherwise("")
    return F.when(path.contains("/."), F.concat(head, F.lit("/"), F.array_join(kept, "/"), end, tail)).otherwise(url)


def _absolute(base: Column, link: Column) -> Column:
    """``link`` as seen from the page's URL ``base``; a base element is not looked at. Null for a mere fragment, for schemes without ``//``, and for all but absolute links if ``base`` is not absolute."""
    link = F.replace(link, F.lit("&amp;"), F.lit("&"))
    scheme, origin = F.regexp_extract(base, r"^([^:/?#]+:)//", 1), F.regexp_extract(base, r"^([^:/?#]+://[^/?#]*)", 1)
    page = F.regexp_extract(base, r"(?s)^([^?#]*)", 1)
    folder = F.concat(origin, F.regexp_extract(F.substring(page, F.length(origin) + 1, F.length(page)), r"(?s)^(.*/)", 1))
    folder = F.when(folder == origin, F.concat(origin, F.lit("/"))).otherwise(folder)
    whole = F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), link).when((origin == "") | link.rlike(r"^(?:#|[A-Za-z][A-Za-z0-9+.\-]*:)"), F.lit(None))
    whole = whole.when(link.startswith("//"), F.concat(scheme, link)).when(link.startswith("/"), F.concat(origin, link)).when(link.startswith("?"), F.concat(page, link)).otherwise(F.concat(folder, link))
    return _without_dots(whole)


def link_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(u, v): URL keys of each page and of the targets of all its canonical links and meta refreshes."""
    h = F.coalesce(F.col(html), F.lit(""))
    found = lambda tag, target: F.transform(F.regexp_extract_all(h, F.lit(tag), F.lit(0)), lambda x: F.regexp_extract(x, target, 1))
    linking = pages.filter(F.col(url).isNotNull() & F.lower(h).rlike("canonical|refresh"))
    links = linking.select(F.col(url).alias("url"), F.explode(F.concat(found(CANONICAL, HREF), found(REFRESH, REFRESH_URL))).alias("link")).filter("link <> ''")
    return links.select(_key(F.col("url")).alias("u"), _key(_absolute(F.col("url"), F.col("link"))).alias("v")).filter("v is not null")


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, redirects: DataFrame | None = None, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row for each row of ``pages``: page_id, host, path, rule, verdict, and alias_of (the group's smallest URL, null for a URL without aliases).

    redirects: optional (src, dst) URLs. URLs without a rule of their own: allow
    if an alias is explicitly allowed, else block if an alias is blocked, else
    allow. Null URL or one without ``://``: empty host and path, so no rule, no
    alias: allow. Repeated rows each get their result; no rows: none. Very long
    pages are searched whole; only their links leave the scan.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url).alias("url")).select("page_id", "url", host.alias("host"), path.alias("path"), _key(F.col("url")).alias("key")).withColumn("own", rule_of(F.col("host"), F.col("path"), rules))
    edges = link_edges(pages, url, html)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(_key(F.col("src")).alias("u"), _key(F.col("dst")).alias("v")))
    groups = components(edges, in_tasks=False)
    h, p = host_and_path(F.col("node"))
    marked = groups.withColumn("own", rule_of(h, p, rules))
    decided = marked.groupBy("component").agg(F.max(F.col("own.verdict") == "allow").alias("some_allow"), F.max(F.col("own.verdict") == "block").alias("some_block"))
    aliases = durable(groups.join(decided, "component").select(F.col("node").alias("key"), F.col("component").alias("alias_of"), F.when(F.col("some_allow"), F.lit("allow")).when(F.col("some_block"), F.lit("block")).alias("group_verdict")), "aliases")
    verdict = F.coalesce(F.col("own.verdict"), F.col("group_verdict"), F.lit("allow"))
    return own.join(aliases, "key", "left").select("page_id", "host", "path", F.col("own.rule").alias("rule"), verdict.alias("verdict"), "alias_of")
