"""Canonical links and meta refreshes of every form."""

from urllib.parse import urljoin

from skeinframe.llm import url_filter


def edges(spark, rows):
    return {r.u: r.v for r in url_filter.link_edges(spark.createDataFrame(rows, "url string, html string")).collect()}


def closed(pages, redirects):
    """Verdicts by plain union-find."""
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x] = parent[parent[x]]
        return x

    for u, v in [(u, x) for _, u, links in pages for x in links] + redirects:
        a, b = root(u), root(v)
        if a != b:
            parent[max(a, b)] = min(a, b)

    def own(url):
        host, _, path = url.split("://")[1].partition("/")
        path = "/" + path.partition("?")[0]
        fits = [(len(h + p), v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[1] if fits else None

    groups = {}
    for x in list(parent):
        groups.setdefault(root(x), set()).add(own(x))
    out = {}
    for i, u, _ in pages:
        found = groups.get(root(u), set()) if u in parent else set()
        out[i] = own(u) or ("allow" if "allow" in found else "block" if "block" in found else "allow")
    return out


def test_chains_stars_and_conflicts_equal_brute_force(spark):
    pages = []  # (id, url, links)
    add = lambda u, *links: pages.append((len(pages), u, list(links)))
    for k in range(50):  # a chain that ends at a blocked page, and one that ends at a blocked and an allowed one
        add(f"http://c.org/{k}", f"http://c.org/{k + 1}")
        add(f"http://d.org/{k}", f"http://d.org/{k + 1}")
    add("http://c.org/50", "http://x.net/fr/c")
    add("http://d.org/50", "http://x.net/es/d", "http://www.ok.com/d")
    for k in range(10_000):
        add(f"http://s{k}.org/", "http://y.net/es/star")
    add("http://t.org/1", "http://t.org/2")
    add("http://t.org/2")
    add("http://r.org/1")
    add("http://r.org/alone")
    redirects = [("http://r.org/1", "http://r.org/2"), ("http://r.org/2", "http://z.net/fr/9")]
    tag = '<html><link href="{}" rel="nofollow canonical"></html>'
    rows = [(i, u, "".join(tag.format(x) for x in links)) for i, u, links in pages]
    df = spark.createDataFrame(rows, "page_id int, url string, html string")
    got = {r.page_id: r.verdict for r in url_filter.judge_urls(df, redirects=spark.createDataFrame(redirects, "src string, dst string")).collect()}
    want = closed(pages, redirects)
    assert got == want
    assert list(want.values()).count("block") > 10_050


def test_relative_links_are_resolved(spark):
    links = ["page2.html", "../x", "?id=1", "./", ".", "..", "../../../../up", "a/./b/../c?q=../z", "/p/../q", "//b.org/r", "/", "x.y/..z/...", "http://c.net/e", "?u=http://d.net/", "?a=1&amp;b=2"]
    bases = ["http://a.org/d/e/f.html?k=v#w", "http://a.org/d/", "https://a.org/f"]
    rows = [(f"{b.partition('?')[0]}?n={i}", f'<link rel="canonical" href="{x}">') for b in bases for i, x in enumerate(links)]
    want = {f"{b.partition('?')[0]}?n={i}": urljoin(f"{b.partition('?')[0]}?n={i}", x.replace("&amp;", "&")) for b in bases for i, x in enumerate(links)}
    assert edges(spark, rows) == want
    assert edges(spark, [("http://a.org", '<link rel="canonical" href="x">')]) == {"http://a.org": "http://a.org/x"}
    # dots of absolute links and empty segments, by RFC 3986 (urljoin leaves the first and drops the second)
    odd = {"a//../b": "http://a.org/x/a/b", "//b.org/./r": "http://b.org/r", "http://c.net/d/../e": "http://c.net/e"}
    assert edges(spark, [(f"http://a.org/x/{i}", f'<link rel="canonical" href="{x}">') for i, x in enumerate(odd)]) == {f"http://a.org/x/{i}": v for i, v in enumerate(odd.values())}
    none = ["#top", "mailto:a@b.org", "javascript:f()"]
    assert edges(spark, [(f"http://a.org/{i}", f'<link rel="canonical" href="{x}">') for i, x in enumerate(none)]) == {}


def test_refresh_urls_end_at_their_quote(spark):
    tags = [
        ('content="0; url=http://b.org/?a=1&amp;b=2"', "http://b.org/?a=1&b=2"), ("content=\"0;URL='c;d.html'\"", "http://a.org/c;d.html"), ('content="5;url=../e?f;g&amp;h"', "http://a.org/e?f;g&h"), ("content=0;url=/i", "http://a.org/i"),
    ]
    rows = [(f"http://a.org/{i}", f'<meta http-equiv="refresh" {x}>') for i, (x, _) in enumerate(tags)]
    assert edges(spark, rows) == {f"http://a.org/{i}": v for i, (_, v) in enumerate(tags)}


def test_a_block_reaches_relative_aliases(spark):
    rows = [(1, "http://a.net/es/1", '<link rel="canonical" href="../x/2">'), (2, "http://a.net/x/2", ""), (3, "http://a.net/x/3", '<meta http-equiv="refresh" content="0; url=2?p&amp;q">'), (4, "http://a.net/x/2?p&q", '<link rel="canonical" href="2">'), (5, "http://a.net/x/5", "")]
    got = {r.page_id: r.verdict for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow"}


def test_query_on_pages_with_links_equals_sql(spark, tmp_path):
    import duckdb

    from skeinframe.llm import queries
    from tests.conftest import rows_of

    link = '<LINK rel="nofollow canonical" href="{}">'
    meta = "<meta http-equiv=refresh content=\"0; url='{}'\">"
    rows = [
        ("http://a.net/es/1", link.format("../x/2") + meta.format("/y?q=1&amp;r=2")), ("http://a.net/x/2", None), ("http://a.net/y?q=1&r=2", ""), ("http://a.net/z", link.format("./../x/./2#top") + link.format("http://C.org/q")), ("http://c.org/q", "<link rel=canonical href=#here>"),
        ("http://d.org", link.format("e/f") + link.format("mailto:x@y.z")), ("http://d.org/e/f", meta.format("//www.ok.com/d")), ("http://g.org/a/b?c", link.format("?d")), ("http://g.org/a/b?d", link.format("http://h.net/fr/")), ("nonsense", link.format("http://h.net/fr/")), (None, link.format("http://h.net/fr/")),
        ("http://i.org/1", link.format("http://i.org/..")), ("http://i.org/", link.format("http://k.net/fr/../es/k")), ("http://a.net/es/1", "no link here"), ("http://m.org/", "<link rel='alternate' href='http://h.net/fr/'>"),
    ]
    spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.queries()["op5_url_redirect_filter"](spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert rows_of(got) == rows_of(con.execute(queries.oracle_sql()["op5_url_redirect_filter"]).df())
    assert (got.verdict == "block").sum() >= 7 and got.alias_of.notna().sum() >= 10


def test_links_are_closed_by_expressions_only(spark, monkeypatch):
    def refuse(*args, **kwargs):
        raise AssertionError("Python on the executors")

    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", refuse)
    tag = '<html><link href="{}" rel="canonical"></html>'
    pages = spark.createDataFrame([(1, "http://a.org/1", tag.format("http://a.org/2")), (2, "http://a.org/2", tag.format("http://x.net/fr/c")), (3, "http://b.org/", "")], "page_id int, url string, html string")
    assert {r.page_id: r.verdict for r in url_filter.judge_urls(pages).collect()} == {1: "block", 2: "block", 3: "allow"}
