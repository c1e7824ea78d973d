"""Queries of cited stories and pictures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import categories, evidence, filters, photos, placing, stories
from ..operators.tables import durable
from .base import ITEMS, ITEMS_SQL, PLACES, PLACES_SQL, items, places
from .registry import plain, query

_P, _I = PLACES_SQL, ITEMS_SQL


@query(f"SELECT slug, place, count(*) AS n, string_agg(title, '|' ORDER BY item) AS titles FROM (SELECT slug, place, title, min(item) AS item FROM {_I} i GROUP BY slug, place, title) q GROUP BY slug, place")
def story_packs(t):
    """Stories of a place and interest, one a title (A-13)."""
    return stories.story_packs(items(t), "item")


@query(f"SELECT item FROM (SELECT item, row_number() OVER (PARTITION BY slug, place, coalesce(facet, ''), title ORDER BY item) AS r FROM {_I} i) q WHERE r = 1")
def natural_keys(t):
    """One row a natural key (U-04)."""
    return stories.natural_keys(items(t), "item").select("item")


@query(
    f"""WITH a AS (SELECT * FROM {_I} i WHERE status = 'accepted' AND place % 17 <> 0 AND NOT (slug = 'island-books' AND place % 5 = 0 AND title = 'A novel of the sea')) SELECT item, CASE WHEN slug = 'local-traditions' AND title = 'Harris tweed' AND place % 2 = 0 THEN 'Reviewed.' ELSE summary END AS summary
 FROM (SELECT *, row_number() OVER (PARTITION BY slug, place, coalesce(facet, ''), title ORDER BY item) AS r FROM a) q WHERE r = 1"""
)
def accepted_items(t):
    """Accepted items without denied claims and dropped places, with reviewed summaries (F-32)."""
    p = t("customer").select(F.col("c_custkey").alias("place"))
    denied = p.filter("place % 5 = 0").select(F.lit("island-books").alias("slug"), "place", F.lit("A novel of the sea").alias("title"))
    reviewed = p.filter("place % 2 = 0").select(F.lit("local-traditions").alias("slug"), "place", F.lit("Harris tweed").alias("title"), F.lit("Reviewed.").alias("summary"))
    return filters.accepted(items(t), denied, reviewed, p.filter("place % 17 = 0"), "item").select("item", "summary")


@query(f"SELECT item FROM {_I} i WHERE slug = 'whisky-distilleries' AND (lower(facet) = 'islay' OR (subdivision = 'islay' AND facet = 'distillery'))")
def stories_by_facet(t):
    """Stories of a collection by facet; a distillery's division counts if it works (Q-13, Q-14)."""
    return stories.stories_of(items(t), slug="whisky-distilleries", facet="Islay").select("item")


@query(f"SELECT place, slug, count(*) AS n, string_agg(title, '|' ORDER BY item) FILTER (WHERE r <= 3) AS first FROM (SELECT *, row_number() OVER (PARTITION BY place, slug ORDER BY item) AS r FROM {_I} i) q GROUP BY place, slug")
def interest_groups(t):
    """Interests of a place and their first stories (Q-17)."""
    return stories.interest_groups(items(t))


@query(
    f"""WITH s AS (SELECT place, source_url AS url, source_title AS label, item FROM {_I} i WHERE regexp_matches(source_url, '^https?://')), o AS (SELECT *, row_number() OVER (PARTITION BY place, url ORDER BY item) AS r FROM s), n AS (SELECT *, CAST(row_number() OVER (PARTITION BY place ORDER BY item) AS INTEGER) AS "at" FROM o WHERE r = 1) SELECT place, url, label, "at" FROM n WHERE "at" <= 8"""
)
def cited_references(t):
    """References of a place: safe addresses in order, each once (W-26, P-45)."""
    return stories.references(items(t).select("place", F.col("source_url").alias("url"), F.col("source_title").alias("label"), "item"), "place", ["item"])


@query(
    f"""WITH r AS (SELECT DISTINCT place, source_url AS url FROM {_I} i WHERE source_url IS NOT NULL), c AS (SELECT place, url FROM r WHERE place % 3 = 0 AND url = 'https://a.org/1') SELECT place, url, 'cited' AS how FROM c UNION ALL SELECT place, url, 'background' FROM r WHERE url = 'http://b.org/2' AND place NOT IN (SELECT place FROM c)"""
)
def answer_references(t):
    """References that an answer cites, else background (W-26)."""
    r = items(t).filter("source_url is not null").select("place", F.col("source_url").alias("url")).distinct()
    answers = t("customer").select(F.col("c_custkey").alias("place"), F.when(F.col("c_custkey") % 3 == 0, "see https://a.org/1 for more").otherwise("no source").alias("text"))
    return stories.answer_references(answers, r, r.filter("url = 'http://b.org/2'"), "place")


@query(
    f"""SELECT item, CASE item % 5 WHEN 0 THEN 'It depicts ' || w || '.' WHEN 1 THEN 'The work takes ' || w || ' as its subject.' WHEN 2 THEN 'It was filmed on ' || w || '.' WHEN 3 THEN 'The artist was born on ' || w || '.' ELSE 'It is connected with ' || w || '.' END AS clause,
 CASE WHEN item % 7 = 0 OR contains(lower(w), 'tolm') THEN 'tolmic' WHEN contains(lower(w), 'lunna') THEN 'north' ELSE 'hebrides' END AS region, item % 4 IN (0, 1, 2) AS located, CASE WHEN item % 4 IN (0, 1) THEN 'Held on ' || w || ' each year. It is old.' WHEN item % 4 = 2 THEN w || ' is where it began.' END AS sentence FROM (SELECT item, p.w FROM {_I} i JOIN {_P} p ON i.place = p.id) q"""
)
def story_sentences(t):
    """Clauses, regions and sentences that set a story on a place (X-11, X-13, X-15)."""
    i = items(t).select("item", "place").join(places(t).select(F.col("id").alias("place"), "w"), "place")
    k, w = F.col("item"), F.col("w")
    link = F.when(k % 5 == 0, "depicts").when(k % 5 == 1, "main subject").when(k % 5 == 2, "filming location").when(k % 5 == 3, "place of birth").otherwise("owner")
    body = F.when(k % 4 <= 1, F.concat(F.lit("A custom. Held on "), w, F.lit(" each year. It is old."))).when(k % 4 == 2, F.concat(w, F.lit(" is where it began."))).otherwise(F.concat(F.lit("The "), w, F.lit(" pattern is sold in shops.")))
    said = i.select("item", stories.relation_clause(link, w).alias("clause"), stories.region_of(k % 7, w, [([0], ["tolm"], "tolmic"), ([], ["lunna"], "north")], "hebrides").alias("region"), stories.best_sentence(body, w).alias("sentence"))
    return said.withColumn("located", F.col("sentence").isNotNull())


_LATIN = "CASE o_orderkey % 4 WHEN 0 THEN 'Microtus ' || w WHEN 1 THEN 'Vole of ' || w WHEN 2 THEN 'VOLE of ' || w ELSE 'Tern ' || (o_orderkey % 3) END"
_STORY = f"SELECT o_orderkey AS item, o_custkey AS place, {_LATIN} AS title, CASE o_orderkey % 5 WHEN 0 THEN 'Known as Microtus ' || w || ' too.' WHEN 1 THEN 'Now extinct here.' WHEN 2 THEN 'Common.' WHEN 3 THEN 'A long summary of the animal and its ways.' END AS summary, o_orderkey % 4 = 0 AS latin, o_orderkey % 3 AS reason FROM (SELECT *, CASE WHEN o_custkey % 2 = 0 THEN 'insularis' ELSE 'orcadensis' END AS w FROM {{orders}}) o"


@query(
    f"""WITH s AS ({_STORY.replace('{orders}', 'orders')}), o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY place, lower(title) ORDER BY length(coalesce(summary, '')) DESC, item) AS r FROM s) q WHERE r = 1),
 l AS (SELECT * FROM o a WHERE NOT latin OR NOT EXISTS (SELECT 1 FROM o b WHERE b.place = a.place AND NOT b.latin AND contains(' ' || trim(regexp_replace(lower(b.title || ' ' || coalesce(b.summary, '')), '[^a-z0-9]+', ' ', 'g')) || ' ', ' ' || lower(a.title) || ' ')))
 SELECT place, item, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY place ORDER BY reason DESC, CASE WHEN contains(lower(coalesce(summary, '')), 'extinct') THEN 1 ELSE 0 END, length(coalesce(summary, '')) DESC, item) AS INTEGER) AS rank FROM l) q WHERE rank <= 3"""
)
def stories_without_repeats(t):
    """Stories without repeats and Latin doubles, three a place (X-12, W-19)."""
    return stories.without_repeats(t.sql(_STORY)).select("place", "item", "rank")


@query(
    """WITH h AS (SELECT l_orderkey AS item, l_partkey % 7 AS place, l_linenumber AS n, l_quantity > 40 AS in_title, l_orderkey % 7 AS asked FROM lineitem), b AS (SELECT item, place, max(n + CASE WHEN in_title THEN 100 ELSE 0 END) AS p, bool_or(asked = place) AS own FROM h GROUP BY item, place), t AS (SELECT b.*, max(p) OVER (PARTITION BY item) AS top FROM b), c AS (SELECT item, count(*) AS n, min(place) AS sole, max(CASE WHEN own THEN place END) AS mine FROM t WHERE p = top GROUP BY item)
 SELECT item, CASE WHEN n = 1 THEN sole ELSE mine END AS place FROM c WHERE n = 1 OR mine IS NOT NULL"""
)
def resolved_aliases(t):
    """Aliases by length and title; ties to the place that was asked for (X-16)."""
    li = t("lineitem")
    hits = li.select(F.col("l_orderkey").alias("item"), (F.col("l_partkey") % 7).alias("place"), F.repeat(F.lit("x"), F.col("l_linenumber")).alias("alias"), (F.col("l_quantity") > 40).alias("in_title"), (F.col("l_orderkey") % 7).alias("asked"))
    return stories.resolved_aliases(hits, "item")


@query(
    """WITH h AS (SELECT l_orderkey AS item, l_partkey AS place, l_quantity AS km, 60.0 AS radius, l_discount > 0.08 AS titled, l_tax > 0.06 AS confirmed FROM lineitem), g AS (SELECT item, count(*) AS n, count(*) FILTER (WHERE titled) AS nt, min(place) FILTER (WHERE titled) AS tp, first(place ORDER BY km, place) FILTER (WHERE confirmed) AS cp, bool_or(confirmed) AS c, first(place ORDER BY km, place) AS np, min(km) AS km FROM h GROUP BY item)
 SELECT item, CASE WHEN nt = 1 THEN tp WHEN c THEN cp ELSE np END AS place, CASE WHEN nt = 1 THEN 'titled' WHEN c THEN 'confirmed' ELSE 'inside' END AS how FROM g WHERE nt = 1 OR c OR (n = 1 AND km <= 27)"""
)
def points_in_places(t):
    """Points by title, text or depth (X-10)."""
    c = F.col
    hits = t("lineitem").select(c("l_orderkey").alias("item"), c("l_partkey").alias("place"), c("l_quantity").alias("km"), F.lit(60.0).alias("radius_km"), (c("l_discount") > 0.08).alias("titled"), (c("l_tax") > 0.06).alias("confirmed"))
    return stories.point_in_place(hits, "item")


@query("SELECT doc_id, d AS description FROM (SELECT doc_id, CASE WHEN length(lead) <= 300 THEN lead ELSE regexp_extract(substr(lead, 1, 300), '(?s)^(.*[.!?])', 1) END AS d FROM (SELECT doc_id, trim(regexp_replace(string_split(trim(text), chr(10))[1], '\\[[0-9]+\\]', '', 'g')) AS lead FROM documents WHERE doc_id % 9 <> 0) q) r WHERE d <> ''")
def article_leads(t):
    """First paragraphs of articles, cut at a sentence; what was given up before is left out (X-19)."""
    return stories.lead_of(t("documents").select("doc_id", "text"), t("documents").filter("doc_id % 9 = 0").select("doc_id"), "doc_id", 300)


_PICS = "SELECT o_orderkey AS ord, o_custkey AS id, CASE o_orderkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'https://x.org/a/Big_Bay.jpg?w=1' WHEN 2 THEN 'https://x.org/b/big bay.JPG' WHEN 3 THEN 'https://x.org/Cliff 2020-01-02.png' WHEN 4 THEN 'https://y.org/cliff.png' ELSE 'https://y.org/c' || (o_orderkey % 4) || '.jpg' END AS url, o_orderkey % 5 = 0 AS context, o_orderstatus = 'O' AS lead FROM {orders}"


@query(
    f"""WITH a AS (SELECT id, CASE WHEN lead THEN 0 ELSE 1 END AS g, ord, url, lead FROM ({_PICS.replace('{orders}', 'orders')}) p WHERE lead OR NOT context), k AS (SELECT *, lower(regexp_replace(regexp_replace(regexp_replace(regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)$', 1), '\\.[A-Za-z0-9]{{2,4}}$', ''), '[-_ ]?\\(?[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}\\)?$', ''), '[\\s_]+', '_', 'g')) AS k FROM a),
 o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, k ORDER BY g, ord) AS r FROM k) q WHERE r = 1 OR k = '') SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY g, ord) AS INTEGER) AS at, url, lead AS "primary" FROM o"""
)
def galleries(t):
    """Lead pictures, then extras, each file once (M-22, P-58)."""
    p = t.sql(_PICS)
    return photos.gallery(p.filter("lead").select("id", "ord", "url"), p.filter("not lead").select("id", "ord", "url", "context"))


_BANDED = "(SELECT CASE o_orderkey % 4 WHEN 0 THEN 95 WHEN 1 THEN 85 WHEN 2 THEN 60 ELSE 90 END AS confidence, CASE o_orderkey % 3 WHEN 0 THEN 'commons' WHEN 1 THEN 'survey' END AS source FROM orders)"


@query(f"SELECT 'band' AS part, CASE WHEN confidence >= 90 THEN 'gte90' WHEN confidence >= 80 THEN '80-89' ELSE 'lt80' END AS k, count(*) AS n FROM {_BANDED} b GROUP BY 2 UNION ALL SELECT 'source', coalesce(source, 'unknown'), count(*) FROM {_BANDED} b GROUP BY 2")
def picture_audit(t):
    """Pictures by confidence and source (A-09)."""
    o = F.col("o_orderkey")
    scored = t("orders").select(F.when(o % 4 == 0, 95).when(o % 4 == 1, 85).when(o % 4 == 2, 60).otherwise(90).alias("confidence"), F.when(o % 3 == 0, "commons").when(o % 3 == 1, "survey").alias("source"))
    bands, sources = photos.confidence_bands(scored)
    return bands.select(F.lit("band").alias("part"), F.col("band").alias("k"), "n").unionByName(sources.select(F.lit("source").alias("part"), F.col("source").alias("k"), "n"))


_HITS = "SELECT o_custkey AS place, o_orderkey AS ord, 'f' || CAST(o_orderkey AS VARCHAR(20)) AS file, o_orderkey % 7 = 0 AS named, CASE WHEN o_orderkey % 6 = 0 THEN CAST(NULL AS DOUBLE) ELSE CAST(o_orderkey * 31 % 900 AS DOUBLE) END AS metres, o_orderkey % 5 <> 0 AS photo, o_orderkey % 3 <> 0 AS licensed, o_orderkey % 4 = 0 AS in_caption FROM {orders}"


@query(
    f"""WITH h AS ({_HITS.replace('{orders}', 'orders')}), ok AS (SELECT *, bool_or(named) OVER (PARTITION BY place) AS any_named FROM h WHERE photo), v3 AS (SELECT place FROM (SELECT *, row_number() OVER (PARTITION BY place ORDER BY CASE WHEN named THEN 0 ELSE 1 END, coalesce(metres, 1e9), file) AS r FROM ok WHERE CASE WHEN any_named THEN named ELSE coalesce(metres, 1e9) <= 200 END) q WHERE r <= 8 AND licensed GROUP BY place),
 v5 AS (SELECT place FROM (SELECT *, row_number() OVER (PARTITION BY place ORDER BY ord, file) AS r FROM h WHERE photo) q WHERE r <= 8 AND licensed AND (named OR in_caption) AND coalesce(metres <= 525, false) GROUP BY place)
 SELECT CASE WHEN v3.place IS NOT NULL AND v5.place IS NOT NULL THEN 'both' WHEN v3.place IS NOT NULL THEN 'older only' WHEN v5.place IS NOT NULL THEN 'newer only' ELSE 'neither' END AS yield, count(*) AS n FROM customer LEFT JOIN v3 ON c_custkey = v3.place LEFT JOIN v5 ON c_custkey = v5.place GROUP BY 1"""
)
def picker_yields(t):
    """What two rules for picking pictures find (A-22, R-26)."""
    h = t.sql(_HITS)
    return photos.yields(photos.older_pick(h, "place"), photos.newer_pick(h, "place", 500), t("customer").select(F.col("c_custkey").alias("place")), "place")


@query(
    f"""SELECT id, (id % 3 <> 0) AND (id % 5 = 0 OR coalesce(km <= far, false)) AND (coalesce(length(trim(archipelago)), 0) < 4 OR contains('stones of the outer isles', lower(archipelago)) OR far <= 2) AS heritage FROM (SELECT id, archipelago, CASE WHEN id % 4 = 0 THEN NULL ELSE CAST(id % 12 AS DOUBLE) END AS km, CASE WHEN id % 6 = 0 THEN 2.0 ELSE 8.0 END AS far FROM {_P} p) q"""
)
def heritage_matches(t):
    """Heritage records by name, distance and place words (X-23)."""
    i = F.col("id")
    test = photos.heritage_match(i % 3 != 0, F.when(i % 4 != 0, (i % 12).cast("double")), F.when(i % 6 == 0, 2.0).otherwise(8.0), i % 5 == 0, F.array_compact(F.array("archipelago")), F.lit("Stones of the Outer Isles"))
    return places(t).select("id", test.alias("heritage"))


_LINKS = "SELECT o_custkey AS place, 'u' || CAST(o_orderkey AS VARCHAR(20)) AS url, CASE o_orderkey % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' END AS confidence, CASE o_orderkey % 3 WHEN 0 THEN 'commons' WHEN 1 THEN 'geograph' END AS via FROM {orders}"


@query(
    f"""SELECT place, url FROM (SELECT *, row_number() OVER (PARTITION BY place ORDER BY CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END DESC, CASE WHEN via = 'commons' THEN 1 WHEN via IS NULL THEN -1 ELSE 0 END DESC, CASE WHEN via = 'geograph' THEN 1 WHEN via IS NULL THEN -1 ELSE 0 END DESC, url) AS r FROM ({_LINKS.replace('{orders}', 'orders')}) l) q WHERE r = 1"""
)
def best_links(t):
    """The best link of a place (X-24)."""
    return photos.best_link(t.sql(_LINKS), "place").select("place", "url")


@query("SELECT url, count(*) AS uses, 'url' AS fields FROM pages WHERE regexp_matches(url, '^https?://') GROUP BY url")
def url_inventory(t):
    """Every web address and where it stands (X-25)."""
    return photos.url_inventory(t("pages").withColumn("other", F.lit("no link")), "page_id", ["url", "other"])


@query(f"SELECT i.item, p.id AS place FROM {_I} i JOIN {_P} p ON i.place = p.id WHERE p.area > 100 AND i.item % 2 = 0")
def prefiltered_items(t):
    """Items that lie in some place's reach (X-07, J-20)."""
    hits = items(t).filter("item % 2 = 0").select("item", "place")
    return hits.join(places(t).filter("area > 100").select(F.col("id").alias("place")), "place", "left_semi")


_KM = "2 * 6371.0 * asin(sqrt(pow(sin(radians(p.lat - q.lat) / 2), 2) + cos(radians(q.lat)) * cos(radians(p.lat)) * pow(sin(radians(p.lng - q.lng) / 2), 2)))"
_REACH = "CASE WHEN p.area > 0 THEN greatest(0.35, 1.45 * sqrt(p.area / pi())) ELSE 0.4 END"


@query(f"SELECT q.id, p.id AS place, round({_KM}, 6) AS km FROM (SELECT id, lat + 0.004 AS lat, lng FROM {_P} x) q JOIN {_P} p ON {_KM} <= {_REACH}")
def places_in_reach(t):
    """Places whose widened circle holds a point (X-05, J-13)."""
    p = places(t)
    found = evidence.in_reach(p.select("id", (F.col("lat") + 0.004).alias("lat"), "lng"), p.select(F.col("id").alias("place"), "lat", "lng", "area"), "id", "place")
    return found.withColumn("km", F.round("km", 6))


@query(
    f"""WITH r AS (SELECT i.item, i.place AS declared, p.id AS near FROM (SELECT item, place, item % 10 AS d FROM {_I} x) i LEFT JOIN {_P} p ON p.id = i.place % 50 + 1 AND i.d < 6) SELECT item, CASE WHEN item % 4 = 0 THEN declared ELSE near END AS place, CASE WHEN item % 4 = 0 THEN 'declared' ELSE 'near' END AS reason FROM r WHERE item % 4 = 0 OR near IS NOT NULL"""
)
def first_evidence(t):
    """The first kind of evidence that names one place (X-06, U-01)."""
    i = items(t)
    declared = i.filter("item % 4 = 0").select("item", "place")
    near = i.filter("item % 10 < 6").select("item", (F.col("place") % 50 + 1).alias("place"))
    return evidence.first_evidence([("declared", declared), ("near", near)], "item", "place")


@query(
    f"""SELECT item, CASE WHEN item % 5 = 0 THEN CASE WHEN item % 20 <= 15 THEN 'ok' ELSE 'too far' END WHEN contains(' ' || hay || ' ', ' france ') OR contains(' ' || hay || ' ', ' north ') THEN 'ok' ELSE 'no anchor' END AS anchor,
 CASE WHEN item % 6 = 0 THEN CASE WHEN item % 12 = 0 THEN 'medium' ELSE 'high' END WHEN item % 6 = 1 THEN 'medium' WHEN item % 6 = 2 AND item % 4 >= 2 THEN 'hint' WHEN item % 6 = 3 THEN 'medium' ELSE 'rejected' END AS verdict FROM (SELECT item, trim(regexp_replace(lower(coalesce(summary, '')), '[^a-z0-9]+', ' ', 'g')) AS hay FROM {_I} i) q"""
)
def evidence_verdicts(t):
    """Anchors of files and verdicts on candidates (X-01, X-02, M-11)."""
    k = F.col("item")
    anchor = evidence.geo_anchor(F.when(k % 5 == 0, (k % 20).cast("double")), F.col("summary"), ["France", "north"], 15)
    yes = lambda n: k % 6 == n
    verdict = evidence.relation_class(yes(0), F.when(k % 12 == 0, 9.0).otherwise(1.0), yes(1), yes(2), (k % 4).cast("double"), F.when(yes(3), 1.0).otherwise(9.0), F.lit(False))
    return items(t).select("item", anchor.alias("anchor"), verdict.alias("verdict"))


@query(
    f"""WITH w AS (SELECT i.item, p.w, CASE i.item % 4 WHEN 0 THEN 'A shop on ' || p.w || '. Old.' WHEN 1 THEN 'Opposite ' || p.w || ' lies a rock' WHEN 2 THEN 'The Isle of ' || p.w || ' again' ELSE 'Nothing of it' END AS body FROM {_I} i JOIN {_P} p ON i.place = p.id) SELECT item, item % 4 IN (0, 2) AS located, item % 4 <> 3 AS mentioned FROM w"""
)
def location_sentences(t):
    """Sentences that set something on a place, and mentions of it (X-03, X-04, P-37)."""
    i = items(t).select("item", "place").join(places(t).select(F.col("id").alias("place"), "w"), "place")
    k, w = F.col("item"), F.col("w")
    body = F.when(k % 4 == 0, F.concat(F.lit("A shop on "), w, F.lit(". Old."))).when(k % 4 == 1, F.concat(F.lit("Opposite "), w, F.lit(" lies a rock"))).when(k % 4 == 2, F.concat(F.lit("The Isle of "), w, F.lit(" again"))).otherwise("Nothing of it")
    return i.select("item", evidence.location_sentence(body, w).alias("located"), evidence.mentions(body, w).alias("mentioned"))


@query(
    f"""WITH p AS (SELECT DISTINCT item, phrase, place FROM (SELECT item, 'a' || (item % 5) AS phrase, place % 4 AS place FROM {_I} i UNION ALL SELECT item, 'bb' || (item % 7), (place + item % 2) % 4 FROM {_I} i) q WHERE phrase NOT IN ('a0', 'bb1')) SELECT item, min(place) AS place, first(phrase ORDER BY length(phrase) DESC, phrase DESC) AS phrase FROM p GROUP BY item HAVING count(DISTINCT place) = 1"""
)
def one_place_phrases(t):
    """Items whose phrases all mean one place (X-17)."""
    i = items(t)
    k = F.col("item")
    phrases = i.select("item", F.concat(F.lit("a"), k % 5).alias("phrase"), (F.col("place") % 4).alias("place")).unionByName(i.select("item", F.concat(F.lit("bb"), k % 7).alias("phrase"), ((F.col("place") + k % 2) % 4).alias("place")))
    denied = t("region").filter("r_regionkey < 2").select(F.when(F.col("r_regionkey") == 0, "a0").otherwise("bb1").alias("phrase"))
    return evidence.one_place_only(phrases, denied, "item", "phrase", "place")


@query(f"SELECT item FROM (SELECT item, row_number() OVER (PARTITION BY trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) ORDER BY p.area IS NULL, p.area, item) AS r FROM {_I} i JOIN {_P} p ON i.place = p.id) q WHERE r = 1")
def smallest_owners(t):
    """Of one title on several places, the copy on the smallest (X-09)."""
    i = items(t).select("item", "title", "place").join(places(t).select(F.col("id").alias("place"), "area"), "place")
    return evidence.smallest_owner(i, "title", "area", "item").select("item")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'CalA' WHEN o_orderkey % 4 = 1 THEN 'Long' END AS owner FROM orders WHERE o_orderkey % 4 < 2")
def operators_by_alias(t):
    """Operators by the longest alias in a text (P-50)."""
    k = F.col("o_orderkey")
    texts = t("orders").select("o_orderkey", F.when(k % 4 == 0, "run by cal").when(k % 4 == 1, "run by Cal Ferries Ltd").otherwise("nobody").alias("body"))
    aliases = t("region").filter("r_regionkey < 2").select(F.when(F.col("r_regionkey") == 0, "Cal").otherwise("CAL ferries").alias("alias"), F.when(F.col("r_regionkey") == 0, "CalA").otherwise("Long").alias("owner"))
    return evidence.longest_alias(texts, aliases, "o_orderkey", "body")


#: Castles near places, told of in several ways; a sentence a line.
_CASTLES = f"""SELECT item AS record, CASE item % 5 WHEN 0 THEN w || ' Castle' WHEN 1 THEN 'The Castle of ' || w WHEN 2 THEN 'Old House' WHEN 3 THEN 'High Tower' ELSE 'Old Castle' END AS title,
 CASE item % 7 WHEN 0 THEN 'It is a castle on the shore of ' || w WHEN 1 THEN 'It is a castle' || chr(10) || 'It looks to the Sound of ' || w WHEN 2 THEN 'It is a castle on a small island' WHEN 3 THEN CAST(NULL AS VARCHAR(90)) WHEN 4 THEN 'It is a ruined castle on ' || w || chr(10) || 'Another stood on Tolm' WHEN 5 THEN 'It is a broch on ' || w ELSE 'A wall' END AS extract,
 CASE WHEN item % 11 = 0 THEN 'Tower House' ELSE '' END AS kind, CASE WHEN item % 3 = 0 THEN 'stands on ' || w ELSE '' END AS context, CASE WHEN item % 19 = 0 THEN NULL ELSE lat + 0.02 * (item % 4) END AS lat, lng, CASE WHEN item % 6 = 0 THEN wikidata END AS entity FROM ({ITEMS}) i JOIN ({PLACES}) p ON i.place = p.id"""


def _set(text: str) -> str:
    bad = f"{placing.WATER_OF}|{placing.OFF}|{placing.VIEW}"
    return f"len(list_filter(string_split({text}, chr(10)), lambda s: regexp_matches(regexp_replace(s, '(?:{bad})(?:' || p || ')\\b', ' # ', 'g'), '(?:{placing.PLACED})\\b(?:' || p || ')\\b|\\b(?:' || p || ') (?:castle|island|islet)\\b'))) > 0"


_HIT = "2 * 6371.0 * asin(sqrt(pow(sin(radians(p.lat - r.lat) / 2), 2) + cos(radians(r.lat)) * cos(radians(p.lat)) * pow(sin(radians(p.lng - r.lng) / 2), 2)))"


@query(
    f"""WITH r AS (SELECT *, lower(title) AS t, lower(coalesce(extract, '')) AS e, lower(title || chr(10) || coalesce(extract, '')) AS te, list_aggregate(list_slice(string_split(lower(coalesce(extract, '')), chr(10)), 1, 3), 'string_agg', ' ') AS head FROM ({plain(_CASTLES)}) x),
 c AS (SELECT *, CASE WHEN regexp_matches(t, '\\bhouse\\b') AND NOT regexp_matches(t, '\\btower house\\b') THEN false WHEN regexp_matches(coalesce(head, ''), '{placing.LEAD_CASTLE}') THEN true WHEN regexp_matches(coalesce(head, ''), '{placing.LEAD_OTHER}') THEN false ELSE lower(kind) = 'tower house' OR regexp_matches(t, '{placing.CASTLE}') END AS castle FROM r),
 p AS (SELECT id, lower(w) AS p, coalesce(area, 0) AS area, lat, lng, wikidata, CASE WHEN coalesce(area, 0) > 0 THEN greatest(0.35, 1.45 * sqrt(area / pi())) ELSE 0.4 END AS radius FROM {_P} x WHERE coalesce(area, 0) <= 8000),
 f AS (SELECT r.record, id, {_HIT} AS km, p.area, radius, p.area >= 8 AND regexp_matches(te, '{placing.OWN_ISLET}') AS denied, coalesce(r.entity = p.wikidata, false) AS declared, {_set("te")} AS named, regexp_matches(t, '\\b(?:' || p || ')\\b') AS titled, {_set("e")} AS told, {_set("lower(context)")} AS listed, e, extract FROM c r JOIN p ON abs(p.lat - r.lat) < 0.8 AND {_HIT} <= radius),
 h AS (SELECT record, min(id) FILTER (WHERE declared AND NOT denied) AS d1, count(*) FILTER (WHERE named) AS n2, first(id ORDER BY area, km, id) FILTER (WHERE named) AS f2, first(denied ORDER BY area, km, id) FILTER (WHERE named) AS x2, first(id ORDER BY area, km, id) FILTER (WHERE named AND area < 8) AS s2,
  count(*) FILTER (WHERE titled AND km <= greatest(1.5, radius * 0.95)) AS n3, first(id ORDER BY km, area, id) FILTER (WHERE titled AND km <= greatest(1.5, radius * 0.95) AND NOT denied) AS f3, count(*) FILTER (WHERE area < 8 AND km <= greatest(0.8, least(radius, 1.2)) AND (titled OR told OR (e = '' AND listed))) AS n4, first(id) FILTER (WHERE area < 8 AND km <= greatest(0.8, least(radius, 1.2)) AND (titled OR told OR (e = '' AND listed))) AS f4,
  list(km ORDER BY km, area, id) FILTER (WHERE area < 8 AND km <= greatest(0.8, least(radius, 1.2))) AS k4, first(id ORDER BY km, area, id) FILTER (WHERE area < 8 AND km <= greatest(0.8, least(radius, 1.2))) AS a4, bool_or(regexp_matches(e, '{placing.SAYS_ISLAND}')) AS says, first(id ORDER BY km, area, id) FILTER (WHERE area >= 8 AND NOT denied AND listed AND km <= radius * 0.7) AS f5 FROM f GROUP BY record),
 j AS (SELECT c.record, c.lat, castle, h.record AS hit, d1, CASE WHEN n2 > 1 THEN CASE WHEN x2 THEN s2 ELSE f2 END WHEN n2 = 1 AND NOT x2 THEN f2 END AS t2, CASE WHEN n3 = 1 THEN f3 END AS t3, CASE WHEN n4 = 1 THEN f4 WHEN says AND (len(k4) = 1 OR k4[1] + 0.2 < k4[2]) THEN a4 END AS t4, f5, coalesce(d1 IS NULL AND n2 > 1 AND x2 AND s2 IS NULL, false) AS lost FROM c LEFT JOIN h ON c.record = h.record)
 SELECT record, CASE WHEN hit IS NOT NULL AND castle THEN CASE WHEN lost THEN NULL ELSE coalesce(d1, t2, t3, t4, f5) END END AS place, CASE WHEN lat IS NULL THEN 'no coordinates' WHEN hit IS NULL THEN 'not on a known place' WHEN NOT castle THEN 'no castle' WHEN d1 IS NOT NULL THEN '{placing.REASONS[1]}' WHEN t2 IS NOT NULL THEN '{placing.REASONS[2]}' WHEN lost THEN 'the text puts it on a smaller place'
  WHEN t3 IS NOT NULL THEN '{placing.REASONS[3]}' WHEN t4 IS NOT NULL THEN '{placing.REASONS[4]}' WHEN f5 IS NOT NULL THEN '{placing.REASONS[5]}' ELSE 'no source names one place' END AS reason FROM j"""
)
def castle_records(t):
    """Castles on one of the places around them, by ordered evidence (X-06, X-05)."""
    records = durable(t.sql(_CASTLES), "records").withColumn("declared", F.when(F.col("entity").isNotNull(), F.array("entity")))
    p = durable(places(t).select(F.col("id").alias("place"), F.col("w").alias("name"), "area", "lat", "lng", F.col("wikidata").alias("entity")), "places")
    return placing.castle_places(records, p)


#: Books that tell of two places each, in a sentence.
_BOOKS = f"""SELECT item AS doc, item % 4 AS k, CASE item % 14 WHEN 0 THEN 'A novel set on the remote isle of ' || w WHEN 1 THEN 'It takes place mainly in ' || w WHEN 2 THEN 'A memoir of her childhood on ' || w WHEN 3 THEN 'It has comparisons with a book set on ' || w WHEN 4 THEN 'A story of a fictional rock, set on ' || w
 WHEN 5 THEN 'He used to live on ' || w || ', and it is set on ' || w WHEN 6 THEN 'Inspired by a voyage to the isle of ' || w WHEN 7 THEN 'Inspired by a song, it is set on ' || w WHEN 8 THEN w || ' is the setting of the novel' WHEN 9 THEN 'A guide to the birds of ' || w
 WHEN 10 THEN 'She grew up on ' || w || ' in ' || nation WHEN 11 THEN CAST(NULL AS VARCHAR(90)) WHEN 12 THEN 'Set on a far shore, it ends at Great ' || w ELSE 'He arrives in ' || w || ' of the Outer Isles' END AS body, CASE WHEN item % 9 = 0 THEN place END AS hint FROM ({ITEMS}) i JOIN ({PLACES}) p ON i.place = p.id"""
#: Three places a name, and longer names of some of them.
_NAMED = f"SELECT w AS alias, id AS place FROM ({PLACES}) a WHERE id BETWEEN 1 AND 24 UNION ALL SELECT 'Great ' || w, id FROM ({PLACES}) b WHERE id BETWEEN 1 AND 12"


def _rule(pattern: str) -> str:
    return "'" + pattern.replace("{{", "{").replace("}}", "}").replace(r"(?<!\w)", r"\b").replace(r"(?!\w)", r"\b").replace("'", "''").replace("{n}", "' || a || '") + "'"


@query(
    f"""WITH d AS (SELECT doc, hint, lower(body) AS s FROM ({plain(_BOOKS)}) x WHERE body IS NOT NULL), n AS (SELECT DISTINCT lower(alias) AS a, place FROM ({plain(_NAMED)}) x),
 m AS (SELECT doc, hint, s, a, place FROM d JOIN n ON contains(s, a) WHERE regexp_matches(s, '\\b' || a || '\\b') AND NOT regexp_matches(s, '{placing.COMPARED}') AND NOT regexp_matches(s, '\\bused to live\\b.{{0,30}}\\b' || a || '\\b') AND NOT contains(substr(s, greatest(1, strpos(s, a) - 55), least(55, strpos(s, a) - 1)), 'fictional')
  AND ({" OR ".join(f"regexp_matches(s, {_rule(p)})" for p in (*placing.SETTINGS, placing.TO_THE_ISLE))} OR (length(a) >= 8 AND regexp_matches(s, '{placing.LOOSE}'))) AND (NOT regexp_matches(s, '{placing.INSPIRED}') OR regexp_matches(s, {_rule(placing.SET_ON)}))),
 o AS (SELECT doc, place, first(a ORDER BY length(a) DESC, a DESC) AS a, any_value(s) AS s, any_value(hint) AS hint FROM m GROUP BY doc, place),
 r AS (SELECT doc, o.place, a, length(a) AS score, length(a) + 3 * len(list_filter(list_distinct([lower(nation), lower(coalesce(archipelago, ''))]), lambda t: length(t) >= 4 AND contains(s, t))) + CASE WHEN coalesce(hint = o.place, false) THEN 5 ELSE 0 END AS points, coalesce(area, 0) AS area FROM o JOIN {_P} p ON p.id = o.place),
 k AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY doc) AS c, lead(points) OVER w AS p2, lead(area) OVER w AS a2, count(*) FILTER (WHERE area > 0) OVER (PARTITION BY doc) AS sized FROM (SELECT *, max(score) OVER (PARTITION BY doc) AS best FROM r) q WHERE score >= best - 2 WINDOW w AS (PARTITION BY doc ORDER BY points DESC, area DESC, place DESC)),
 f AS (SELECT doc, CASE WHEN c = 1 OR points >= p2 + 3 OR (area > greatest(a2, 0.01) * 5 AND area >= a2 + 1) THEN place END AS place, sized FROM k WHERE i = 1)
 SELECT f.doc, coalesce(f.place, CASE WHEN f.sized = 1 THEN g.place END) AS place FROM f LEFT JOIN (SELECT doc, min(place) FILTER (WHERE area > 0) AS place FROM k GROUP BY doc) g ON f.doc = g.doc WHERE coalesce(f.place, CASE WHEN f.sized = 1 THEN g.place END) IS NOT NULL"""
)
def book_settings(t):
    """Places on which sentences set books, one of several by length, context, hint and size (X-14)."""
    docs = durable(t.sql(_BOOKS), "books").select("doc", "body", "hint")
    aliases = t.sql(_NAMED).select("alias", "place", F.lit(False).alias("is_group"), F.lit(None).cast("string").alias("not_in"))
    p = durable(places(t).select(F.col("id").alias("place"), "area", F.array("nation", "archipelago").alias("context"), F.lit(None).cast("string").alias("entity"), F.lit(False).alias("curated")), "places")
    return placing.book_places(docs, durable(aliases, "aliases"), p).select("doc", "place")


_PREFIXES = ("Songs about", "Musicians from", "Music of")
#: Categories of each item's place, and names that also mean something else.
_CATEGORIES = f"SELECT CASE item % 7 WHEN 0 THEN 'Songs about ' || w WHEN 1 THEN 'Songs about ' || w || ' Island' WHEN 2 THEN 'Category:Musicians from the Isle of ' || w || ' (rock)' WHEN 3 THEN 'Music of ' || w || ', Scotland' WHEN 4 THEN 'Music of the ' || w WHEN 5 THEN 'Albums about ' || w ELSE 'Songs about the 1990s' END || ' by ' || item AS category FROM ({ITEMS}) i JOIN ({PLACES}) p ON i.place = p.id"
_KNOWN = f"SELECT id AS place, CASE id % 3 WHEN 0 THEN w WHEN 1 THEN w || ' Island' ELSE 'Isle of ' || w END AS name, CASE WHEN id % 5 = 0 THEN 0.5 ELSE area END AS area, CASE WHEN id = 9 THEN 'rock|isle' END AS only_with FROM ({PLACES}) p WHERE id BETWEEN 1 AND 30"
_WIDER = "SELECT CASE r_regionkey WHEN 0 THEN 'Tolm' WHEN 1 THEN 'Brenna' WHEN 2 THEN 'Orran' WHEN 3 THEN 'Hesker' ELSE 'Lunna Island' END AS name, CASE r_regionkey WHEN 0 THEN 'town' WHEN 1 THEN 'elsewhere' WHEN 2 THEN 'overseas' WHEN 3 THEN 'nation' ELSE 'topic' END AS kind FROM {region}"


def _more(step: str) -> str:
    return f"list_concat(a, list_transform(a, lambda x: trim(regexp_replace({step}, '\\s+', ' ', 'g'), ' ,.;:-')))"


_KEYED = r"trim(regexp_replace(regexp_replace(regexp_replace({0}, '\(.*?\)', '', 'g'), '\b(?:isle of|island)\b', ' ', 'g'), '^\s*the\s+', ''))"


@query(
    f"""WITH c AS (SELECT DISTINCT category, trim(regexp_extract(regexp_replace(category, '^Category:', ''), '^(?:{"|".join(_PREFIXES)})\\s+(.+)$', 1), ' ,.;:-') AS p FROM ({plain(_CATEGORIES)}) x), v1 AS (SELECT category, [p] AS a FROM c WHERE p <> ''), v2 AS (SELECT category, {_more("regexp_replace(x, '\\s*\\([^)]*\\)', ' ', 'g')")} AS a FROM v1),
 v3 AS (SELECT category, {_more("string_split_regex(x, '\\s+by\\s+')[1]")} AS a FROM v2), v4 AS (SELECT category, {_more(f"regexp_replace(x, '{categories.REGION}', '')")} AS a FROM v3), v5 AS (SELECT category, {_more("regexp_replace(x, '^[Tt]he\\s+', '')")} AS a FROM v4),
 v AS (SELECT category, phrase, {_KEYED.format("phrase")} AS k FROM (SELECT category, unnest(list_distinct(list_transform(a, lambda x: lower(x)))) AS phrase FROM v5) q WHERE length(phrase) >= 3 AND NOT regexp_matches(phrase, '{categories.YEAR}')),
 p AS (SELECT place, lower(name) AS n, {_KEYED.format("lower(name)")} AS pk, coalesce(area, 0) AS area, only_with, count(*) OVER (PARTITION BY name) AS same, max(coalesce(area, 0)) OVER (PARTITION BY name) AS most FROM ({plain(_KNOWN)}) x),
 h AS (SELECT v.category, phrase, p.*, row_number() OVER (PARTITION BY v.category, phrase ORDER BY CASE WHEN phrase = n THEN 0 ELSE 1 END, area DESC, place) AS r FROM v JOIN p ON phrase = n OR (k <> '' AND k = pk)),
 j AS (SELECT h.*, kind, regexp_matches(lower(h.category), '\\b' || n || '\\b') AS says FROM h LEFT JOIN ({plain(_WIDER)}) w ON lower(w.name) = h.phrase WHERE r = 1)
 SELECT category, phrase, place, CASE WHEN kind = 'nation' THEN 'nation' WHEN kind = 'topic' THEN 'topic' WHEN NOT regexp_matches(lower(category), '\\b' || phrase || '\\b') AND NOT says THEN 'not in the category' WHEN kind = 'overseas' AND NOT regexp_matches(category, '\\b(?:{categories.HOME})\\b') THEN 'overseas' WHEN same >= 3 AND most < 20 THEN 'namesakes'
  WHEN only_with IS NOT NULL AND NOT regexp_matches(lower(category), '\\b(?:' || only_with || ')\\b') THEN 'needs a word' WHEN kind = 'town' AND NOT (says AND phrase <> n) THEN 'town' WHEN kind = 'elsewhere' AND area < 200 THEN 'elsewhere' WHEN n = phrase || ' island' AND NOT says AND area < 1 THEN 'a common word' END AS reason FROM j"""
)
def category_phrases(t):
    """Which place each form of a category's phrase means, or why it means none (X-17)."""
    known = durable(t.sql(_KNOWN), "known")
    return categories.judged_categories(durable(t.sql(_CATEGORIES), "categories"), known, t.sql(_WIDER), _PREFIXES)
