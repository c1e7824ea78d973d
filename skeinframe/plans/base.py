"""Place records, cited items and routes made from the star tables by plain SQL, which Spark and the oracle both run."""

from __future__ import annotations

from .registry import Tables, plain


def word(key: str) -> str:
    words = ("Skarva", "Tolm", "Brenna", "Orran", "Hesker", "Lunna", "Fiala", "Mirren")
    return f"CASE {key} % {len(words)} " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(words)) + " END"


def pick(key: str, *values: str | None) -> str:
    """One of some texts by a number."""
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN " + ("CAST(NULL AS VARCHAR(40))" if v is None else f"'{v}'") for i, v in enumerate(values)) + " END"


#: Customers as places.
PLACES = f"""SELECT c_custkey AS id,
 CASE c_custkey % 9 WHEN 0 THEN 'Isle of ' || w WHEN 1 THEN w || ' Island' WHEN 2 THEN 'Oileán ' || w WHEN 3 THEN w || ' (North)' WHEN 4 THEN 'the ' || w WHEN 5 THEN 'Great ' || w || ' Rocks'
  WHEN 6 THEN 'Eilean Mór ' || w WHEN 7 THEN '' ELSE w END AS name,
 n_name AS nation, {pick('c_custkey', 'sea', 'lake', 'river')} AS type, {pick('c_custkey', 'tidal', 'estuary', None, 'reservoir', None)} AS subtype,
 {pick('c_nationkey', 'Outer Isles', 'Inner Isles', None, 'Northern Group')} AS archipelago, {pick('c_custkey', 'Loch Varn', None, 'Lough Tolm', None)} AS water,
 50 + CAST(c_custkey * 37 % 997 AS DOUBLE) / 100 AS lat, -9 + CAST(c_custkey * 53 % 1009 AS DOUBLE) / 100 AS lng,
 CASE WHEN c_custkey % 11 = 0 THEN CAST(NULL AS DOUBLE) ELSE abs(c_acctbal) / 40 END AS area, CASE WHEN c_custkey % 4 = 0 THEN CAST(NULL AS BIGINT) ELSE c_custkey % 7 * (c_custkey % 101) END AS population,
 CASE WHEN c_custkey % 5 = 0 THEN CAST(NULL AS DOUBLE) ELSE CAST(c_custkey * 13 % 900 AS DOUBLE) END AS elevation, c_custkey % 6 = 0 AS ferry, c_custkey % 13 = 0 AS for_sale, c_custkey % 2 = 0 AS has_photo, c_custkey % 10 = 0 AS tidal,
 {pick('c_custkey', 'curated', 'osm', 'csv', 'discovery', 'osm')} AS source, {pick('c_custkey', 'high', 'unconfirmed', 'medium', None)} AS confidence,
 CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment || ' by the shore of ' || w || '. A castle and a lighthouse stand there.' END AS description, {pick('c_custkey', 'Settled early.', None, '')} AS history,
 CASE WHEN c_custkey % 4 = 1 THEN CAST(NULL AS VARCHAR(40)) ELSE 'Q' || CAST(c_custkey AS VARCHAR(20)) END AS wikidata, {pick('c_custkey', 'https://wiki.org/a', None)} AS wikipedia,
 {pick('c_custkey', 'way', 'relation', 'node', None)} AS map_type, CASE WHEN c_custkey % 4 = 3 THEN CAST(NULL AS BIGINT) ELSE c_custkey * 10 END AS map_id, w
 FROM (SELECT *, {word('c_custkey')} AS w FROM {{customer}}) c JOIN {{nation}} n ON c_nationkey = n_nationkey"""

#: Orders as cited items of places.
ITEMS = f"""SELECT o_orderkey AS item, o_custkey AS place, {pick('o_orderkey', 'unusual-news', 'island-castles', 'unusual-wildlife', 'whisky-distilleries', 'island-books', 'local-traditions', 'film-art-music', 'tidal-islands', 'for-sale')} AS slug,
 CASE o_orderkey % 10 WHEN 0 THEN 'The castaway of ' || w WHEN 1 THEN w || ' Castle' WHEN 2 THEN w || ' vole' WHEN 3 THEN 'Oldest peated distillery' WHEN 4 THEN 'A novel of the sea' WHEN 5 THEN 'Harris tweed' WHEN 6 THEN 'Highlander' WHEN 7 THEN 'Tower house' WHEN 8 THEN 'King of the rock' ELSE 'Private island' END AS title,
 CASE o_orderkey % 6 WHEN 0 THEN 'An endemic race found only on ' || w || ' and nowhere else in the whole of the north.' WHEN 1 THEN 'A mansion in the gothic revival manner.' WHEN 2 THEN 'Founded early; the only one of its kind. ' || o_orderpriority WHEN 3 THEN 'A memoir in three parts, with a fire and a wreck in it.' WHEN 4 THEN 'Seen in Scotland, ' || w || ' and France; now extinct.' ELSE CAST(NULL AS VARCHAR(80)) END AS summary,
 {pick('o_orderkey', 'distillery', 'film', 'music', 'artwork', 'silent', None, 'story')} AS facet, {pick('o_orderkey', 'islay', None, 'orkney')} AS subdivision, {pick('o_orderkey', 'subject', 'stand-in', None)} AS picture,
 CASE o_orderstatus WHEN 'O' THEN 'accepted' WHEN 'F' THEN 'accepted' ELSE 'candidate' END AS status, o_orderdate AS fetched_at, {pick('o_orderkey', 'Wiki', 'Gazette', 'Survey')} AS source_title, {pick('o_orderkey', 'https://a.org/1', 'http://b.org/2', 'ftp://c.org/3', None)} AS source_url
 FROM (SELECT *, {word('o_custkey')} AS w FROM {{orders}}) o"""


def places(t: Tables):
    return t.sql(PLACES)


def items(t: Tables):
    return t.sql(ITEMS)


PLACES_SQL, ITEMS_SQL = f"({plain(PLACES)})", f"({plain(ITEMS)})"
