"""The queries opN_<name> and their SQL. Each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitslice, conversation_repair, language_id, line_quality, minmax_dedup, ngram_join, packing, pair_bpe, periodic_runs, sharding, token_files, toxicity, url_filter
from .common import read_table


def op1_arrow_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_documents(read_table(spark, sf_dir, "documents"), digests=True)


def op2_line_frequency_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.line_frequency_rules(read_table(spark, sf_dir, "documents"))


def op3_byte_cnn_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.train(docs))


def op4_pair_index_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_bpe.encode_decode(read_table(spark, sf_dir, "documents"), digests=True)


def op5_url_redirect_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(read_table(spark, sf_dir, "pages"))


def op6_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(read_table(spark, sf_dir, "documents"), 3, 90)


def op8_linear_grouping_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), derive={"ids_crc32": F.crc32("ids")})


def op9_bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitslice.top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.kd_shards(read_table(spark, sf_dir, "documents"), 8)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic_runs.with_planted_runs(read_table(spark, sf_dir, "documents"))
    return periodic_runs.run_digests(periodic_runs.periodic_runs(docs))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations")
    return conversation_repair.repair_digests(turns.select("conv_id"), conversation_repair.repair(conversation_repair.damaged(turns)))


def op13_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax_dedup.minmax_components(read_table(spark, sf_dir, "documents"))


ALL = (
    op1_arrow_token_files, op2_line_frequency_quality, op3_byte_cnn_language, op4_pair_index_bpe, op5_url_redirect_filter, op6_weak_toxicity, op7_ngram_jaccard_join,
    op8_linear_grouping_packing, op9_bit_sliced_top_k, op10_kd_sharding, op11_periodic_runs, op12_conversation_repair, op13_minmax_dedup,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}


_OP2_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS host, row_number() OVER () AS rid FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
ww AS (SELECT rid, ws, unnest(generate_series(1, len(ws) - 7)) AS i FROM w WHERE len(ws) >= 8),
win AS (SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS g FROM ww),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) q WHERE c > 1),
cov AS (SELECT rid, sum(least(8, i - coalesce(prev, i - 8))) AS n FROM (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS prev FROM twice) q GROUP BY rid),
ln AS (SELECT rid, host, t, unnest(ls) AS line FROM w),
nl AS (SELECT rid, host, t, lower(regexp_replace(regexp_replace(trim(translate(line, chr(9) || chr(11) || chr(12) || chr(13), '    '), ' '), ' {2,}', ' ', 'g'), '[0-9]', '0', 'g')) AS k, len(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS nw FROM ln),
common AS (SELECT host, k FROM nl GROUP BY host, k HAVING count(DISTINCT rid) > 20),
lost AS (SELECT rid, sum(nw) AS n FROM nl JOIN common ON nl.host = common.host AND nl.k = common.k GROUP BY rid),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
 CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
 CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS n_removed_words
 FROM w LEFT JOIN cov ON w.rid = cov.rid LEFT JOIN lost ON w.rid = lost.rid)
SELECT *, n_words - n_removed_words AS n_kept_words, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
 NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT (n_removed_words > 0 AND (n_words - n_removed_words < 20 OR n_words - n_removed_words < 0.3 * n_words)) AS kept FROM m
"""

#: Links as the operator finds and resolves them, by its patterns.
_OP5_SQL = r"""
WITH RECURSIVE p0 AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
tag AS (SELECT url, unnest(list_concat(list_transform(regexp_extract_all(html, '{canonical}'), lambda x: regexp_extract(x, '{href}', 1)), list_transform(regexp_extract_all(html, '{refresh}'), lambda x: regexp_extract(x, '{target}', 1)))) AS link FROM p0 WHERE url IS NOT NULL),
parts AS (SELECT url, replace(link, '&amp;', '&') AS l, regexp_extract(url, '^([^:/?#]+:)//', 1) AS scheme, regexp_extract(url, '^([^:/?#]+://[^/?#]*)', 1) AS origin, regexp_extract(url, '(?s)^([^?#]*)', 1) AS page FROM tag WHERE link <> ''),
whole AS (SELECT url, CASE WHEN regexp_matches(l, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN l WHEN origin = '' OR regexp_matches(l, '^(?:#|[A-Za-z][A-Za-z0-9+.-]*:)') THEN NULL WHEN starts_with(l, '//') THEN scheme || l WHEN starts_with(l, '/') THEN origin || l WHEN starts_with(l, '?') THEN page || l
 ELSE origin || coalesce(nullif(regexp_extract(substr(page, length(origin) + 1), '(?s)^(.*/)', 1), ''), '/') || l END AS v FROM parts),
cut AS (SELECT url, v, regexp_extract(v, '(?s)^([^:/?#]*://[^/?#]*)', 1) AS head, regexp_extract(v, '(?s)^[^:/?#]*://[^/?#]*([^?#]*)', 1) AS path FROM whole WHERE v IS NOT NULL),
kept AS (SELECT *, list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform(list_slice(string_split(path, '/'), 2, len(string_split(path, '/'))), lambda x: [x])), lambda t, x: CASE WHEN x[1] = '..' THEN list_slice(t, 1, greatest(len(t) - 1, 0)) WHEN x[1] = '.' THEN t ELSE list_concat(t, x) END) AS k FROM cut),
absl AS (SELECT url, CASE WHEN contains(path, '/.') THEN head || '/' || array_to_string(k, '/') || CASE WHEN regexp_matches(path, '/\.\.?$') AND len(k) > 0 THEN '/' ELSE '' END || substr(v, length(head) + length(path) + 1) ELSE v END AS v FROM kept),
key AS (SELECT x AS u, lower(regexp_extract(regexp_extract(x, '^([^#]*)', 1), '^([^:/?#]*://[^/?#]*)', 1)) || substr(regexp_extract(x, '^([^#]*)', 1), length(regexp_extract(regexp_extract(x, '^([^#]*)', 1), '^([^:/?#]*://[^/?#]*)', 1)) + 1) AS k
 FROM (SELECT url AS x FROM p0 UNION SELECT v FROM absl WHERE v IS NOT NULL) q WHERE x IS NOT NULL),
e AS (SELECT a.k AS u, b.k AS v FROM absl JOIN key a ON absl.url = a.u JOIN key b ON absl.v = b.u WHERE a.k <> b.k),
e2 AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
reach(a, b) AS (SELECT u, v FROM e2 UNION SELECT reach.a, e2.v FROM reach JOIN e2 ON reach.b = e2.u),
comp AS (SELECT a AS k, min(least(a, b)) AS c FROM reach GROUP BY a),
urls AS (SELECT k AS x, k FROM comp UNION ALL SELECT url, NULL FROM p0),
hp AS (SELECT DISTINCT x, CASE WHEN strpos(x, '://') > 0 THEN lower(regexp_extract(substr(x, strpos(x, '://') + 3), '^([^/?#]*)', 1)) ELSE '' END AS host,
 CASE WHEN strpos(x, '://') > 0 THEN regexp_extract(substr(x, strpos(x, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM urls),
ru AS (SELECT x, host, path, CASE WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
 WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
 WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/' WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
 WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM hp),
rv AS (SELECT *, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS own FROM ru),
grp AS (SELECT c, max(CASE own WHEN 'allow' THEN 2 WHEN 'block' THEN 1 ELSE 0 END) AS g FROM comp LEFT JOIN rv ON comp.k = rv.x GROUP BY c)
SELECT page_id, coalesce(rv.host, '') AS host, coalesce(rv.path, '') AS path, rv.rule AS rule, coalesce(rv.own, CASE g WHEN 2 THEN 'allow' WHEN 1 THEN 'block' END, 'allow') AS verdict, comp.c AS alias_of
FROM p0 LEFT JOIN rv ON p0.url = rv.x LEFT JOIN key ON p0.url = key.u LEFT JOIN comp ON key.k = comp.k LEFT JOIN grp ON comp.c = grp.c
"""

_NGRAM_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {width} - 1], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - {width} + 1, 1))) AS i FROM d WHERE len(w) > 0) q),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
inter AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT x, y FROM inter JOIN n p ON x = p.doc_id JOIN n q ON y = q.doc_id WHERE 100 * c >= {percent} * (p.n + q.n - c)),
e2 AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
reach(a, b) AS (SELECT x, y FROM e2 UNION SELECT reach.a, e2.y FROM reach JOIN e2 ON reach.b = e2.x),
comp AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(comp.b, d.doc_id)) AS component_id{more} FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN comp ON d.doc_id = comp.a
"""

_OP9_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
 WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r, a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 20 = 0)
SELECT query_id, rank, vec_id, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s) t WHERE rank <= 20
"""


def _op5_sql() -> str:
    names = {"canonical": url_filter.CANONICAL, "refresh": url_filter.REFRESH, "href": url_filter.HREF, "target": url_filter.REFRESH_URL}
    out = _OP5_SQL
    for name, pattern in names.items():
        out = out.replace("{" + name + "}", pattern.replace("'", "''"))
    return out


def oracle_sql() -> dict[str, str]:
    return {
        "op2_line_frequency_quality": _OP2_SQL, "op5_url_redirect_filter": _op5_sql(), "op7_ngram_jaccard_join": _NGRAM_SQL.format(width=3, percent=90, more=""), "op9_bit_sliced_top_k": _OP9_SQL,
        "op13_minmax_dedup": _NGRAM_SQL.format(width=5, percent=85, more=", d.doc_id <= coalesce(comp.b, d.doc_id) AS kept"),
    }
