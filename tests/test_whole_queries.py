"""Queries that take every row and the whole text, for which no SQL is given: against brute force on small tables."""

import re
import unicodedata

from skeinframe import plans


def run(spark, folder, name, **tables):
    """The query's rows as sorted tuples; tables: (rows, schema) by name."""
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
    return sorted(tuple(r) for r in plans.queries()[name](spark, str(folder)).collect())


def test_components_of_all_edges(spark, tmp_path):
    # none of these rows has l_orderkey % 101 = 0 and l_quantity > 35
    edges = [(k % 7, k % 5 * 10 + k % 7) for k in range(1, 60)] + [(50 + k, 500 + k) for k in range(4)] + [(51, 502), (51, 502)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for s, p in edges:
        a, b = sorted((root(s), root(p + 1_000_000)))
        parent[b] = a
    want = sorted((x, root(x)) for x in list(parent))
    rows = [(i + 1, p, s, 1.0) for i, (s, p) in enumerate(edges)]
    got = run(spark, tmp_path, "components_all_edges", lineitem=(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double"))
    assert len({c for _, c in want}) > 3
    assert got == want


def norm(text):
    bare = "".join(c for c in unicodedata.normalize("NFKD", text) if not "\u0300" <= c <= "\u036f")
    return re.sub("[^a-z0-9]+", " ", bare.lower()).strip(" ")


def test_whole_texts_are_folded(spark, tmp_path):
    texts = ["Short: Café!", "É, déjà " * 300 + "the End.", "x" * 399 + "É-ÿ" + "z" * 50_000, "", None, "?! " * 500]
    got = run(spark, tmp_path, "folded_whole_text", documents=(list(enumerate(texts)), "doc_id long, text string"))
    assert got == [(i, norm(x or "")) for i, x in enumerate(texts)]


def test_names_in_whole_documents(spark, tmp_path):
    names = [(1, "blue anvil"), (2, "Blue  Anvil"), (3, "anvil"), (4, "red"), (5, "long blue anvil stand"), (6, "zinc kettle"), (7, None), (8, "é!tin cup"), (9, "")]
    texts = ["a blue-anvil", "anvils, blue anvils", "word " * 3000 + "Zinc\nKettle.", "the long blue anvil stand and the zinc kettle", "red red", "le tour de France en la mer", None, "", "anvil", "E tin cup", "x " * 200 + "of the of"]
    texts += ["zinc kettle", "kettle zinc", "tin blue anvil zinc kettle"]
    spelt = [(i, norm(n or "")) for i, n in names] + [(-1, "en la"), (-2, "the of")]
    want = []
    for d, x in enumerate(texts):
        hits = [(-len(n), i) for i, n in spelt if len(n) >= 5 and f" {n} " in f" {norm(x or '')} "]
        want += [(d, min(hits)[1])] if hits else []
    got = run(spark, tmp_path, "substring_join_documents", documents=(list(enumerate(texts)), "doc_id long, text string"), part=(names, "p_partkey long, p_name string"), region=([(0,)], "r_regionkey int"))
    assert len(want) > 8
    assert got == want


def test_units_of_all_customers(spark, tmp_path):
    rows = [(1, -999.0), (2, -100.0), (3, -0.5), (4, 0.5), (5, 50.0), (6, 2000.0), (7, 6561.0), (8, 6562.0), (9, 9999.0), (10, 7000.0)]
    got = run(spark, tmp_path, "parsed_units_all", customer=(rows, "c_custkey long, c_acctbal double"))
    band = lambda x: None if x < 0 else 1 if x < 1 else 2 if x < 100 else 3
    assert got == [(k, band(x), round(x * 0.3048, 4) if -50 <= x * 0.3048 <= 2000 else None) for k, x in rows]
