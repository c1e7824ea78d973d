"""Min-max hashing: exact components on whole texts, an unbiased estimate, groups above the bound of a hot key."""

import random

import numpy as np
import pytest

from skeinframe.llm import minmax_dedup as m
from skeinframe.llm import ngram_join
from skeinframe.llm import queries as q
from tests.conftest import DATA


def grams(text, k=5):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def plain(texts, percent=85):
    """{id: (size, component, kept)} by comparing all pairs."""
    sets = {i: grams(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_query_equals_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    assert got(q.op13_minmax_dedup(spark, DATA)) == plain(texts)


def test_estimate_is_unbiased_and_has_less_variance():
    rng = np.random.default_rng(3)
    both, mins = [], []
    for _ in range(120):
        a = rng.integers(-(2**62), 2**62, 150)
        x, y = np.unique(a[:125]), np.unique(a[25:])
        u, v = m.signature(x), m.signature(y)
        both.append((u == v).mean())
        mins.append((m.signature(x, 2 * m.PERMUTATIONS)[::2] == m.signature(y, 2 * m.PERMUTATIONS)[::2]).mean())
    assert abs(np.mean(both) - 100 / 150) < 0.02
    assert np.var(both) < 1.2 * np.var(mins)  # as many values from half the hashes


def test_long_sets_in_parts(monkeypatch):
    t = np.random.default_rng(1).integers(-(2**62), 2**62, 9000)
    whole = m.band_keys(t)
    monkeypatch.setattr(m, "PART", 100)
    assert (m.band_keys(t) == whole).all() and len(whole) == 2 * m.PERMUTATIONS // m.BAND


@pytest.mark.parametrize("hot", [512, 20])
def test_groups_of_copies_and_shared_passages(spark, monkeypatch, hot):
    """hot = 20 puts the large groups above the bound of a hot key."""
    monkeypatch.setattr(ngram_join, "HOT", hot)
    random.seed(4)
    words = [f"w{i}" for i in range(900)]
    base = [random.choice(words) for _ in range(120)]
    texts = []
    for _ in range(60):  # one large group of near copies, some of them on the edge
        w = list(base)
        for _ in range(random.randint(0, 3)):
            w[random.randrange(len(w))] = random.choice(words)
        texts.append(" ".join(w))
    passage = " ".join(random.choice(words) for _ in range(60))
    texts += [passage + " " + " ".join(random.choice(words) for _ in range(random.choice([6, 12, 25]))) for _ in range(60)]
    texts += ["only two", "Only TWO", "", None, " \n ", "five words in this text", texts[0], texts[0].upper(), "x " * 30000, "x " * 29000]
    rows = [(i, t, "clash", "clash") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, row string")
    assert got(m.minmax_components(df)) == plain(dict(enumerate(texts)))


def test_null_and_repeated_ids_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (9, "a b c d e f"), (3, "other text here")], "doc_id long, text string")
    found = sorted(map(str, ((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in m.minmax_components(df).collect())))
    assert found == sorted(map(str, [(None, 2, None, True), (3, 2, 3, True), (3, 2, 3, True), (9, 2, 3, False), (3, 1, 3, True)]))
    assert m.minmax_components(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        m.minmax_components(df, permutations=5, band=4)
