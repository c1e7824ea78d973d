"""Sets that meet under many keys at once: each key has them once, and no link is lost."""

import random

import numpy as np

from skeinframe.llm import ngram_join


def _texts():
    random.seed(3)
    words = [f"w{i}" for i in range(3000)]
    fresh = lambda n: [random.choice(words) for _ in range(n)]
    texts = []
    for copies in (220, 90, 12):
        base = fresh(110)
        for _ in range(copies):
            w = list(base)
            for _ in range(random.randint(1, 3)):
                w[random.randrange(len(w))] = f"x{random.randrange(10**6)}"
            texts.append(" ".join(w))
    passage = fresh(60)
    texts += [" ".join(passage + fresh(50)) for _ in range(120)] + [" ".join(fresh(80)) for _ in range(40)]
    return texts + ["", "two words", texts[0]]


def _closed(texts, width, percent):
    def grams(t):
        w = t.split()
        return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()

    sets, root = [grams(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


def test_near_copies_stand_once_under_their_keys(spark, monkeypatch):
    texts, seen, families_of = _texts(), [], ngram_join.families_of

    def counted(keys, *rest):
        seen.append(keys.count())
        return families_of(keys, *rest)

    monkeypatch.setattr(ngram_join, "families_of", counted)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for width, percent in ((5, 80), (3, 90)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(df, width, percent).collect()}
        assert got == _closed(texts, width, percent)
    # of the 310 near copies each had tens of keys that all the others have too
    assert max(seen) < 25_000, seen


def test_an_entry_stands_for_a_key_that_many_have():
    n = ngram_join.OFTEN + 5
    keys = np.array([7] * n + [8, 9, 8], np.int64)
    at = np.array([*range(n), 0, n, n + 1], np.int64)
    stays, m, reached = ngram_join.met_often(keys, at, n + 2)
    assert stays.sum() == 4 and keys[stays].tolist() == [7, 8, 9, 8] and m[stays].tolist() == [n, 1, 1, 1]
    assert reached.tolist() == [0] * n + [n, n + 1]
