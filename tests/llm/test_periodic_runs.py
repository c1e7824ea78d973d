"""Runs of words against a plain search for each period, and planted runs in whole texts."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from skeinframe.llm import periodic_runs as p
from skeinframe.llm import queries as q
from tests.conftest import DATA


def plain_runs(w, min_length=6, min_exponent=4):
    found = {}
    for period in range(1, len(w) // min_exponent + 1):
        i = 0
        while i < len(w) - period:
            j = i
            while j < len(w) - period and w[j] == w[j + period]:
                j += 1
            if j + period - i >= max(min_length, min_exponent * period):
                found.setdefault((i, j + period), period)
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_digests(doc_id, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(w), h // 10
    if h % 10 == 0 and n:
        a = g % n
        period = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % period] for i, x in enumerate(w)]
    runs = plain_runs(w)
    gone = {i for s, length, period in runs for i in range(s + period, s + length)}
    lines = "".join(f"{s},{length},{period}\n" for s, length, period in runs)
    best = (None,) * 4
    for s, length, period in runs:
        if best[0] is None or length * best[2] > best[1] * period:
            best = (s, length, period, 1000 * length // period)
    return (doc_id, len(runs), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()), key=str)


@pytest.mark.parametrize("min_length,min_exponent", [(6, 4), (2, 2), (6, 2), (9, 3)])
def test_runs_equal_a_plain_search(min_length, min_exponent):
    random.seed(min_length)
    for _ in range(1500):
        n, kinds = random.randint(0, 80), random.choice([1, 2, 3, 5])
        w = [random.randrange(kinds) for _ in range(n)]
        if n and random.random() < 0.5:
            a, period = random.randrange(n), random.randint(1, max(1, n // 3))
            w = [w[i] if i < a else w[a + (i - a) % period] for i in range(n)]
        assert p.runs_of(np.array(w, np.int32), min_length, min_exponent) == plain_runs(w, min_length, min_exponent)


def test_mask_passes_no_word_of_plain_prose():
    words = np.arange(5000)
    assert not p.repeated(words, p.least_overlap(6, 4)).any()
    words[3000:3012] = words[2000:2003].tolist() * 4
    covered = np.flatnonzero(p.repeated(words, p.least_overlap(6, 4)))
    assert (covered.min(), covered.max()) == (3000, 3011)
    assert p.least_overlap(6, 4) == 5 and p.least_overlap(2, 2) == 1


def test_query_equals_a_plain_search(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(q.op11_periodic_runs(spark, DATA)) == sorted((plain_digests(*d) for d in docs), key=str)


def test_odd_texts(spark):
    texts = [None, "", " \t\n\x0b ", "a", "a a a a a a", "\na  a\ta a a a\x0c", "b " * 5000, "x y " * 9 + "ü 中 ü 中 ü 中 ü 中", "a a " * 7]
    ids = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 10 == 0][: len(texts)] + list(range(len(texts)))
    rows = [(i, t, "x", 1) for i, t in zip(ids, texts * 2)] + [(None, "a b " * 6, "x", 1), (5, "a b " * 6, None, None), (5, "a b " * 6, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string, start int")
    got = rows_of(p.run_digests(p.periodic_runs(p.with_planted_runs(df))))
    assert got == sorted((plain_digests(i, t) for i, t, *_ in rows), key=str)
    assert p.run_digests(p.periodic_runs(p.with_planted_runs(df.limit(0)))).count() == 0
    long = spark.createDataFrame([(1, "one two three " * 60000)], "doc_id long, text string")
    assert [(r.start, r.length, r.period) for r in p.periodic_runs(long).first().runs] == [(0, 180000, 3)]
