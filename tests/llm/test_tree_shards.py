"""The distributed tree against a plain one in numpy."""

import numpy as np

from skeinframe.llm import sharding
from tests.conftest import DATA


def plain_leaves(x, w, target):
    """Sets of rows, by recursion: cut the widest dimension at the weighted median until a node is light or one point."""

    def cut(rows):
        span = [x[rows, d].max() - x[rows, d].min() for d in range(x.shape[1])]
        d = int(np.argmax(span[:-1])) if max(span[:-1]) else x.shape[1] - 1
        if w[rows].sum() <= target or not span[d]:
            return [frozenset(rows)]
        values = sorted(set(x[rows, d]))
        half = next(v for v in values if 2 * sum(w[r] for r in rows if x[r, d] <= v) >= w[rows].sum())
        at = half if half < values[-1] else values[-2]
        return cut([r for r in rows if x[r, d] <= at]) + cut([r for r in rows if x[r, d] > at])

    return cut(list(range(len(w))))


def compare(spark, docs, monkeypatch, shards=8):
    atoms = sharding.atoms_of(sharding.documents_meta(docs))
    rows = atoms.toPandas()
    x, w = rows[list(sharding.DIMS)].to_numpy(), rows["weight"].to_numpy()
    target = int(w.sum()) // (shards * sharding.LEAVES)
    want = {frozenset(rows.text_hash.iloc[list(s)]) for s in plain_leaves(x, w, target)}
    for most in (10, 200, 50_000):  # levels cut in the cluster, in part, and none
        monkeypatch.setattr(sharding, "TASK_ATOMS", most)
        got = sharding.kd_leaves(sharding.atoms_of(sharding.documents_meta(docs)), target).toPandas()
        assert {frozenset(g.text_hash) for _, g in got.groupby(["node", "leaf"])} == want
        assert sorted(got.text_hash) == sorted(rows.text_hash)
    return rows


def test_same_leaves_as_a_plain_tree(spark, monkeypatch):
    compare(spark, spark.read.parquet(f"{DATA}/documents.parquet"), monkeypatch)


def test_same_leaves_with_ties(spark, monkeypatch):
    rows = [(i // 7, f"text {i % 700:03d}" + "x" * (i % 3), "en" if i % 3 else None, f"s{i % 2}") for i in range(900)]
    compare(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), monkeypatch)


def test_every_text_goes_down_the_tree_and_shards_are_even(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = sharding.kd_shards(docs, 8).toPandas()
    sums = got.groupby("shard")["size"].sum()
    assert len(got) == docs.count() and len(sums) == 8
    assert sums.max() - sums.min() < 0.05 * sums.mean()
    assert got.groupby("text_crc32").shard.nunique().max() == 1


def test_runs_of_leaves_keep_neighbours_and_are_even():
    rng = np.random.default_rng(3)
    even = rng.integers(90, 110, 4000)
    home = sharding.runs_of_leaves(even, np.zeros(8, np.int64))
    assert (np.diff(home) >= 0).all() and set(home) == set(range(8))
    for weights, filled in ((rng.integers(1, 4000, 200), np.zeros(8, np.int64)), (np.r_[rng.integers(1, 9, 900), 700, 650, 400], np.array([0, 0, 500, 0, 90, 0, 0, 0])), (np.array([5, 5, 5]), np.zeros(8, np.int64)), (np.zeros(0, np.int64), np.zeros(4, np.int64))):
        home = sharding.runs_of_leaves(weights, filled)
        sums = filled + np.bincount(home, weights, len(filled))
        assert len(home) == len(weights) and sums.sum() == weights.sum() + filled.sum()
        if len(weights) > 100:
            assert sums.max() - sums.min() <= 0.02 * sums.mean()


def test_shards_are_regions_of_the_tree(spark, monkeypatch):
    # texts that differ in their ids alone: shards are ranges of ids
    docs = spark.createDataFrame([(i, f"text {i:05d} " + "w " * 20, "en", "s") for i in range(3000)], "doc_id long, text string, lang string, source string")
    got = sharding.kd_shards(docs, 8).toPandas()
    assert (got.groupby("shard").doc_id.agg(lambda d: d.max() - d.min() + 1) == got.groupby("shard").doc_id.count()).all()
    sums = got.groupby("shard")["size"].sum()
    assert sums.max() - sums.min() < 0.02 * sums.mean()
