"""The eleven queries on the smallest tables: against SQL where there is some, else against brute force or held-out rows."""

import hashlib
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from skeinframe.llm import queries as q
from skeinframe.llm.common import tokenizer_path
from tests.conftest import DATA, rows_of

Q, SQL = q.queries(), q.oracle_sql()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").toPandas().sort_values("doc_id").reset_index(drop=True)


@pytest.fixture(scope="module")
def ids(docs):
    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    return [e.ids for e in t.encode_batch([x or "" for x in docs.text], add_special_tokens=False)]


def packed(x):
    return np.array(x, "<u4").tobytes()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, duck, name):
    assert rows_of(Q[name](spark, DATA).toPandas()) == rows_of(duck.execute(SQL[name]).df())


def test_op1(spark, docs, ids):
    got = Q["op1_arrow_token_files"](spark, DATA).toPandas().sort_values("doc_id")
    start, want = 0, []
    for d, x in zip(docs.doc_id, ids):
        want.append((d, start, len(x) + 1, zlib.crc32(packed([*x, 2]))))
        start += len(x) + 1
    assert list(got[["doc_id", "start", "n_tokens", "ids_crc32"]].itertuples(index=False, name=None)) == want


def test_op3_held_out_accuracy(spark, docs):
    got = Q["op3_byte_cnn_language"](spark, DATA).toPandas().merge(docs[["doc_id", "lang"]], on="doc_id")
    held = got[got.held_out]
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    assert (held.lang_pred == held.lang).mean() > 0.9
    assert got.score.between(0, 1).all()


def test_op4(spark, docs, ids):
    got = Q["op4_pair_index_bpe"](spark, DATA).toPandas().sort_values("doc_id")
    want = [(d, len(x), hashlib.sha256(packed(x)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for d, t, x in zip(docs.doc_id, docs.text, ids)]
    assert list(got[["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]].itertuples(index=False, name=None)) == want


def test_op6_on_rows_held_out(spark):
    big = "/root/testdata/sf0.1"
    got = Q["op6_weak_toxicity"](spark, big).toPandas().merge(spark.read.parquet(f"{big}/labels.parquet").toPandas(), on="doc_id")
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    held = got[got.held_out]
    assert (held[held.toxic == 1].predicted == 1).mean() >= 0.9
    assert (held[held.toxic == 0].predicted == 1).mean() <= 0.02
    assert ((got.score >= 0.5) == (got.predicted == 1)).all() and got.score.between(0, 1).all()


def whole_packing(rows, docs, ids, capacity=2048):
    by = rows.sort_values(["doc_id", "piece"]).groupby("doc_id")
    for d, x in zip(docs.doc_id, ids):
        x = [*x, 0]
        g = by.get_group(d)
        k = -(-len(x) // capacity)
        assert list(g.length) == [len(x) - capacity * (k - 1)] + [capacity] * (k - 1)
        assert list(g.ids_crc32) == [zlib.crc32(packed(x[s : s + n])) for s, n in zip(g.start, g.length)]
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert list(g.offset) == [0, *np.cumsum(g.length)[:-1]]
        assert g.length.sum() <= capacity


def test_op8(spark, docs, ids):
    got = Q["op8_linear_grouping_packing"](spark, DATA).toPandas()
    whole_packing(got, docs, ids)
    assert got.sequence_id.nunique() <= 1.03 * -(-got.length.sum() // 2048) + 1


def test_op10(spark, docs):
    got = Q["op10_kd_sharding"](spark, DATA).toPandas().sort_values("doc_id")
    assert list(got["size"]) == [len((t or "").encode()) + 1 for t in docs.text]
    assert list(got.text_crc32) == [zlib.crc32((t or "").encode()) for t in docs.text]
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    sums = got.groupby("shard")["size"].sum()
    assert len(sums) == 8
    assert sums.max() - sums.min() < 0.05 * sums.mean()
    both = got.merge(docs[["doc_id", "text"]], on="doc_id")
    assert (both.groupby("text").shard.nunique() == 1).all()


def test_pipeline_stages(spark, docs):
    first = spark.read.parquet(f"{DATA}/documents.parquet")
    named = corpus_pipeline.identified(spark, first, DATA)
    assert named.columns == first.columns
    assert named.count() > 0.95 * len(docs)
    kept = corpus_pipeline.without_near_duplicates(spark, first, DATA).toPandas()

    def grams(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = dict(zip(docs.doc_id, map(grams, docs.text)))
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    order = list(sets)
    for i, a in enumerate(order):
        for b in order[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                r, s = sorted((root(a), root(b)))
                parent[s] = r
    assert sorted(kept.doc_id) == [d for d in order if root(d) == d]
    assert len(corpus_pipeline.STAGES) == 4
    assert corpus_pipeline.run(spark, DATA).count() > 0


def test_pipeline_on_odd_and_empty_tables(spark, tmp_path):
    rows = [(1, None, None, None), (1, "a b c d e f", "en", "s"), (1, "a b c d e f", "en", "s"), (None, "der und die das", "de", None), (4, "", "en", "s"), (5, "123 456", None, "s"), (6, "the cat and the dog " * 300, "en", "s")]
    schema = "doc_id long, text string, lang string, source string"
    for name, docs, marks in (("odd", rows, [(1, 0, 1), (6, 1, 0), (99, 0, None)]), ("empty", [], [])):
        folder = f"file://{tmp_path}/{name}"
        spark.createDataFrame(docs, schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        got = corpus_pipeline.run(spark, folder).toPandas()
        assert set(got.columns) >= {"doc_id", "piece", "sequence_id", "offset"}
        assert (len(got) == 0) == (name == "empty")
        if name == "odd":
            assert set(got.doc_id.dropna()) <= {1, 6} and got.sequence_id.notna().all()
