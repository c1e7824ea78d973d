"""Nulls, empty tables, repeats, ties, special tokens, hot groups and clashing columns."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skeinframe.llm import bitslice, encoding, language_id, line_quality, ngram_join, packing, pair_bpe, sharding, token_files, toxicity, url_filter
from skeinframe.llm.common import tokenizer_path
from skeinframe.operators import graph

PATH = tokenizer_path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, row string"
ODD = [(3, "a b c d", "en", "s", 7, "x", "y"), (1, None, None, None, None, None, None), (1, None, None, None, None, None, None), (None, "b " * 5000, "fr", "s", 1, "x", "y"), (2, "", "en", None, 0, "x", "y"), (3, "a b c d", "en", "s", 7, "x", "y"), (5, " \t\n ", "de", "s", 4, "x", "y")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def test_every_operator_takes_odd_rows_and_empty_tables(spark, odd):
    none = odd.limit(0)
    net = language_id.fit(["the cat and dog " * 9, "der und die das " * 9], ["en", "de"], epochs=1)
    runs = {
        "token files": token_files.token_documents, "quality": line_quality.line_frequency_rules, "language": lambda d: language_id.identify(d, net), "no language": lambda d: language_id.identify(d, None),
        "bpe": pair_bpe.encode_decode, "toxicity": lambda d: toxicity.score_toxicity(d, None), "join": ngram_join.ngram_components, "sharding": sharding.kd_shards,
    }
    for name, run in runs.items():
        assert run(odd).count() == len(ODD), name
        assert run(none).count() == 0, name
    assert packing.pack_documents(odd).select("doc_id").distinct().count() == 5
    assert packing.pack_documents(none).count() == 0
    assert language_id.keep_identified(odd, net).columns == odd.columns
    # without a fitted model both filters keep every row
    assert language_id.keep_identified(odd, None).count() == toxicity.keep_clean(odd, None).count() == len(ODD)
    pages = spark.createDataFrame([(1, "http://a.net/es/1", "x", "block"), (1, "http://a.net/es/1", "x", "block")], "page_id long, url string, html string, verdict string")
    assert [r.verdict for r in url_filter.judge_urls(pages).collect()] == ["block", "block"]
    assert url_filter.judge_urls(pages.limit(0)).count() == 0
    assert ngram_join.one_of_each_group(odd).filter("doc_id = 3").count() == 2


def test_join_of_odd_rows(odd):
    got = sorted(map(str, ((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_components(odd).collect())))
    assert got == sorted(map(str, [(3, 2, 3), (3, 2, 3), (1, 0, 1), (1, 0, 1), (None, 1, None), (2, 0, 2), (5, 0, 5)]))


def test_encoders_equal_the_library():
    t = Tokenizer.from_file(PATH)
    random.seed(1)
    letters = " \n\t\r    　\x1c\x85'sdtlmreve.,!?123aabcdefZéß中٠́\U0001f600"
    texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 60))) for _ in range(800)]
    texts += ["", " ", "  ", " a", "a ", "\n\n a", "a  b", "a <|endoftext|> b<|endoftext|><|endoftext|>", "a" * 50, "don't I'll 's", "x" * 3000, "w\n\n\nT"]
    texts += ["".join(map(chr, range(a, min(a + 97, 0xD800)))) for a in range(0, 0x3000, 97)]
    want = [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch(texts, add_special_tokens=False)]
    for kind in (encoding.ChunkEncoder, pair_bpe.PairIndexEncoder):
        assert kind(PATH).encode_many(texts) == want
        small = kind(PATH, kept=5)  # a table that is full all the time
        assert [b for s in range(0, len(texts), 7) for b in small.encode_many(texts[s : s + 7])] == want
    codec = pair_bpe.pair_encoder(PATH)
    assert [codec.decode(b) for b in want] == [t.decode(np.frombuffer(b, "<u4").tolist(), skip_special_tokens=False) for b in want]


def test_token_file_rows_are_views(spark):
    df = spark.createDataFrame([(i, "word " * (i * 40)) for i in range(30)], "doc_id long, text string")
    folder, files = token_files.write_token_files(df.coalesce(1), row=64, file_tokens=5000)
    names = [r.file for r in files.orderBy("file").collect()]
    assert len(names) > 1
    total = 0
    for name in names:
        reader = token_files.SequenceReader(folder, name)
        flat = np.concatenate([reader.sequence(i) for i in range(len(reader))])
        on = np.unpackbits(np.concatenate([reader.mask(i) for i in range(len(reader))]), bitorder="little")
        assert not reader.sequence(0).flags.owndata
        assert on.sum() == sum(n for n in reader.index.column("n_tokens").to_pylist())
        for _, s, x in reader.documents():
            assert (flat[s : s + len(x)] == x).all()
        total += on.sum()
    assert total == sum(r.n_tokens for r in token_files.read_documents(folder, files).collect())


def test_repeat_words_by_brute_force(spark):
    random.seed(5)
    texts = [" ".join(random.choice("abc") for _ in range(random.randint(0, 60))) for _ in range(60)] + [" ".join(map(str, range(40))) + "\n" + " ".join(map(str, range(20)))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("source", F.lit("s"))
    for r in line_quality.line_frequency_rules(df).collect():
        w = texts[r.doc_id].split()
        grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        hit = {k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(i, i + 8)}
        assert (r.n_words, r.n_repeat_words) == (len(w), len(hit))


def test_common_lines_deplete(spark):
    line = "all rights reserved by the owner of this site and whoever else may own it now"
    rows = [(i, f"{line.upper() if i % 3 else line + '  '}\n" + " ".join(f"{chr(97 + i // 10)}{chr(97 + i % 10)}x{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(60 if i % 2 else 5)), "h") for i in range(60)]
    got = {r.doc_id: r for r in line_quality.line_frequency_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[i].kept == bool(i % 2) and not got[i].base_failed and got[i].n_removed_words == 16 for i in range(60))


def test_url_aliases(spark):
    c = '<link href="{}" rel="canonical">'
    rows = [
        (1, "http://a.org/x", c.format("https://b.net/fr/1")), (2, "http://a.org/y#z", c.format("/x")), (3, "http://c.org/", c.format("http://d.net/es/2")), (4, "http://e.com/q", c.format("http://d.net/es/2")),
        (5, "https://b.net/fr/1", ""), (6, None, None), (7, "nonsense", c.format("x")), (8, "http://www.example.com/en/1", ""), (9, "http://m.example.com/en/1?p", ""), (10, "http://f.org/", '<meta http-equiv="refresh" content="0; url=http://a.org/x">'),
    ]
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert got == {1: (None, "block"), 2: (None, "block"), 3: (None, "allow"), 4: ("com/", "allow"), 5: ("net/fr/", "block"), 6: (None, "allow"), 7: (None, "allow"), 8: ("www.example.com/en/", "allow"), 9: ("example.com/en/", "block"), 10: (None, "block")}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100)] + [(500, k) for k in range(501, 700)] + [(9, 9), (None, 4)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(101)}, **{i: 500 for i in range(500, 700)}}


def test_join_with_large_families_equals_brute_force(spark, monkeypatch):
    random.seed(2)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for family in range(6):
        base = [random.choice(words) for _ in range(70)]
        for _ in range(40 if family < 3 else 3):
            w = list(base)
            for _ in range(random.randint(0, 4)):
                w[random.randrange(len(w))] = random.choice(words)
            texts.append(" ".join(w))
    shared = " ".join(random.choice(words) for _ in range(25))
    texts += [shared + " " + " ".join(random.choice(words) for _ in range(60)) for _ in range(40)] + ["only two", "only two", "", texts[0]]

    def grams(t, k):
        w = t.split()
        return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for width, percent, block in ((3, 90, 1_000_000), (5, 80, 1_000_000), (3, 80, 900)):
        monkeypatch.setattr(ngram_join, "BLOCK_TOKENS", block)
        sets = [grams(t, width) for t in texts]
        root = list(range(len(texts)))

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for i in range(len(texts)):
            for j in range(i):
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                    a, b = sorted((find(i), find(j)))
                    root[b] = a
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(df, width, percent).collect()}
        assert got == {i: (len(s), find(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize("smalls", [(1 / 8,), (1 / 4,), (1 / 3,), (1 / 2,)])
def test_packing_plan_places_each_piece_once(smalls):
    rng = np.random.default_rng(1)
    for sizes in (rng.integers(1, 65, 500), rng.integers(20, 30, 300), np.array([64, 64, 33, 31, 1])):
        counts = {int(k): int(v) for k, v in zip(*np.unique(sizes, return_counts=True))}
        where, seen = {}, {}
        for length, rank, n, first, per, offset in packing.plan(counts, 64, 8, smalls):
            assert rank == seen.get(length, 0)
            seen[length] = rank + n
            for k in range(n):
                where.setdefault(first + k // per, []).append((offset + k % per * length, length))
        assert seen == counts
        for spots in where.values():
            spots.sort()
            assert [o for o, _ in spots] == [0, *np.cumsum([n for _, n in spots])[:-1]]
            assert sum(n for _, n in spots) <= 64


def test_top_k_ties_nulls_and_blocks(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 6) / 64]) for i in range(200)]
    more = [(903, []), (3, rows[3][1]), (20, rows[1][1]), (199, [1.0] * 6), (199, [0.5] * 6)]
    bad = [(900, None), (901, [None, 1.0]), (902, [float("nan")] * 6), (None, [1.0] * 6)]
    df = spark.createDataFrame(rows + more + bad, "vec_id long, embedding array<double>")
    m = [(i, np.array([int(np.floor(64 * x)) for x in v] or [0] * 6)) for i, v in rows + more]
    want = []
    for q, (i, v) in enumerate(m):
        if i % 20 == 0:
            best = sorted((-int(v @ w), j) for k, (j, w) in enumerate(m) if k != q)[:7]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    got = bitslice.top_k(df, F.col("vec_id") % 20 == 0, 7, block_rows=60, chunk_queries=4)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    clashing = df.withColumns({"row": F.lit(1), "q": F.lit("x"), "block": F.lit(2), "score": F.lit(3)})
    assert bitslice.top_k(clashing, F.col("vec_id") % 20 == 0, 7).count() == len(want)
    assert bitslice.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    with pytest.raises(ValueError):
        bitslice.top_k(spark.createDataFrame([(1, [1e12, 1.0])], "vec_id long, embedding array<double>"), F.lit(True))


def test_sharding_of_a_hot_text(spark):
    rows = [(i, "same text " * 30 if i % 3 else f"text {i} " * (i % 40 + 1), "en", f"s{i % 4}") for i in range(1500)]
    got = sharding.kd_shards(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), 8).toPandas()
    sums = got.groupby("shard")["size"].sum()
    assert len(sums) == 8 and sums.max() < 1.25 * sums.mean()
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    # one text is heavier than a shard and spread; every other text is whole
    assert got[got["size"] != len("same text " * 30) + 1].groupby("text_crc32").shard.nunique().max() == 1


def test_sharding_without_labels_and_with_ties(spark, tmp_path):
    rows = [(i % 50, f"t{i % 100}", "x", 7) for i in range(400)] + [(None, None, "x", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string, slot int")
    got = sharding.kd_shards(docs, 4).toPandas()
    assert len(got) == len(rows)
    assert got.groupby("text_crc32").shard.nunique().max() == 1
    assert got.groupby("shard")["size"].sum().max() < 1.1 * got["size"].sum() / 4
    sharding.write_shards(docs, f"file://{tmp_path}/out", 4)
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert back.count() == len(rows) and back.filter("doc_id is null").count() == 1


def test_label_model_finds_labels_and_accuracies_from_votes_alone():
    rng = np.random.default_rng(0)
    truth = rng.random(3000) < 0.3
    votes = np.zeros((3000, 8), np.int8)
    for j in range(5):
        votes[truth & (rng.random(3000) < 0.8), j] = 1
    votes[:, 5] = votes[:, 4]  # a voter that only repeats another
    votes[rng.random(3000) < 0.2, 6] = 1  # one that knows nothing
    votes[:, 7] = np.where(votes[:, :6].any(axis=1), 0, -1)
    model = toxicity.fit_label_model(votes, 0.3)
    assert ((model.final > 0.5) == truth).mean() > 0.97
    right = toxicity.accuracies(votes, model.final)
    assert (right[:6] > 0.95).all() and right[7] > 0.95 and abs(right[6] - 0.3) < 0.06
    assert model.parent[5] == 4 or model.parent[4] == 5


def test_texts_of_megabytes(spark):
    words = " ".join(f"word{i % 5000}" for i in range(200_000))
    rows = [(1, words, "en", "s"), (2, "x" * 3_000_000, "de", "s"), (3, words + " end", "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    net = language_id.fit(["the cat and dog " * 9, "der und die das " * 9], ["en", "de"], epochs=1)
    assert {r.doc_id: r.component_id for r in ngram_join.ngram_components(docs).collect()} == {1: 1, 2: 2, 3: 1}
    assert {r.doc_id: r.n_words for r in line_quality.line_frequency_rules(docs).collect()} == {1: 200_000, 2: 1, 3: 200_001}
    assert language_id.identify(docs, net).filter("lang_pred <> 'und'").count() == 3
    assert toxicity.score_toxicity(docs, toxicity.Scored({"word": 2.0, "word+": 5.0}, frozenset(), -1.0)).filter("predicted = 1").count() == 2
    assert {r.doc_id: r["size"] for r in sharding.kd_shards(docs, 2).collect()} == {i: len(t) + 1 for i, t, _, _ in rows}
    t = Tokenizer.from_file(PATH)
    n = {i: len(t.encode(x, add_special_tokens=False).ids) for i, x, _, _ in rows}
    assert {r.doc_id: r.n_tokens for r in pair_bpe.encode_decode(docs, digests=True).collect()} == n
    assert {r.doc_id: r.n_tokens - 1 for r in token_files.token_documents(docs, digests=True).collect()} == n
    assert {r.doc_id: r.n - 1 for r in packing.pack_documents(docs).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == n
    page = spark.createDataFrame([(1, "http://a.org/", "<p>" * 1_000_000 + '<link rel="canonical" href="http://b.net/fr/">')], "page_id long, url string, html string")
    assert url_filter.judge_urls(page).first().verdict == "block"


def test_tables_of_chunks_are_bounded_in_bytes():
    e = encoding.ChunkEncoder(PATH)
    e.encode_many(["a" * 100_000, "b" * 90 + ".", "short words", "名" * 5000])
    assert all(len(k) <= encoding.KEPT_CHARS for k in [*e.chunks, *e.pieces])


def test_the_session_is_left_alone(spark, odd):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    ngram_join.ngram_components(odd).count()
    pair_bpe.encode_decode(odd).count()
    assert spark.conf.get(name) == before


def test_more_than_64_languages_are_learned(spark):
    rows = [(i, f"text of {chr(97 + i % 26)}{chr(97 + i // 26 % 26)} " * 3, f"l{i % 80}") for i in range(800)] + [(None, "no id", "l0")]
    texts, langs = language_id.training_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(set(langs)) == 80 and len(texts) == len(langs)


def test_cleaned_texts_and_sequences(spark):
    line = "all rights reserved by the owner of this site"
    docs = spark.createDataFrame([(1, f"own\n{line}\nmore", "s")], "doc_id long, text string, source string")
    common = docs.select(F.lit("s").alias("host"), F.xxhash64(line_quality._normal(F.lit(line))).alias("h"))
    assert line_quality.cleaned_texts(docs, common).first().text == "own\nmore"
    many = spark.createDataFrame([(i, "word " * i) for i in range(40)], "doc_id long, text string")
    packed = packing.pack_documents(many, capacity=64)
    whole = {r.sequence_id: len(r.ids) // 4 for r in packing.sequences(packed).collect()}
    assert whole == {r.sequence_id: r.n for r in packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()}
