"""Operators on small inline tables."""

import pytest
from pyspark.sql import functions as F

from skeinframe.operators import agg, filters, graph, joins, merge, scores, topk
from skeinframe.sources import readers, sinks
from skeinframe.streaming import state


def test_within_km_equals_brute_force(spark):
    import math
    import random

    random.seed(3)
    pts = [(i, random.uniform(49, 61), random.uniform(-8, 2)) for i in range(300)] + [(1000 + i, 55.0, -4.0 + i / 500) for i in range(40)]

    def km(a, b):
        p, q = math.radians(a[1]), math.radians(b[1])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * 6371 * math.asin(math.sqrt(h))

    df = spark.createDataFrame(pts, "id int, lat double, lng double")
    got = {(r.a, r.b) for r in joins.proximity_pairs(df, "id", 20).collect()}
    assert got == {(a[0], b[0]) for a in pts for b in pts if a[0] < b[0] and km(a, b) <= 20}


def test_name_and_distance(spark):
    left = spark.createDataFrame([(1, "a", 55.0, -4.0), (2, "b", None, None), (3, "c", 55.0, -4.0)], "l int, k string, lat double, lng double")
    right = spark.createDataFrame([(10, "a", 55.0, -4.3), (11, "b", 50.0, 0.0), (12, "c", 55.0, -4.3), (13, "c", 55.0, -4.05)], "r int, k string, lat double, lng double")
    assert {(x.l, x.r) for x in joins.name_and_distance(left, right, "k", "l", "r").collect()} == {(1, 10), (2, 11), (3, 13)}


def test_facets_refuse_unknown_values():
    with pytest.raises(ValueError):
        filters.Facets(nation="Atlantis").check(["Wales"], ["sea"])
    with pytest.raises(ValueError):
        filters.Facets(near=(10.0, 0.0, 5)).check([], [])
    assert not filters.Facets().constrained()
    assert filters.Facets(inhabited=False).constrained()


def test_remote_as_coded_and_as_meant(spark):
    df = spark.createDataFrame([(1, 0, "lake", True), (2, None, "sea", False), (3, None, "sea", True), (4, 5, "sea", False)], "id int, population int, type string, ferry boolean")
    assert {r.id for r in filters.Facets(remote=True).apply(df).collect()} == {1, 2}
    assert {r.id for r in filters.Facets(remote=True, strict_remote=True).apply(df).collect()} == {2}


def test_kpi_nulls_for_nothing_scored(spark):
    df = spark.createDataFrame([("a", True, None, None), ("a", True, True, None), ("b", False, True, True)], "k string, done boolean, cited boolean, ok boolean")
    rows = {r.k: r for r in agg.kpi_rollup(df, ["k"], F.col("done"), F.col("cited"), F.col("ok"), F.lit(True)).collect()}
    assert (rows["a"].completed, rows["a"].citation_scored, rows["a"].citation_rate, rows["a"].accuracy_rate) == (2, 1, 1.0, None)
    assert (rows["b"].completed, rows["b"].cited) == (0, None)


def test_unique_slugs(spark):
    df = spark.createDataFrame([("w", "x", "p", "1"), ("w", "x", "p", "2"), ("w", "x", "p", "3"), ("e", "x", None, "4")], "place string, slug string, parent string, id string")
    assert {r.id: r.path for r in topk.unique_slugs(df, "place", "slug", ["parent"], "id").collect()} == {"1": "x", "2": "x-p", "3": "x-3", "4": "x"}


def test_graph(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 51), (51, 50), (60, 60)], "u long, v long")
    assert {r.node: r.component for r in graph.components(e).collect()} == {**{i: 0 for i in range(31)}, 50: 50, 51: 50}
    w = graph.undirected(spark.createDataFrame([("a", "b", 5.0), ("b", "c", 5.0), ("a", "c", 20.0), ("a", "a", 1.0), ("c", "d", None)], "src string, dst string, w double"))
    assert {r.node: (r.total, list(r.path)) for r in graph.shortest_paths(w, "a").collect()} == {"a": (0.0, ["a"]), "b": (5.0, ["a", "b"]), "c": (10.0, ["a", "b", "c"]), "d": (130.0, ["a", "b", "c", "d"])}


def test_merge(spark):
    a = spark.createDataFrame([(1, "", None), (2, "x", 5)], "id int, name string, pop int")
    b = spark.createDataFrame([(1, "n", 7), (2, "y", 9)], "id int, name string, pop int")
    assert {tuple(r) for r in merge.fill_blanks(a, b, "id").collect()} == {(1, "n", 7), (2, "x", 5)}
    with pytest.raises(ValueError):
        merge.rekey_duplicates(spark.createDataFrame([("a", "b"), ("a", "b"), ("b", None)], "id string, new string"), "id", F.col("new"))


def test_promote_keeps_the_old_on_failure(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    with pytest.raises(FileNotFoundError):
        merge.promoted(spark, path)
    with pytest.raises(ValueError):
        merge.promote(spark.range(9), path, [("small", F.col("id") < 5)])
    assert merge.versions(spark, path) == [] and merge.current_version(spark, path) is None
    names = [merge.promote(spark.range(n), path, [("small", F.col("id") < 5)]) for n in (1, 2, 3, 4)]
    with pytest.raises(ValueError):
        merge.promote(spark.range(9), path, [("small", F.col("id") < 5)])
    assert merge.promoted(spark, path).count() == 4 and merge.versions(spark, path) == names[1:]
    # back step by step, and on again
    assert merge.roll_back(spark, path) == names[2] and merge.promoted(spark, path).count() == 3
    assert merge.roll_back(spark, path) == names[1]
    with pytest.raises(ValueError):
        merge.roll_back(spark, path)
    merge.promote(spark.range(5), path, [])
    assert merge.promoted(spark, path).count() == 5


def test_a_crash_between_any_two_steps_leaves_a_whole_table(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    merge.promote(spark.range(3), path, [])

    def crash(*_):
        raise RuntimeError("crash")

    # after the new version is written
    with monkeypatch.context() as m:
        m.setattr(merge, "_point", crash)
        with pytest.raises(RuntimeError):
            merge.promote(spark.range(4), path, [])
    assert merge.promoted(spark, path).count() == 3
    # after the pointer is swapped, while old versions are removed
    swap, seen = merge.versions, []

    def fail_later(*args):
        seen.append(1)
        return swap(*args) if len(seen) == 1 else crash()

    with monkeypatch.context() as m:
        m.setattr(merge, "versions", fail_later)
        with pytest.raises(RuntimeError):
            merge.promote(spark.range(5), path, [])
    assert merge.promoted(spark, path).count() == 5
    # a version that was cut off while it was written is never pointed to, and goes later
    (tmp_path / "t" / "version-00000009-torn").mkdir()
    for n in (6, 7, 8):
        merge.promote(spark.range(n), path, [])
        assert merge.promoted(spark, path).count() == n
    assert len(merge.versions(spark, path)) == 3 and "version-00000009-torn" not in merge.versions(spark, path)


def test_rows_by_position(spark):
    df = spark.createDataFrame([(i * 7 % 100, "x") for i in range(100)] + [(None, "y")], "id int, v string").repartition(7)
    order = [None, *range(100)]
    assert [topk.at_position(df, "id", lambda n, k=k: k).first().id for k in (0, 1, 50, 100, 999, -3)] == [order[0], order[1], order[50], order[100], order[100], order[0]]
    assert topk.at_position(df.limit(0), "id", lambda n: 0).count() == 0


def test_search_score(spark):
    df = spark.createDataFrame([("mull",), ("mull head",), ("holm mull",), ("xmullx",), ("m u l l",), ("iona",), ("",)], "n string")
    got = [r.s for r in df.select(scores.search_score(F.col("n"), F.lit("near mull"), "mull").alias("s")).collect()]
    assert got == [1000, 791, 591, 399, 194, 50, None]


def test_relevance_cutoff(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate((20, 18, 14, 12, 30))], "i int, s int")
    assert [r.i for r in topk.relevance_cutoff(df, "s", [F.col("i")], 5, 0.5, 7, 10).collect()] == [0, 1, 2]


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "n", None), ("b", "s", 2)], "id string, nation string, pop int")
    manifest = sinks.shards(df, f"file://{tmp_path}/s", "nation")
    assert {tuple(r) for r in manifest.collect()} == {("n", 1), ("s", 1)}
    assert readers.shard(spark, f"file://{tmp_path}/s", nation="n").count() == 1
    assert [r.statement for r in sinks.sql_inserts(df.filter("id = 'a'"), "t", ["id"]).collect()] == ["insert into t (id, nation, pop) values ('a', 'n', null) on conflict (id) do update set nation = excluded.nation, pop = excluded.pop;"]
    with pytest.raises(Exception):
        sinks.archive(df, f"file://{tmp_path}/s")
    p = spark.range(1).select(readers.wkt_point(F.lit("Point(-4.5 57)")).alias("p"), readers.wiki_files(F.lit("[[File:A b.jpg|x]] [[image:C.png]]")).alias("f"), readers.percent(F.lit("12.5%")).alias("c")).first()
    assert (tuple(p.p), list(p.f), p.c) == ((57.0, -4.5), ["A_b.jpg", "C.png"], 12.5)


def test_rate_limit_on_a_stream_equals_batch(spark, tmp_path):
    # two batches; the second has calls that are earlier than some of the first, and one call that only moves the watermark
    first = [("a", f"2024-01-01 00:00:{i:02d}", i) for i in (0, 2, 3, 9)] + [("b", "2024-01-01 00:00:01", 20), ("b", "2024-01-01 00:11:00", 21)]
    second = [("a", f"2024-01-01 00:00:{i:02d}", i) for i in (1, 5, 4)] + [("a", "2024-01-01 00:10:30", 31), ("b", "2024-01-01 00:10:59", 22)]
    frames = [spark.createDataFrame(r, "k string, s string, i int").select("k", F.to_timestamp("s").alias("at"), "i") for r in (first, second, [("z", "2024-01-02 00:00:00", 99)])]
    for n, df in enumerate(frames):
        df.coalesce(1).write.parquet(f"file://{tmp_path}/in/{n}")
    live = spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}/in")
    q = state.rate_limited_stream(live, "k", "at", 3, 600, "20 minutes").writeStream.format("memory").queryName("limits").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    got = sorted((r.k, str(r["at"]), r.allowed) for r in spark.table("limits").collect())
    want = sorted((r.k, str(r["at"]), r.allowed) for r in state.rate_limited(frames[0].unionByName(frames[1]), "k", "at", "i", 3, 600).collect())
    assert got == want and len({x[2] for x in got}) == 2
