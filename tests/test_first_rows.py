"""The first match by tiers and pairs of equal values: right whatever the numbers, and without meeting all rows of a key."""

import random

from pyspark.sql import functions as F

from skeinframe.operators import joins


def test_first_within_of_any_numbers(spark):
    rnd = random.Random(7)
    number = lambda: rnd.choice([None, float("nan"), float("inf"), -0.0, 500.0, rnd.uniform(-3000, 3000), round(rnd.uniform(-3000, 3000), 2)])
    left = [(i, rnd.randint(0, 2) or None, number()) for i in range(200)]
    right = [(i, rnd.randint(0, 2) or None, number()) for i in range(300)]
    l, r = spark.createDataFrame(left, "a int, k int, x double"), spark.createDataFrame(right, "b int, j int, y double")  # noqa: E741
    for most in (0.0, 0.01, 500.0):
        found = joins.tiered_match(l, r, "a", "b", [("near", F.col("k"), F.col("j"), joins.Within(F.col("x"), F.col("y"), most))])
        want = {}
        for a, k, x in left:
            hits = [b for b, j, y in right if k is not None and k == j and x is not None and y is not None and abs(x - y) <= most]
            if hits:
                want[a] = min(hits)
        assert {r.a: r.b for r in found.collect()} == want and len(want) > 5


def test_tiers_meet_the_first_row_of_a_key(spark):
    left, right = spark.range(2000).select(F.col("id").alias("a"), (F.col("id") % 2).alias("k")), spark.range(2000).select(F.col("id").alias("b"), (F.col("id") % 2).alias("j"))
    tiers = [("same", F.col("k"), F.col("j"), None)]
    found = joins.tiered_match(left, right, "a", "b", tiers)
    assert {(r.a, r.b) for r in found.collect()} == {(i, i % 2) for i in range(2000)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 2


def test_pairs_of_equal_values(spark):
    names = ["red ring", "red rings", "ring red", "blue bolt", "", None, "red ring"]
    rows = [(i, i % 2, names[i % len(names)]) for i in range(56)]
    df = spark.createDataFrame(rows, "id int, k int, name string").withColumn("tk", F.filter(F.split(F.coalesce("name", F.lit("")), " "), lambda x: x != ""))

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [i] + [0] * len(b) if not (old := row) else [i] + [0] * len(b)
            for j, y in enumerate(b, 1):
                row[j] = min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y))
        return row[-1]

    both = [(x, y) for x in rows for y in rows if x[0] < y[0] and x[1] == y[1] and None not in (x[2], y[2])]
    near = joins.near_spellings(df, ["k"], "id", "name", 2).collect()
    assert sorted((r.a, r.b, r.distance) for r in near) == sorted((x[0], y[0], edits(x[2], y[2])) for x, y in both if edits(x[2], y[2]) <= 2)
    shared = joins.token_pairs(df, ["k"], "id", "tk").collect()
    sets = lambda r: set(r[2].split())
    assert sorted((r.a, r.b, round(r.score, 9)) for r in shared) == sorted((x[0], y[0], round(len(sets(x) & sets(y)) / len(sets(x) | sets(y)), 9)) for x, y in both if sets(x) & sets(y))
