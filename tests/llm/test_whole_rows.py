"""Operators that hand on rows hand on all of them, whatever their columns are called."""

from collections import Counter

from pyspark.sql import functions as F

from skeinframe.llm import line_quality, sharding


def test_cleaned_texts_keep_every_row(spark):
    rows = [(1, "x", "h"), (2, "x\nx", "h"), (3, "a", "h"), (3, "a", "h"), (3, "b\nx\nc\n", "h"), (None, "x\nd", "h"), (5, None, "h"), (6, "", None), (7, "x", None), (8, "X \n y", "h")]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, source string, h int, row string")
    common = df.filter("doc_id = 1").select(F.col("source").alias("host"), F.xxhash64(line_quality._normal(F.col("text"))).alias("h"))
    got = Counter((r.doc_id, r.text) for r in line_quality.cleaned_texts(df, common).collect())
    assert got == Counter([(1, ""), (2, ""), (3, "a"), (3, "a"), (3, "b\nc\n"), (None, "d"), (5, ""), (6, ""), (7, "x"), (8, " y")])
    assert line_quality.cleaned_texts(df.limit(0), common).count() == 0
    assert Counter((r.doc_id, r.text) for r in line_quality.cleaned_texts(df, common.limit(0)).collect()) == Counter((i, t or "") for i, t, _ in rows)


def test_shards_keep_clashing_columns(spark, tmp_path):
    rows = [(i % 9 or None, f"text {i % 20}" if i % 7 else None, i, "c", "i", 3, "w") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, size int, text_crc32 string, _id string, shard int, w string")
    out = f"file://{tmp_path}/shards"
    sharding.write_shards(docs, out, 4)
    back = spark.read.parquet(out)
    assert set(back.columns) == set(docs.columns)
    assert Counter((r.doc_id, r.text, r.size, r.text_crc32, r._id) for r in back.collect()) == Counter(r[:5] for r in rows)
    assert set(back.select("shard").distinct().toPandas().shard) <= set(range(4))
