"""Rows that say the same are judged once, and forms are made once."""

import __spark_entry__
from skeinframe.operators import categories, placing
from skeinframe.plans import sentences


def _log(spark, tmp_path):
    ids = [5832 * k + i for k in range(20) for i in (648, 649, 3300)]  # 5,832 orders on, a sentence comes again
    spark.createDataFrame([(i,) for i in ids], "o_orderkey long").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    return ids


def test_equal_sentences_are_read_once(spark, tmp_path, monkeypatch):
    ids, real, read = _log(spark, tmp_path), sentences.s.with_facets, []
    monkeypatch.setattr(sentences.s, "with_facets", lambda df, *a: read.append(df.count()) or real(df, *a))
    found = __spark_entry__.queries()["question_facets"](spark, str(tmp_path)).collect()
    assert sorted(r.id for r in found) == sorted(ids) and len({r[1:] for r in found}) == 3
    near = __spark_entry__.queries()["question_near"](spark, str(tmp_path)).collect()
    assert {(r.id % 5832, r.place) for r in near} == {(648, "Oban"), (649, "Oban")} and len(near) == 40
    assert read == [3, 3]


def test_equal_sentences_set_books_once(spark, monkeypatch):
    real, judged = placing.durable, {}

    def durable(df, label):
        out = real(df, label)
        judged[label] = out.count()
        return out

    monkeypatch.setattr(placing, "durable", durable)
    docs = spark.createDataFrame([(i, "It is set on Sark.", "sark2" if i % 9 == 0 else None if i % 2 else f"hint {i}") for i in range(90)], "doc int, body string, hint string")
    aliases = spark.createDataFrame([("Sark", "sark", None, None), ("Sark", "sark2", None, None)], "alias string, place string, is_group boolean, not_in string")
    places = spark.createDataFrame([("sark", 5.0, [], None, False), ("sark2", 0.2, [], None, False)], "place string, area double, context array<string>, entity string, curated boolean")
    got = {r.doc: (r.n, r.place) for r in placing.book_places(docs, aliases, places).collect()}
    assert got == {i: (0, "sark2" if i % 9 == 0 else "sark") for i in range(90)}
    assert judged["settings"] == 2


def test_forms_of_a_category_are_made_once(spark):
    cats = spark.createDataFrame([("Songs about Skye",)], "category string")
    places = spark.createDataFrame([("skye", "Isle of Skye", 1656.0, None)], "place string, name string, area double, only_with string")
    wider = spark.createDataFrame([("x", "town")], "name string, kind string")
    found = categories.judged_categories(cats, places, wider, ["Songs about", "Music of"])
    assert found._jdf.queryExecution().optimizedPlan().toString().count("(?i)^category:") == 1
    assert [tuple(r) for r in found.collect()] == [("Songs about Skye", "skye", "skye", None)]
