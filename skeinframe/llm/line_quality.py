"""Quality rules with cross-document line frequency, in DataFrame expressions only.

Lines are normalised and hashed; for each host, distinct documents that hold a
line are counted. Lines above the limit are removed, and documents that this
depletes are rejected, as are those that fail the base rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, text_or_empty

#: White space that separates words: blank and the five controls from tab to carriage return.
SPACE = r"[\x20\x09-\x0D]"
#: Symbols counted by the base rules.
SYMBOLS = "#*$%&|<>"


def _words(text: Column) -> Column:
    bare = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE + "+"))


def _normal(line: Column) -> Column:
    """A line for comparison: runs of white space as one blank, digits as 0, in lower case."""
    # a single blank is left as it is, so that most of a line costs no replacement
    one_blank = F.regexp_replace(line, r"(?:\x20(?=[\x20\x09-\x0D])|[\x09-\x0D])[\x20\x09-\x0D]*", " ")
    return F.lower(F.regexp_replace(F.trim(one_blank), "[0-9]", "0"))


def _joined(hashes: str, by: int) -> Column:
    """The hash of elements i and i + by, for each i that has both."""
    n = F.greatest(F.size(hashes) - by, F.lit(0))
    return F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(by + 1), n), lambda a, b: F.xxhash64(a, b))


def _covered(windows: Column, width: int) -> Column:
    """Words in windows that occur twice or more: each such window adds those that the one before it has not."""

    def places(s: Column) -> Column:
        n = F.size(s)
        twice = F.filter(s, lambda e, k: ((k > 0) & (F.get(s, k - 1)["h"] == e["h"])) | ((k < n - 1) & (F.get(s, k + 1)["h"] == e["h"])))
        return F.sort_array(F.transform(twice, lambda e: e["i"]))

    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    begin = F.struct(F.lit(-width).alias("last"), F.lit(0).alias("n"))
    step = lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(width), i - acc["last"])).alias("n"))
    return F.aggregate(F.transform(F.array(ordered), places)[0], begin, step)["n"]


def base_measures(docs: DataFrame, text: str = "text", width: int = 8) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and ``line_words``: an array of (h, w), the hash and words of each line that has a word.

    n_repeat_words: words in a window of ``width`` words (a power of two) that is
    found twice or more in the text. Each step is a column of its own, so that
    no array is made twice and only lambdas are interpreted.
    """
    whole = text_or_empty(text)
    step = docs.withColumn("_words", _words(whole)).withColumn("_lines", F.filter(F.split(whole, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    step = step.withColumn("_h", F.transform("_words", lambda w: F.xxhash64(w)))
    by = 1
    while by < width:
        step, by = step.withColumn("_h", _joined("_h", by)), by * 2
    return step.select(
        *docs.columns,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count(whole, F.lit("[" + SYMBOLS + "]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("_h")) < F.size("_h"), _covered(F.col("_h"), width)).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        F.transform("_lines", lambda x: F.struct(F.xxhash64(_normal(x)).alias("h"), F.size(_words(x)).alias("w"))).alias("line_words"),
    )


def line_frequency_rules(docs: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "source", most_docs: int = 20, least_words: int = 20, least_kept: float = 0.3) -> DataFrame:
    """One row for each row of ``docs``: its id, the five measures, n_removed_words, n_kept_words, base_failed and kept.

    A line is removed from a host's documents if more than ``most_docs`` of them
    have it, however many the host has; each row is a document, so exact copies
    of a text count one by one. A document is kept unless the base rules fail,
    or removal leaves under ``least_words`` words or under ``least_kept``
    of its words. Null text: no words, so it fails. Null host: a host of its
    own. Repeated rows and ids: each row gets its result. Empty tables: no rows.
    """
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"))
    base = base_measures(picked).withColumn("row", F.monotonically_increasing_id()).drop("text")
    base = durable(base, "line-base")
    seen = base.select("host", F.explode(F.array_distinct(F.transform("line_words", lambda x: x["h"]))).alias("h")).groupBy("host", "h").agg(F.count("*").alias("docs_with"))
    common = seen.filter(F.col("docs_with") > most_docs).select("host", "h")
    common = durable(common, "common-lines")
    lost = base.select("row", "host", F.explode("line_words").alias("x")).select("row", "host", "x.h", "x.w").join(common, ["host", "h"], "left_semi").groupBy("row").agg(F.sum("w").alias("n_removed_words"))
    judged = base.drop("line_words", "host").join(lost, "row", "left").withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0).cast("long")))
    n, left = F.col("n_words"), F.col("n_words") - F.col("n_removed_words")
    failed = (n < 20) | (100 * F.col("n_repeat_words") > 30 * n)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_words", left.alias("n_kept_words"), failed.alias("base_failed"), (~failed & ~((F.col("n_removed_words") > 0) & ((left < least_words) | (left < least_kept * n)))).alias("kept"))


def cleaned_texts(docs: DataFrame, common: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """doc_id and text without the lines whose (host, h) is in ``common``, for each row of ``docs``; for callers that want the cleaned text and not the verdict.

    A text of common lines only, an empty and a null text come back empty. Repeated
    ids and rows each get their own text, null ids stay null; a null host is a host
    of its own. Lines stay in order, lines that repeat are treated alike. Empty
    tables: no rows; other columns are not looked at. Very long texts are shuffled
    by line, and each is put together in one group.
    """
    named = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), text_or_empty(text).alias("text")).withColumn("row", F.monotonically_increasing_id())
    lines = named.select("row", "doc_id", "host", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    hashed = lines.withColumn("h", F.xxhash64(_normal(F.col("line")))).join(common.select("host", "h", F.lit(True).alias("gone")), ["host", "h"], "left")
    kept = F.filter(F.sort_array(F.collect_list(F.struct("at", "line", "gone"))), lambda x: x["gone"].isNull())
    return hashed.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.array_join(F.transform(kept, lambda x: x["line"]), "\n").alias("text")).drop("row")
