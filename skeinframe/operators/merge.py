"""Merging records, guarded updates and promotion (survey M-01 to M-22 without M-06, M-07, M-12 and M-22; U-01 to U-06)."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .filters import first_reason
from .joins import first_of


def blank(c: Column, kind: str) -> Column:
    """Null, empty text, empty array or empty map."""
    if kind.startswith(("array", "map")):
        return c.isNull() | (F.size(c) == 0)
    return c.isNull() | (c == "") if kind == "string" else c.isNull()


def fill_blanks(keep: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """``keep`` with its blank fields filled from ``other``'s row of the key; fields that only one has stay."""
    kinds = dict(keep.dtypes) | {k: v for k, v in other.dtypes if k not in keep.columns}
    j = keep.alias("k").join(other.alias("o"), key, "left")
    out = [F.col(key)]
    for c in [c for c in kinds if c != key]:
        if c not in other.columns:
            out.append(F.col(f"k.{c}"))
        elif c not in keep.columns:
            out.append(F.col(f"o.{c}"))
        else:
            out.append(F.when(blank(F.col(f"k.{c}"), kinds[c]), F.col(f"o.{c}")).otherwise(F.col(f"k.{c}")).alias(c))
    return j.select(*out)


def later_wins(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of both by key; where both have one, each field that ``new`` fills replaces the old."""
    j = old.alias("o").join(new.alias("n"), key, "full_outer")
    names = [*old.columns, *(c for c in new.columns if c not in old.columns)]
    pick = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) if c in new.columns and c in old.columns else F.col(f"n.{c}" if c in new.columns else f"o.{c}")
    return j.select(F.col(key), *(pick(c) for c in names if c != key))


def newer_guard(current: DataFrame, staged: DataFrame, key: str, fields: Sequence[str], year: str) -> DataFrame:
    """Staged field groups replace current ones, unless those are of a newer year."""
    j = current.alias("c").join(staged.select(key, year, *fields).alias("s"), key, "left")
    keep = F.col(f"s.{year}").isNull() | F.coalesce(F.col(f"c.{year}") > F.col(f"s.{year}"), F.lit(False))
    own = {*fields, year}
    return j.select(key, *(F.when(keep, F.col(f"c.{c}")).otherwise(F.col(f"s.{c}")).alias(c) if c in own else F.col(f"c.{c}") for c in current.columns if c != key))


def provenance_union(a: Column, b: Column) -> Column:
    """Sources of both by (name, ref), the first of equals."""
    key = lambda s: F.concat_ws("\x1f", s["name"], s["ref"])
    have = F.transform(F.coalesce(a, F.array()), key)
    return F.concat(F.coalesce(a, F.array()), F.filter(F.coalesce(b, F.array()), lambda s: ~F.array_contains(have, key(s))))


def names_union(a: Column, b: Column) -> Column:
    """A map of names in which ``a`` wins; duplicates never reach map_concat."""
    return F.map_concat(a, F.map_filter(b, lambda k, v: ~F.map_contains_key(a, k)))


def overrides(df: DataFrame, manual: DataFrame, key: str, types: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(df with accepted overrides, (key, reason) of the others). manual: key, type, source, confidence."""
    joined = manual.join(df.select(F.col(key), F.lit(True).alias("_known")), key, "left")
    judged = joined.withColumn("reason", first_reason([("unknown id", F.col("_known").isNull()), ("invalid type", ~F.col("type").isin(*types)), ("no source", F.col("source").isNull() | F.col("confidence").isNull())])).drop("_known")
    good = judged.filter("reason is null").select(key, F.col("type").alias("_type"))
    return df.join(good, key, "left").withColumn("type", F.coalesce("_type", "type")).drop("_type"), judged.filter("reason is not null").select(key, "reason")


def best_staged(staged: DataFrame, key: str, score: str, order: Sequence[str]) -> DataFrame:
    """The best staged row a key; of equals the first in file order."""
    return first_of(staged, [key], [F.col(score).desc(), *map(F.col, order)])


def rekey_duplicates(df: DataFrame, key: str, better: Column) -> DataFrame:
    """Rows that share a key take ``better`` as theirs, where it is one; a clash with another row's key raises."""
    from pyspark.sql import Window

    marked = df.withColumn("_shared", F.count("*").over(Window.partitionBy(key)) > 1).withColumn("_new", F.when(F.col("_shared") & better.isNotNull(), better).otherwise(F.col(key)))
    clash = marked.filter(F.col("_new") != F.col(key)).select(F.col("_new").alias(key)).join(df.select(key), key, "left_semi")
    if clash.limit(1).count():
        raise ValueError("a new key is in use")
    return marked.withColumn(key, F.col("_new")).drop("_shared", "_new")


POINTER = "_current"


def _hadoop(spark: SparkSession, path: str):
    """(file system, file context, path maker) for a table's folder."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    uri = at(path).getFileSystem(conf).getUri()
    return at(path).getFileSystem(conf), jvm.org.apache.hadoop.fs.FileContext.getFileContext(uri, conf), at


def _point(spark: SparkSession, path: str, version: str) -> None:
    """Swap the pointer in one rename over the old one: a reader sees either version, never none."""
    fs, context, at = _hadoop(spark, path)
    fresh = at(f"{path}/{POINTER}-{uuid.uuid4().hex}")
    out = fs.create(fresh, True)
    out.write(bytearray(version.encode()))
    out.close()
    rename = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context.rename(fresh, at(f"{path}/{POINTER}"), options)


def current_version(spark: SparkSession, path: str) -> str | None:
    """The version that the pointer names; None for a table that was never promoted."""
    path = path.rstrip("/")
    fs, _, at = _hadoop(spark, path)
    if not fs.exists(at(f"{path}/{POINTER}")):
        return None
    stream = fs.open(at(f"{path}/{POINTER}"))
    try:
        return bytes(b & 0xFF for b in stream.readAllBytes()).decode()
    finally:
        stream.close()


def promoted(spark: SparkSession, path: str) -> DataFrame:
    """The current version of a promoted table."""
    version = current_version(spark, path)
    if version is None:
        raise FileNotFoundError(f"nothing was promoted at {path}")
    return spark.read.parquet(f"{path.rstrip('/')}/{version}")


def promote(df: DataFrame, path: str, tests: Sequence[tuple[str, Column]], keep: int = 2) -> str:
    """Write ``df`` as a new version in ``path``, check the written rows, and only then let the pointer name it; its name.

    A broken test raises, and removes the new version. Whatever ends between two
    steps, the pointer names a whole table: versions are written before it, in
    folders of their own, and old ones are removed after it. ``keep`` versions before
    the current one stay for ``roll_back``; what was left unfinished goes with the
    next promotion.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    fs, _, at = _hadoop(spark, path)
    before = current_version(spark, path)
    number = 1 + max((int(v.split("-")[1]) for v in versions(spark, path)), default=0)
    version = f"version-{number:08d}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(f"{path}/{version}")
    back = spark.read.parquet(f"{path}/{version}")
    bad = [n for n, t in tests if back.filter(~F.coalesce(t, F.lit(False))).limit(1).count()]
    if bad:
        fs.delete(at(f"{path}/{version}"), True)
        raise ValueError(f"not promoted: {', '.join(bad)}")
    _point(spark, path, version)
    older = [v for v in versions(spark, path) if v < version and v != before]
    for v in older[: max(0, len(older) - (keep - (before is not None)))]:
        fs.delete(at(f"{path}/{v}"), True)
    return version


def versions(spark: SparkSession, path: str) -> list[str]:
    """The versions in a table's folder, oldest first."""
    path = path.rstrip("/")
    fs, _, at = _hadoop(spark, path)
    if not fs.exists(at(path)):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(at(path)) if s.isDirectory() and s.getPath().getName().startswith("version-"))


def roll_back(spark: SparkSession, path: str) -> str:
    """Let the pointer name the version before the current one; its name."""
    path, now = path.rstrip("/"), current_version(spark, path)
    before = [v for v in versions(spark, path) if now is not None and v < now]
    if not before:
        raise ValueError("no version to go back to")
    _point(spark, path, before[-1])
    return before[-1]
