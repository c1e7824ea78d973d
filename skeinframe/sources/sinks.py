"""Sinks (survey K-01 to K-10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compact_json(df: DataFrame, path: str, names: dict[str, str]) -> None:
    """JSON lines under short keys; null fields are left out. names: long -> short."""
    df.select(*(F.col(a).alias(b) for a, b in names.items())).write.option("ignoreNullFields", "true").json(path)


def shards(df: DataFrame, path: str, by: str) -> DataFrame:
    """Write a folder a key, rows of a key together; returns the manifest (key, rows)."""
    df.repartition(by).write.partitionBy(by).parquet(path)
    return df.groupBy(by).agg(F.count("*").alias("rows")).orderBy(by)


def append_history(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def archive(df: DataFrame, path: str) -> None:
    """Never over what is there."""
    df.write.mode("errorifexists").parquet(path)


def sql_inserts(df: DataFrame, table: str, key: list[str]) -> DataFrame:
    """One upsert statement a row."""
    quoted = [F.when(F.col(c).isNull(), "null").otherwise(F.concat(F.lit("'"), F.replace(F.col(c).cast("string"), F.lit("'"), F.lit("''")), F.lit("'"))) for c in df.columns]
    names, rest = ", ".join(df.columns), ", ".join(f"{c} = excluded.{c}" for c in df.columns if c not in key)
    tail = f" on conflict ({', '.join(key)}) do " + (f"update set {rest};" if rest else "nothing;")
    return df.select(F.concat(F.lit(f"insert into {table} ({names}) values ("), F.concat_ws(", ", *quoted), F.lit(")" + tail)).alias("statement"))


def redirects(df: DataFrame, path: str, old: Column, new: Column) -> None:
    df.select(old.alias("from"), new.alias("to"), F.lit(301).alias("status")).filter(F.col("from") != F.col("to")).write.csv(path, header=True)
