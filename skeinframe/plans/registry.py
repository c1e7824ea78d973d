"""The registry of queries: a callable and its SQL under one name."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """``t("orders")`` reads a table; ``t.sql("... {orders} ...")`` runs SQL over tables named in braces."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text, **{n: self(n) for n in set(re.findall(r"\{(\w+)\}", text))})


def plain(text: str) -> str:
    """SQL for ``Tables.sql`` as SQL over views of the tables' names."""
    return re.sub(r"\{(\w+)\}", r"\1", text)


def query(sql: str | None = None):
    """Register a function of the tables as a query."""

    def put(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(spark, sf_dir))

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return put
