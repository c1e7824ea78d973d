"""Sources with explicit schemas (survey S-01 to S-18)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SOURCE = T.StructType([T.StructField(n, T.StringType()) for n in ("name", "ref", "url", "licence", "retrieved", "attribution")])
IMAGE = T.StructType([T.StructField("url", T.StringType()), T.StructField("source", T.StringType()), T.StructField("license", T.StringType()), T.StructField("contextOnly", T.BooleanType())])
PLACE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "name", "nation", "type", "subtype", "archipelago", "description", "osmType", "wikidata", "source", "confidence")]
    + [T.StructField(n, T.DoubleType()) for n in ("lat", "lng", "areaKm2", "highestPointM")]
    + [T.StructField("population", T.LongType()), T.StructField("osmId", T.LongType()), T.StructField("names", T.MapType(T.StringType(), T.StringType())), T.StructField("images", T.ArrayType(IMAGE)), T.StructField("sources", T.ArrayType(SOURCE))]
)


def json_array(spark: SparkSession, path: str, schema: T.StructType = PLACE) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def compact_index(spark: SparkSession, path: str, names: dict[str, str], schema: T.StructType) -> DataFrame:
    """Rows of an index with short keys under their long names. names: short -> long."""
    rows = spark.read.schema(T.StructType([T.StructField("version", T.IntegerType()), T.StructField("rows", T.ArrayType(schema))])).json(path, multiLine=True)
    return rows.select(F.explode("rows").alias("r")).select(*(F.col(f"r.{a}").alias(b) for a, b in names.items()))


def with_overlay(named: DataFrame, unnamed: DataFrame, key: str = "id") -> DataFrame:
    """Both parts; an id that both have is the first's."""
    return named.unionByName(unnamed.join(named.select(key), key, "left_anti"), allowMissingColumns=True)


def shard(spark: SparkSession, path: str, **partition) -> DataFrame:
    """One partition of a partitioned table: the filter prunes folders."""
    df = spark.read.parquet(path)
    for name, value in partition.items():
        df = df.filter(F.col(name) == value)
    return df


def lenient_csv(spark: SparkSession, path: str, name: str, separator: str = ",") -> DataFrame:
    """Header in lower case, byte-order mark dropped, rows without a name left out; all text."""
    df = spark.read.csv(path, header=True, sep=separator)
    df = df.toDF(*(c.lstrip("﻿").strip().lower() for c in df.columns))
    return df.filter(F.trim(F.coalesce(F.col(name), F.lit(""))) != "")


def one_hot(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """An array of the columns that are 1, in the order given; rows without any are left out."""
    classes = F.array_compact(F.array(*(F.when(F.trim(F.col(c).cast("string")) == "1", F.lit(c)) for c in columns)))
    return df.withColumn(name, classes).filter(F.size(name) > 0)


def map_elements(df: DataFrame) -> DataFrame:
    """Map elements (type, id, lat, lon, center, tags) as places; those without a name or a point are left out."""
    from ..functions.text import first_filled

    tag = lambda k: F.col("tags").getItem(k)
    lat, lng = F.coalesce("lat", "center.lat"), F.coalesce("lon", "center.lon")
    out = df.select(F.concat_ws("-", F.lit("osm"), "type", F.col("id").cast("string")).alias("id"), first_filled(tag("name:en"), tag("name"), tag("official_name"), tag("alt_name"), tag("loc_name")).alias("name"), F.round(lat, 5).alias("lat"), F.round(lng, 5).alias("lng"), tag("wikidata").alias("wikidata"))
    return out.filter("name <> '' and lat is not null and lng is not null")


def wkt_point(c: Column) -> Column:
    """(lat, lng) of Point(lng lat); null for anything else."""
    pattern = r"(?i)^\s*point\s*\(\s*(-?[\d.]+)\s+(-?[\d.]+)\s*\)\s*$"
    part = lambda k: F.regexp_extract(F.coalesce(c, F.lit("")), pattern, k).try_cast("double")
    return F.when(part(1).isNotNull() & part(2).isNotNull(), F.struct(part(2).alias("lat"), part(1).alias("lng")))


def wiki_files(c: Column) -> Column:
    """File names of [[File:...]] and [[Image:...]] links of a wiki text."""
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?i)\[\[\s*(?:file|image)\s*:\s*([^|\]]+)"), F.lit(1)), lambda x: F.replace(F.trim(x), F.lit(" "), F.lit("_")))


def html_links(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"""(?i)\bhref\s*=\s*["']([^"']+)["']"""), F.lit(1))


def percent(c: Column) -> Column:
    """'12.5%' as 12.5."""
    return F.regexp_replace(c, "%$", "").try_cast("double")


def salvaged_json(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(good rows, broken lines) of JSON lines."""
    wide = T.StructType([*schema.fields, T.StructField("_broken", T.StringType())])
    df = spark.read.schema(wide).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(path)
    return df.filter("_broken is null").drop("_broken"), df.filter("_broken is not null").select("_broken")
