"""Readers: parquet tables, text corpora, JSON records and nested documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt evenly to as many tasks as the input has splits, one per core at least.

    A row group is read by one task, and a file of many splits may hold few of them: the other splits are empty.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, df.rdd.getNumPartitions()), *keys)


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """One row per text file: (doc_id, text); the id is the file's path."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))


def json_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON Lines with a declared schema; a malformed line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_documents(spark: SparkSession, path: str, schema: str | T.StructType, pattern: str = "*.json") -> DataFrame:
    """One nested document per file."""
    reader = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST")
    return reader.option("pathGlobFilter", pattern).json(path)


def text_map(c: Column) -> Column:
    """A JSON object of key to text as a map."""
    return F.from_json(c, T.MapType(T.StringType(), T.StringType()))


def page_subset(df: DataFrame, page: str, first: int, last: int, odd_only: bool = True) -> DataFrame:
    """Pages of a range, optionally odd ones only; the range reaches the scan."""
    kept = df.filter(F.col(page).between(first, last))
    return kept.filter(F.pmod(F.col(page), F.lit(2)) == 1) if odd_only else kept
