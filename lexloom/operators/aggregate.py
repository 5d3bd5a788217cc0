"""Grouped picks written so that the map side does the work before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key in an order. Every task keeps one row per key before the shuffle, however many a key has."""
    ranked = df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_rank = 1").drop("_rank")


def most_frequent(df: DataFrame, keys: Sequence[str], value: str, position: str) -> DataFrame:
    """The commonest value per key; of equally common ones the first seen."""
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), F.min(position).alias("_first"))
    return first_per_key(counted, keys, [F.desc("n"), F.col("_first")]).drop("_first")


def longest_per_key(df: DataFrame, keys: Sequence[str], text: str, position: str) -> DataFrame:
    """The row with the longest text per key, the earliest of equals; a null text is shorter than any."""
    return first_per_key(df, keys, [F.desc_nulls_last(F.length(text)), F.col(position)])


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def group_counts(parents: DataFrame, key: str, items: DataFrame, item_key: str) -> DataFrame:
    """Items per parent, zero for parents without any; items are counted before the join."""
    counted = items.groupBy(F.col(item_key).alias(key)).agg(F.count(F.lit(1)).alias("n_items"))
    return parents.join(counted, key, "left").withColumn("n_items", F.coalesce("n_items", F.lit(0)))
