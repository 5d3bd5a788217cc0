"""Connected components of a link table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed


def _step(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: every node tells its larger (or smaller) neighbours about the smallest node it sees.

    The minimum per node is combined before its shuffle and checkpointed; the join then reads two plain shuffles, so
    that adaptive execution can split a node with very many links.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    least = checkpointed(least)
    if large:
        told = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        told = both.where("v < u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        told = told.union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return checkpointed(told.where("a <> b").distinct())


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in ``links`` (a, b): root is the smallest node reachable.

    Rounds of a large and a small star run until the edges stop changing, a number of rounds that grows with the
    logarithm of the component sizes. Only a count and a checksum reach the driver. An empty table gives no rows.
    """
    edges = checkpointed(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    before = _mark(edges)
    while before[0]:
        edges = _step(_step(edges, True), False)
        after = _mark(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
