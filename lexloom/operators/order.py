"""Order-dependent filters on the lines of one document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import order_number
from ..functions.text import ascii_edges


def order_key(number: str | Column) -> Column:
    c = F.col(number) if isinstance(number, str) else number
    return F.struct(order_number(c).alias("num"), F.regexp_extract(c, "([A-Z]*)$", 1).alias("suffix"))


def monotone_rows(df: DataFrame, doc: str, position: str, number: str) -> DataFrame:
    """Rows whose key exceeds that of every row accepted before.

    A refused key is never above the accepted ones, so "greater than the running
    maximum of all earlier keys" keeps exactly the same rows without a loop.
    """
    earlier = W.partitionBy(doc).orderBy(position).rowsBetween(W.unboundedPreceding, -1)
    keyed = df.withColumn("_key", order_key(number)).withColumn("_top", F.max("_key").over(earlier))
    return keyed.filter(F.col("_top").isNull() | (F.col("_key") > F.col("_top"))).drop("_key", "_top")


def monotone_contents(docs: DataFrame, pattern: str, most: int | None = None) -> DataFrame:
    """Dotted numbers of a table of contents; equals pass only with a suffix.

    Group 1 of the pattern is the number with its suffix, in any script: what
    follows the digits. ``most`` is the largest number an edition has, if known.
    The fold stays inside the document's row, so no text is shuffled.
    """
    tokens = F.transform(
        F.regexp_extract_all("text", F.lit(ascii_edges(pattern)), F.lit(1)),
        lambda tok, i: F.struct(
            i.alias("pos"), order_number(tok).alias("num"), F.regexp_extract(tok, r"^\d*(.*)$", 1).alias("suffix")
        ),
    )
    legal = tokens if most is None else F.filter(tokens, lambda s: s["num"] <= most)
    start = F.struct(F.lit(0).alias("top"), F.array().cast("array<struct<pos:int,num:int,suffix:string>>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        passes = (s["num"] > acc["top"]) | ((s["num"] == acc["top"]) & (s["suffix"] != ""))
        return F.when(
            passes, F.struct(s["num"].alias("top"), F.array_append(acc["out"], s).alias("out"))
        ).otherwise(acc)

    kept = F.aggregate(legal, start, step, lambda acc: acc["out"])
    return docs.select("doc_id", F.inline(kept))


def names_below(
    lines: DataFrame, doc: str, position: str, is_heading: Column, name: Column, usable: Column
) -> DataFrame:
    """For each heading the first usable name among the next two lines."""
    w = W.partitionBy(doc).orderBy(position)
    candidate = F.when(usable, name)
    marked = lines.withColumns({"_is": is_heading, "_n": candidate})
    near = F.coalesce(F.lead("_n", 1).over(w), F.lead("_n", 2).over(w))
    return marked.withColumn("name", near).filter("_is").drop("_is", "_n")
