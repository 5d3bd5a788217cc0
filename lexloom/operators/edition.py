"""Joins between editions, side tables and references.

No side is broadcast by hint: Spark broadcasts what its statistics show to be
small and falls back to shuffled joins, which adaptive execution splits on a
skewed key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .scan import number_rows


def with_parent(items: DataFrame, item_key: str, parents: DataFrame, parent_key: str, name: str) -> DataFrame:
    """Parent name of each item, '' when the parent is unknown."""
    looked_up = parents.select(F.col(parent_key).alias(item_key), F.col(name).alias("parent_name"))
    return items.join(looked_up, item_key, "left").withColumn("parent_name", F.coalesce("parent_name", F.lit("")))


def merge_editions(base: DataFrame, other: DataFrame, key: str, defaults: dict[str, Column]) -> DataFrame:
    """Left join that fills absent values of the other edition with defaults."""
    joined = base.join(other.select(key, *defaults), key, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), d) for c, d in defaults.items()})


def missing_keys(expected: DataFrame, present: DataFrame, key: str) -> DataFrame:
    return expected.select(key).join(present.select(key), key, "left_anti")


def key_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys on one side only: (key, side)."""
    return (
        missing_keys(left, right, key)
        .withColumn("side", F.lit("left"))
        .unionByName(missing_keys(right, left, key).withColumn("side", F.lit("right")))
    )


def synthesize_missing(
    items: DataFrame, reference: DataFrame, key: str, fill: dict[str, Column], enough: Column | None = None
) -> DataFrame:
    """Rows of the reference edition that the items lack, filled with constants and appended.

    ``enough`` (a scalar such as a count test) gates the filling, so excerpts stay as they are.
    """
    absent = reference.join(items.select(key), key, "left_anti")
    if enough is not None:
        absent = absent.filter(enough)
    return items.unionByName(absent.select(key, *[v.alias(c) for c, v in fill.items()]), allowMissingColumns=True)


def orphans(children: DataFrame, child_key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose reference has no parent."""
    return children.join(parents.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


def attach_side_text(items: DataFrame, side: DataFrame, key: str, side_text: str) -> DataFrame:
    """Side text where it is not blank; ``covered`` tells whether there is one."""
    blank_is_null = F.when(text.strip(F.col(side_text)) != "", F.col(side_text))
    joined = items.join(side.select(key, blank_is_null.alias(side_text)), key, "left")
    return joined.withColumn("covered", F.col(side_text).isNotNull())


def side_text_findings(items: DataFrame, side: DataFrame, key: str, side_text: str) -> DataFrame:
    """(key, finding): side texts whose key is ``unknown``, and items that no side text leaves ``uncovered``.

    A gate refuses the first (``quality.require_clean`` on them) and lists the second.
    """
    told = side.where(text.strip(F.col(side_text)) != "")
    unknown = side.select(key).distinct().join(items.select(key), key, "left_anti")
    uncovered = items.select(key).join(told.select(key), key, "left_anti")
    return unknown.withColumn("finding", F.lit("unknown")).unionByName(uncovered.withColumn("finding", F.lit("uncovered")))


def head_faults(heads: DataFrame, key: str, site_name: str, site_lead: str) -> DataFrame:
    """(key, title_chars, description_chars, faults) of pages (key, title, description): what search results would show badly.

    Titles of at most 60 characters carry the site's name (or lead with it) and are not repeated; descriptions have 21
    to 159. Character references count as one. ``faults`` are joined by commas, null for none.
    """
    n, d = text.shown_length(F.col("title")), text.shown_length(F.col("description"))
    repeated = heads.groupBy("title").agg((F.count(F.lit(1)) > 1).alias("_repeated")).where("_repeated")
    named = F.contains("title", F.lit(site_name)) | F.startswith("title", F.lit(site_lead))
    tests = [
        (n > 60, "title too long"),
        (~named, "no site name"),
        (F.col("_repeated").isNotNull(), "title repeated"),
        (F.col("description").isNull(), "no description"),
        (d >= 160, "description too long"),
        (d <= 20, "description too short"),
    ]
    faults = F.array_join(F.array_compact(F.array(*(F.when(c, name) for c, name in tests))), ", ")
    joined = heads.join(repeated, "title", "left")
    return joined.select(key, n.alias("title_chars"), d.alias("description_chars"), F.nullif(faults, F.lit("")).alias("faults"))


def crosscheck(left: DataFrame, right: DataFrame, key: str, left_text: str, right_text: str, threshold: float) -> DataFrame:
    """Word-set overlap per key of two sources, with the keys of one side only."""
    a = left.select(key, text.similarity_tokens(F.col(left_text)).alias("_a"))
    b = right.select(key, text.similarity_tokens(F.col(right_text)).alias("_b"))
    common = F.size(F.array_intersect("_a", "_b"))
    overlap = F.when((F.size("_a") > 0) & (F.size("_b") > 0), common / (F.size("_a") + F.size("_b") - common)).otherwise(
        F.lit(0.0)
    )
    joined = a.join(b, key, "full_outer")
    where = F.when(F.col("_b").isNull(), "left only").when(F.col("_a").isNull(), "right only").otherwise("common")
    scored = joined.select(key, where.alias("presence"), F.when(where == "common", overlap).alias("_s"))
    return scored.select(
        key,
        "presence",
        F.round("_s", 3).alias("similarity"),
        F.coalesce(F.col("_s") < threshold, F.lit(False)).alias("flagged"),
    )


def positional_zip(
    left: DataFrame, left_key: str, right: DataFrame, right_key: str, agree: Column | None = None
) -> DataFrame:
    """Pair two ordered key lists by position: (position, left, right).

    Keys are unique non-negative integers on each side. With ``agree`` (a test
    over ``left`` and ``right``) a list running out or a pair failing the test
    fails the job; without it gaps come out as nulls.
    """
    a = number_rows(left.select(F.col(left_key).alias("left")), [], "left", "position")
    b = number_rows(right.select(F.col(right_key).alias("right")), [], "right", "position")
    zipped = a.join(b, "position", "full_outer")
    if agree is None:
        return zipped
    paired = F.col("left").isNotNull() & F.col("right").isNotNull()
    message = F.concat(F.lit("lists disagree at position "), F.col("position").cast("string"))
    checked = F.assert_true(paired & agree, message)
    return zipped.withColumn("_ok", checked).filter("_ok IS NULL").drop("_ok")


def first_available(keys: DataFrame, key: str, sources: Sequence[tuple[DataFrame, str]], name: str) -> DataFrame:
    """First non-null value per key over sources in order of trust."""
    out, columns = keys, []
    for i, (df, value) in enumerate(sources):
        column = f"_s{i}"
        out = out.join(df.select(key, F.col(value).alias(column)), key, "left")
        columns.append(column)
    return out.withColumn(name, F.coalesce(*columns)).drop(*columns)


def broken_references(refs: DataFrame, targets: Sequence[tuple[str, DataFrame, str]]) -> DataFrame:
    """References (type, value) whose target does not exist in the table their type selects."""
    union = None
    for kind, df, key in targets:
        part = df.select(F.lit(kind).alias("type"), F.col(key).cast("string").alias("value"))
        union = part if union is None else union.unionByName(part)
    return refs.join(union, ["type", "value"], "left_anti")


def item_link(kind: Column, value: Column, label: Column) -> Column:
    """Struct(href, label) of a reference; a page needs its own label."""
    from ..functions import numbers

    lowered = F.lower(value)
    return (
        F.when(
            kind == "article",
            F.struct(F.concat(F.lit("/articles/"), lowered, F.lit("/")).alias("href"), F.concat(F.lit("Article "), value).alias("label")),
        )
        .when(
            kind == "part",
            F.struct(
                F.concat(F.lit("/parts/"), lowered, F.lit("/")).alias("href"),
                F.concat(F.lit("Part "), numbers.roman_label(value)).alias("label"),
            ),
        )
        .when(
            kind == "amendment",
            F.struct(
                F.concat(F.lit("/amendments/"), value, F.lit("/")).alias("href"),
                F.concat(numbers.ordinal_suffix(value.try_cast("int")), F.lit(" Amendment")).alias("label"),
            ),
        )
        .when((kind == "page") & (F.coalesce(label, F.lit("")) != ""), F.struct(value.alias("href"), label.alias("label")))
    )
