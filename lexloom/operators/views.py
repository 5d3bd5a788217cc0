"""Views served from the corpus: neighbours, siblings, directories, timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import number_rows, placed


def siblings(items: DataFrame, parent: str, key: str) -> DataFrame:
    """Place of each item among its parent's items with its neighbours.

    The full list of a parent is its rows in order of ``position``; no pair or
    list per item is built, so a parent with a third of all items stays linear.
    """
    return placed(items, [parent], key, "position", "n_siblings", [key])


def directory(groups: DataFrame, group: str, items: DataFrame, item_group: str, item: str) -> DataFrame:
    """Every group with its items in order; a group without items keeps one row."""
    numbered = number_rows(items.select(F.col(item_group).alias(group), item), [group], item, "position")
    return groups.join(numbered, group, "left")


def timeline(rows: DataFrame, number: str, year: str, width: int = 1000, height: int = 320) -> DataFrame:
    """x by year, y by place inside the year, wrapping upward.

    Places inside a year come from a blocked count, the span of years from a
    one-row aggregate.
    """
    left, right, row_height = 24, 24, 14
    usable, baseline = width - left - right, height - 28
    max_rows = max((baseline - 8) // row_height, 1)
    span = rows.agg(F.min(year).alias("_first"), F.max(year).alias("_last"))
    numbered = number_rows(rows, [year], number, "_place")
    first = span.select("_first").scalar()
    years = F.greatest(span.select(F.col("_last") - F.col("_first")).scalar(), F.lit(1))
    x = F.lit(left) + (F.col(year) - first) / years * usable
    y = F.lit(baseline) - F.pmod(F.col("_place") - 1, F.lit(max_rows)) * row_height
    return numbered.withColumns({"x": F.round(x, 1), "y": y.cast("int")}).drop("_place")


def timeline_ticks(rows: DataFrame, year: str, width: int = 1000) -> DataFrame:
    """Year marks every 1, 5 or 10 years by the span."""
    usable = width - 48
    span = rows.agg(F.min(year).alias("a"), F.max(year).alias("b")).withColumn(
        "s", F.greatest(F.col("b") - F.col("a"), F.lit(1))
    )
    step = F.when(F.col("s") <= 20, 1).when(F.col("s") <= 45, 5).otherwise(10)
    start = (F.ceil(F.col("a") / step) * step).cast("int")
    ticks = F.when(start <= F.col("b"), F.sequence(start, F.col("b").cast("int"), step))
    return span.select("a", "s", F.explode(ticks).alias("year")).select(
        "year", F.round(F.lit(24) + (F.col("year") - F.col("a")) / F.col("s") * usable, 1).alias("x")
    )


def affected_items(items: DataFrame, key: str, events: str) -> DataFrame:
    """(event, item) for every event in an item's list: exploded, never joined on array_contains."""
    return items.select(F.explode(F.array_distinct(F.col(events))).alias("event"), F.col(key).alias("item"))


def event_summary(affected: DataFrame) -> DataFrame:
    """Items per event, its summary line and theme from one pass of map-side counts."""
    from ..functions.numbers import change_summary, order_number

    n = order_number(F.col("item").cast("string"))

    def any_in(*ranges: tuple[int, int]) -> Column:
        inside = F.lit(False)
        for low, high in ranges:
            inside = inside | n.between(low, high)
        return F.bool_or(F.coalesce(inside, F.lit(False)))

    theme = (
        F.when(any_in((352, 360)), "emergency")
        .when(any_in((12, 35)), "rights")
        .when(any_in((243, 243), (330, 342)), "social")
        .when(any_in((52, 151), (245, 312), (214, 231)), "federal")
        .otherwise("general")
    )
    counted = affected.groupBy("event").agg(
        F.count(F.lit(1)).alias("n_items"), F.min("item").alias("first_item"), F.max("item").alias("last_item"), theme.alias("theme")
    )
    return counted.withColumn("summary", change_summary(F.col("n_items")))
