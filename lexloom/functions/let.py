"""A named value inside an expression, so a long expression is evaluated once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sql(value: str | int) -> str:
    return str(value) if isinstance(value, int) else "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def constant_array(items: list) -> Column:
    """Array of constants parsed in one call, not built literal by literal."""
    return F.expr("array(" + ", ".join(_sql(i) for i in items) + ")")


def constant_map(entries: dict) -> Column:
    return F.expr("map(" + ", ".join(f"{_sql(k)}, {_sql(v)}" for k, v in entries.items()) + ")")


OFFSET_BLOCK = 256


def offsets(lengths: Column) -> Column:
    """Start of each piece: running sums before it, 0 first.

    Sums run inside blocks and then over block totals, because growing one array
    entry by entry copies it every time.
    """
    ints = "array<int>"

    def sums(values: Column, start: Column) -> Column:
        begin = F.struct(start.alias("at"), F.array().cast(ints).alias("out"))

        def step(acc: Column, v: Column) -> Column:
            return F.struct((acc["at"] + v).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))

        return F.aggregate(values, begin, step, lambda acc: acc["out"])

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0), lambda acc, v: acc + v)

    def whole(values: Column) -> Column:
        last = F.greatest(F.floor((F.size(values) - 1) / OFFSET_BLOCK), F.lit(0)).cast("int")
        blocks = F.transform(
            F.sequence(F.lit(0), last), lambda b: F.slice(values, b * OFFSET_BLOCK + 1, F.lit(OFFSET_BLOCK))
        )

        def joined(parts: Column) -> Column:
            starts = sums(F.transform(parts, total), F.lit(0))
            return let(starts, lambda at: F.flatten(F.transform(parts, lambda p, b: sums(p, F.get(at, b)))))

        return let(blocks, joined)

    return let(lengths, whole)
