"""Ordered scans that survive a hot key.

A plain window sends all rows of one key to one task. Here the rows are ranged
by (key, order) first, and every range is a block: windows run inside (key,
block), and only one summary row per block is carried along the key and joined
back. A key holding a third of the table is spread over a third of the blocks,
whatever its ids look like: dense, sparse, negative, hashed or text.

Ranges come from a sample, so the ranged rows are written once to the shared
folder; both the windows and the summaries read what was written. Pass narrow
rows. The order column must be unique inside a key together with ``ties``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import checkpointed

_BLOCK = "_block"
_PREVIOUS = (W.unboundedPreceding, -1)


def _ranged(df: DataFrame, keys: Sequence[str], order: Sequence[str], blocks: int | None) -> DataFrame:
    """The rows with the number of their range; as many ranges as the session has shuffle partitions, or ``blocks``."""
    by = [*keys, *order]
    ranged = df.repartitionByRange(*by) if blocks is None else df.repartitionByRange(blocks, *by)
    return checkpointed(ranged.withColumn(_BLOCK, F.spark_partition_id()))


def _windows(keys: Sequence[str], order: Sequence[str]):
    inside = W.partitionBy(*keys, _BLOCK).orderBy(*order)
    along = W.partitionBy(*keys).orderBy(_BLOCK)
    return inside, along


def _attach(local: DataFrame, carried: DataFrame, keys: Sequence[str]) -> DataFrame:
    return local.join(carried, [*keys, _BLOCK], "left")


def placed(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    name: str | None = None,
    total: str | None = None,
    values: Sequence[str] = (),
    ties: Sequence[str] = (),
    blocks: int | None = None,
) -> DataFrame:
    """In one pass: the 1-based position inside the key, the key's row count, ``prev_x`` and ``next_x`` of ``values``."""
    order = [pos, *ties]
    rows = _ranged(df, keys, order, blocks)
    inside, along = _windows(keys, order)
    local, summary, carry = {}, [F.count(F.lit(1)).alias("_n")], []
    if name is not None:
        local["_local"] = F.row_number().over(inside)
        carry.append(F.coalesce(F.sum("_n").over(along.rowsBetween(*_PREVIOUS)), F.lit(0)).alias("_before"))
    if total is not None:
        carry.append(F.sum("_n").over(W.partitionBy(*keys)).alias(total))
    if values:
        row, at = F.struct(*values), F.struct(*order)
        local |= {"_prev": F.lag(row).over(inside), "_next": F.lead(row).over(inside)}
        summary += [F.min_by(row, at).alias("_first"), F.max_by(row, at).alias("_last")]
        carry += [F.lag("_last").over(along).alias("_edge_prev"), F.lead("_first").over(along).alias("_edge_next")]
    carried = rows.groupBy(*keys, _BLOCK).agg(*summary).select(*keys, _BLOCK, *carry)
    out = _attach(rows.withColumns(local), carried, keys)
    found = {}
    if name is not None:
        found[name] = F.col("_local") + F.col("_before")
    prev, nxt = F.coalesce("_prev", "_edge_prev"), F.coalesce("_next", "_edge_next")
    for v in values:
        found |= {f"prev_{v}": prev[v], f"next_{v}": nxt[v]}
    out = out.withColumns(found)
    return out.drop("_local", "_before", "_prev", "_next", "_edge_prev", "_edge_next", _BLOCK)


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    name: str = "row_no",
    total: str | None = None,
    ties: Sequence[str] = (),
    blocks: int | None = None,
) -> DataFrame:
    """1-based position inside the key, and optionally the key's row count."""
    return placed(df, keys, pos, name, total, ties=ties, blocks=blocks)


def neighbours(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    values: Sequence[str],
    ties: Sequence[str] = (),
    blocks: int | None = None,
) -> DataFrame:
    """``prev_x`` and ``next_x`` for every x in ``values``."""
    return placed(df, keys, pos, values=values, ties=ties, blocks=blocks)


def running(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    outputs: dict[str, tuple[str, Column]],
    ties: Sequence[str] = (),
    blocks: int | None = None,
) -> DataFrame:
    """Running values along a key.

    Kinds: ``max_before`` and ``last_before`` (rows strictly before), ``sum``,
    ``xor`` and ``last`` (this row included); ``last`` skips nulls.
    """
    order = [pos, *ties]
    rows = _ranged(df, keys, order, blocks)
    inside, along = _windows(keys, order)
    so_far = inside.rowsBetween(W.unboundedPreceding, 0)
    before = inside.rowsBetween(*_PREVIOUS)
    earlier = along.rowsBetween(*_PREVIOUS)
    at = F.struct(*order)
    local, summary, carry, combine = {}, [], [], {}
    for name, (kind, c) in outputs.items():
        mine, theirs = f"_l_{name}", f"_c_{name}"
        if kind == "max_before":
            local[mine] = F.max(c).over(before)
            summary.append(F.max(c).alias(theirs))
            carry.append(F.max(theirs).over(earlier).alias(theirs))
            combine[name] = F.greatest(mine, theirs)
        elif kind == "sum":
            local[mine] = F.sum(c).over(so_far)
            summary.append(F.sum(c).alias(theirs))
            carry.append(F.sum(theirs).over(earlier).alias(theirs))
            combine[name] = F.coalesce(mine, F.lit(0)) + F.coalesce(theirs, F.lit(0))
        elif kind == "xor":
            local[mine] = F.bit_xor(c).over(so_far)
            summary.append(F.bit_xor(c).alias(theirs))
            carry.append(F.bit_xor(theirs).over(earlier).alias(theirs))
            combine[name] = F.coalesce(F.col(mine), F.lit(0)).bitwiseXOR(F.coalesce(F.col(theirs), F.lit(0)))
        elif kind in ("last", "last_before"):
            local[mine] = F.last(c, ignorenulls=True).over(so_far if kind == "last" else before)
            summary.append(F.max_by(c, F.when(c.isNotNull(), at)).alias(theirs))
            carry.append(F.last(theirs, ignorenulls=True).over(earlier).alias(theirs))
            combine[name] = F.coalesce(mine, theirs)
        else:
            raise ValueError(f"unknown running kind {kind}")
    carried = rows.groupBy(*keys, _BLOCK).agg(*summary).select(*keys, _BLOCK, *carry)
    out = _attach(rows.withColumns(local), carried, keys).withColumns(combine)
    return out.drop(_BLOCK, *local, *[f"_c_{n}" for n in outputs])
