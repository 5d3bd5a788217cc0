"""A walk along ordered candidates: each row offers keys in trust order, and the first one above the cursor is taken.

What a row takes depends on the cursor it meets, so the walk is a fold. Rows are ranged by (document, position) into
blocks, as in ``scan``. A block is summed up as a function of the cursor it is entered with: between two of its keys that
function is constant, so it is one array, made by walking the block backward. Functions of the blocks a document runs
through are applied one after the other, which gives every block its entry, and a second pass walks each block forward.
One document may so span any number of tasks; what reaches the driver is one row per block.
"""

from __future__ import annotations

import sys
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import _BLOCK, _ranged

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Digits that the numeric part of a key is padded to, so that keys compare as text.
_WIDTH = 12
#: The cursor before any key: number 0.
START = "0" * _WIDTH


def sort_text(number: Column) -> Column:
    """Key of a number with a Latin suffix, in document order as text: 239A < 239AA < 239B < 240. Null for others."""
    digits = F.regexp_extract(number, r"^(\d+)[A-Z]*$", 1)
    suffix = F.regexp_extract(number, r"^\d+([A-Z]*)$", 1)
    return F.when(digits != "", F.concat(F.lpad(digits, _WIDTH, "0"), suffix))


def exits(offered: list[list[str]], at: list[int]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(keys, cursor, last) of a block: its keys in order; per entry the exit, and the last position that took a key.

    Entry and exit are counts of keys at or below the cursor; an entry that is its own exit leaves the cursor alone.
    """
    keys = sorted({k for row in offered for k in row})
    rank = {k: i for i, k in enumerate(keys)}
    cursor, last = np.arange(len(keys) + 1), np.full(len(keys) + 1, -1, np.int64)
    for row, place in zip(reversed(offered), reversed(at)):
        to, then = cursor.copy(), last.copy()
        for key in reversed(row):
            upto = rank[key] + 1
            to[:upto] = cursor[upto]
            then[:upto] = place if last[upto] < 0 else last[upto]
        cursor, last = to, then
    return keys, cursor, last


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[int], list[list[str]], list[int]]]:
    """(document, positions, keys offered, block) runs of rows of one document that lie together."""
    doc, at, offered, block = None, [], [], None
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("_doc", "_at", "_keys", _BLOCK))
        for d, a, k, b in zip(*columns):
            if at and d != doc:
                yield doc, at, offered, block
                at, offered = [], []
            doc, block = d, b
            at.append(a)
            offered.append([x for x in k or [] if x is not None])
    if at:
        yield doc, at, offered, block


def _entries(rows: DataFrame) -> dict[int, tuple[str, int]]:
    """Cursor and last taking position with which the first document of a block enters it."""
    schema = "_doc string, _block int, keys array<string>, cursor array<int>, last array<long>"

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # only the first and the last document of a block can reach into another
        first, final = None, None
        for run in _runs(batches):
            first, final = first or run, run
        found = [r for r in ([first] if first is final else [first, final]) if r]
        made = [(r[0], r[3], *exits(r[2], r[1])) for r in found]
        columns = list(zip(*made)) or [()] * 5
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(columns[0], pa.string()),
                pa.array(columns[1], pa.int32()),
                pa.array(columns[2], pa.list_(pa.string())),
                pa.array([c.tolist() for c in columns[3]], pa.list_(pa.int32())),
                pa.array([c.tolist() for c in columns[4]], pa.list_(pa.int64())),
            ],
            names=["_doc", "_block", "keys", "cursor", "last"],
        )

    def carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, state = None, (START, -1)
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["_doc"] != doc:
                    doc, state = row["_doc"], (START, -1)
                else:
                    out.append((row["_block"], *state))
                entry = bisect_right(row["keys"], state[0])
                leave, last = row["cursor"][entry], row["last"][entry]
                state = (state[0] if leave == entry else row["keys"][leave - 1], state[1] if last < 0 else last)
            columns = list(zip(*out)) or [()] * 3
            kinds = {"_block": pa.int32(), "cursor": pa.string(), "last": pa.int64()}
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values())], names=list(kinds))

    blocks = rows.sortWithinPartitions("_doc", "_at").mapInArrow(summed, schema)
    along = blocks.repartition("_doc").sortWithinPartitions("_doc", "_block")
    return {r["_block"]: (r["cursor"], r["last"]) for r in along.mapInArrow(carried, "_block int, cursor string, last long").collect()}


def first_above(df: DataFrame, doc: str, at: str, keys: str, blocks: int | None = None) -> DataFrame:
    """(doc, at, taken, cursor, before) per row of ``df``: the walk of each document in the order of ``at``.

    ``keys`` is an array of texts in trust order, as of ``sort_text``; nulls in it are passed over, a null array offers
    none. ``taken`` is the key taken or null, ``cursor`` the largest key taken before the row (``START`` at first), ``before``
    the position that took it (null at first). ``at`` is a long, unique inside its document; pass narrow rows.
    """
    kind = df.schema[doc].dataType
    narrow = df.select(F.col(doc).cast("string").alias("_doc"), F.col(at).cast("long").alias("_at"), F.col(keys).alias("_keys"))
    rows = _ranged(narrow, ["_doc"], ["_at"], blocks)
    entries = _entries(rows)

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc_now, cursor, last, begun = None, START, -1, False
        for batch in batches:
            out = []
            columns = (batch.column(c).to_pylist() for c in ("_doc", "_at", "_keys", _BLOCK))
            for d, a, offered, block in zip(*columns):
                if not begun or d != doc_now:
                    cursor, last = (START, -1) if begun else entries.get(block, (START, -1))
                    doc_now, begun = d, True
                taken = next((k for k in offered or [] if k is not None and k > cursor), None)
                out.append((d, a, taken, cursor, None if last < 0 else last))
                if taken is not None:
                    cursor, last = taken, a
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["_doc", "_at", "taken", "cursor", "before"]
            )

    schema = "_doc string, _at long, taken string, cursor string, before long"
    found = rows.sortWithinPartitions("_doc", "_at").mapInArrow(walked, schema)
    return found.select(F.col("_doc").cast(kind).alias(doc), F.col("_at").alias(at), "taken", "cursor", "before")
