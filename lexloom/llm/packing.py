"""Packing of tokenized documents into sequences of bounded length by the sum-of-squares rule.

Documents longer than a sequence are cut into full pieces and a rest. A full piece is a sequence of its own. The others
are dealt into parts of bounded size, and within a part each piece goes where the sum, over residual gaps, of the squared
number of open sequences with that gap becomes smallest: into an open sequence of some gap, or into a new one. The rule
keeps gaps of many different sizes open, so that a later piece finds one that fits.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .common import over_texts, texts_of
from .word_ids import WordIds

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SEQUENCE_TOKENS = 2048
END_ID = 0
#: Pieces packed together in one task. Each part leaves a few sequences partly filled.
PART_PIECES = 20_000


def pieces(documents: DataFrame, tokenizer: str, most: int = SEQUENCE_TOKENS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document, its ids followed by id 0. Null text is empty."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        known = WordIds(tokenizer)
        end = np.array([END_ID], "<u4").tobytes()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            row, piece, start, length, crc = [], [], [], [], []
            for number, ids in enumerate(known.of(texts_of(batch))):
                ids += end
                for k, low in enumerate(range(0, len(ids), 4 * most)):
                    part = ids[low : low + 4 * most]
                    row.append(number)
                    piece.append(k)
                    start.append(low // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            return pa.RecordBatch.from_arrays(
                [
                    pc.take(batch.column("doc_id"), pa.array(row, pa.int64())),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

        return work

    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    return over_texts(documents.select("doc_id", "text"), "text", make, schema)


def sum_of_squares(lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece, pieces taken from long to short.

    ``counts[g]`` counts open sequences of gap g. Putting a piece of length s into gap g changes the sum of squares by
    2 (counts[g - s] - counts[g]) + 2, and by 1 - 2 counts[g] where it fills the sequence, which is open no more. Equal
    changes go to the smallest gap. A new sequence is opened where no open one fits: opening one earlier, as the rule
    alone would, ends with more of them.
    """
    order = np.argsort(-lengths, kind="stable")
    counts = np.zeros(most + 1, np.int64)
    waiting: list[list[tuple[int, int]]] = [[] for _ in range(most + 1)]
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    closed = np.iinfo(np.int64).max
    made = 0
    for at, s in zip(order.tolist(), lengths[order].tolist()):
        # by gap, from s up
        change = 2 * (counts[: most - s] - counts[s:most]) + 2
        change[:1] = 1 - 2 * counts[s]
        change[counts[s:most] == 0] = closed
        best = int(change.argmin()) if s < most else 0
        if s < most and change[best] < closed:
            gap = best + s
            number, used = waiting[gap].pop()
            counts[gap] -= 1
        else:
            number, used = made, 0
            made += 1
        sequence[at], offset[at] = number, used
        left = most - used - s
        if left:
            waiting[left].append((number, used + s))
            counts[left] += 1
    return sequence, offset


def pack(documents: DataFrame, tokenizer: str, most: int = SEQUENCE_TOKENS, part_pieces: int = PART_PIECES) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): all ``documents`` (doc_id, text) in sequences.

    Every token is in one piece, and every piece in one sequence of at most ``most`` tokens, at an offset without gaps.
    A null or empty text is one piece, the end id. Repeated rows and rows without a doc_id are packed each. Other
    columns are ignored; an empty table gives no rows.

    Only the narrow rows of pieces that don't fill a sequence are shuffled, dealt round-robin, so that no id or length
    that is frequent crowds a task.
    """
    cut = checkpointed(pieces(documents, tokenizer, most))
    loose = cut.where(F.col("length") < most)
    parts = max(1, -(-loose.count() // part_pieces))
    schema = cut.schema.simpleString()[len("struct<") : -1].replace(":", " ").replace(",", ", ")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        table = pa.Table.from_batches(rows).combine_chunks()
        number, offset = sum_of_squares(table.column("length").to_numpy(), most)
        base = TaskContext.get().partitionId() << 40
        table = table.append_column("sequence_id", pa.array(number + base)).append_column("offset", pa.array(offset))
        yield from table.to_batches(max_chunksize=50_000)

    dealt = loose.repartition(parts)
    placed = dealt.mapInArrow(place, f"{schema}, sequence_id long, offset long")
    full = cut.where(F.col("length") == most).select(
        *cut.columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    return placed.unionByName(full)
