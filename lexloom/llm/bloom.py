"""Blocked Bloom filters over 64-bit hashes: built by Spark in pages, read by tasks as one broadcast of bounded size.

A hash sets a few bits in one block of 512, so a probe touches one place of memory, and a page of whole blocks needs only
the hashes of its own blocks. Filters are kept per shard. What a filter holds is never denied; what it does not hold may
be let through, so an exact join follows.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from .common import sent

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bits of filter per hash, bits set per hash, words of 64 bits in a block, blocks of a page.
BITS_PER_HASH = 16
BITS_SET = 8
BLOCK = 8
PAGE = 1024
#: Bytes of filters broadcast at once.
BROADCAST_BYTES = 32 << 20
STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit values with all bits depending on all bits of x."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def blocks_for(hashes: int, bits: int = BITS_PER_HASH) -> int:
    """Blocks of a filter of so many hashes."""
    return max(1, -(-hashes * bits // (64 * BLOCK)))


def block_of(hashes: np.ndarray, blocks: int) -> np.ndarray:
    return (mixed(hashes) >> np.uint64(16)).astype(np.int64) % blocks


def bits_of(hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word of the block, bit in it), ``BITS_SET`` times."""
    more = mixed(hashes ^ STEP)
    for _ in range(BITS_SET):
        yield (more & np.uint64(BLOCK - 1)).astype(np.int64), np.uint64(1) << ((more >> np.uint64(3)) & np.uint64(63))
        more = mixed(more + STEP)


class Filters:
    """Pages of the shards' filters; ``blocks`` per shard, and bytes per (shard, page). Pages not held deny all."""

    def __init__(self, blocks: dict[int, int], pages: dict[tuple[int, int], bytes]):
        self.blocks = blocks
        self.held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for shard, count in blocks.items():
            mine = sorted((p, b) for (s, p), b in pages.items() if s == shard)
            if mine:
                first = np.full(-(-count // PAGE), -1, np.int64)
                data = np.concatenate([np.frombuffer(b, np.uint64) for _, b in mine])
                first[[p for p, _ in mine]] = np.cumsum([0, *(len(b) // 8 for _, b in mine[:-1])])
                self.held[shard] = first, data

    def holds(self, shard: int, hashes: np.ndarray) -> np.ndarray:
        """Places of the hashes that the shard's filter may hold."""
        if shard not in self.held:
            return np.zeros(0, np.int64)
        first, data = self.held[shard]
        block = block_of(hashes, self.blocks[shard])
        start = first[block // PAGE]
        left = np.flatnonzero(start >= 0)
        start = (start + block % PAGE * BLOCK)[left]
        for word, bit in bits_of(hashes):
            has = (data[start + word[left]] & bit[left]) != 0
            left, start = left[has], start[has]
        return left


def page_bytes(hashes: np.ndarray, blocks: int, page: int) -> bytes:
    """The page of a filter that holds these hashes, all of its blocks."""
    data = np.zeros(min(PAGE, blocks - page * PAGE) * BLOCK, np.uint64)
    start = (block_of(hashes, blocks) - page * PAGE) * BLOCK
    for word, bit in bits_of(hashes):
        np.bitwise_or.at(data, start + word, bit)
    return data.tobytes()


def pages(hashed: DataFrame, blocks: dict[int, int]) -> DataFrame:
    """(shard, page, data) of ``hashed`` (shard int, hash long): one group per page, of as many hashes as fill it."""

    def paged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column("hash").to_numpy().view(np.uint64)
            shard = batch.column("shard").to_numpy()
            page = np.zeros(len(shard), np.int32)
            for s in np.unique(shard).tolist():
                page[shard == s] = block_of(hashes[shard == s], blocks[s]) // PAGE
            yield pa.RecordBatch.from_arrays(
                [batch.column("shard"), pa.array(page), batch.column("hash")], names=["shard", "page", "hash"]
            )

    def built(table: pa.Table) -> pa.Table:
        shard, page = table.column("shard")[0].as_py(), table.column("page")[0].as_py()
        data = page_bytes(table.column("hash").to_numpy().view(np.uint64), blocks[shard], page)
        return pa.table({"shard": pa.array([shard], pa.int32()), "page": pa.array([page], pa.int32()), "data": [data]})

    dealt = hashed.select("shard", "hash").mapInArrow(paged, "shard int, page int, hash long")
    return dealt.groupBy("shard", "page").applyInArrow(built, "shard int, page int, data binary")


def one_filter(hashed: DataFrame, count: int) -> Callable[[], Filters]:
    """A broadcast filter over ``count`` hashes of ``hashed`` (hash long), as shard 0.

    Beyond ``BROADCAST_BYTES`` it grows denser instead of larger: it lets more through, and still denies nothing it holds.
    """
    from pyspark.sql import functions as F

    blocks = {0: min(blocks_for(count), BROADCAST_BYTES // (8 * BLOCK))}
    rows = pages(hashed.select(F.lit(0).alias("shard"), "hash"), blocks).collect()
    return sent(hashed.sparkSession, Filters(blocks, {(0, r["page"]): bytes(r["data"]) for r in rows}))
