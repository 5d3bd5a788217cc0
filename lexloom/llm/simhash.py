"""SimHash near-duplicates: fingerprints of word shingles, linked through deletion-variant signatures.

Two fingerprints with at most ``distance`` differing bits are cut into m = distance // 2 + 1 segments: some segment then
differs in one bit at most, for two bits in each would be more than ``distance``. So few segments stay long, and a long
segment is selective. Each fingerprint is indexed under every segment as it is, and under every segment with one bit
taken out; of the latter, those where the bit was 0 meet those where it was 1. Pairs that agree on a key are verified
inside the join, each segment proposes a pair once, and no pair within the distance is missed.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .common import over_texts, with_columns
from .components import components

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BITS = 64
SEED = 42
SHINGLE_WORDS = 4
DISTANCE = 4
#: Shingle hashes held at once while a long text is counted.
HASHES_AT_ONCE = 1 << 16


def shingle_hashes(text: str, words: int) -> Iterator[np.ndarray]:
    """XXH64 of the shingles of a text, in order and with repeats, in blocks: A-Z lower-cased, split on ASCII blanks.

    A text with fewer than ``words`` words is one shingle; a text without words has none.
    """
    # bytes.lower and bytes.split know ASCII only, which is the rule here
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens])
    starts = (ends - [len(t) + 1 for t in tokens]).tolist()
    stops = (ends - 1)[words - 1 :].tolist() or [len(joined)]
    digest = xxhash.xxh64_intdigest
    for low in range(0, len(stops), HASHES_AT_ONCE):
        high = min(low + HASHES_AT_ONCE, len(stops))
        yield np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[low:high], stops[low:high])), ">u8", high - low)


def fingerprint(text: str, words: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of a whole text over its shingles of ``words`` words; without words it is zero."""
    return folded(shingle_hashes(text, words))


def folded(blocks: Iterable[np.ndarray]) -> int:
    """64-bit SimHash of shingle hashes that come in blocks, as of ``shingle_hashes``."""
    ones, count = np.zeros(BITS, np.int64), 0
    for hashes in blocks:
        ones += np.unpackbits(hashes.view(np.uint8)).reshape(-1, BITS).sum(0, dtype=np.int64)
        count += len(hashes)
    return int.from_bytes(np.packbits(2 * ones > count).tobytes(), "big")


def fingerprints(documents: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, key, fp) per row: ``fp`` the fingerprint as a signed long, ``key`` a hash of the text. Null is empty."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            marks = [fingerprint(t or "", words) for t in batch.column("text").to_pylist()]
            return with_columns(batch, ["doc_id", "key"], fp=pa.array(np.array(marks, np.uint64).view(np.int64)))

        return work

    rows = documents.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), "text")
    kind = documents.schema["doc_id"].dataType.simpleString()
    return over_texts(rows, "text", make, f"doc_id {kind}, key long, fp long")


def segments(distance: int = DISTANCE) -> list[tuple[int, int]]:
    """(first bit, width) of each of the distance // 2 + 1 segments, as even as they come."""
    count = distance // 2 + 1
    edges = [round(i * BITS / count) for i in range(count + 1)]
    return list(zip(edges, (b - a for a, b in zip(edges, edges[1:]))))


def _keys(nodes: DataFrame, distance: int, bit: int) -> DataFrame:
    """(slot, rest, fp): whole segments, and segments without a bit that is ``bit``."""
    fp = F.col("fp")
    entries = []
    for number, (first, width) in enumerate(segments(distance)):
        segment = F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << width) - 1))
        entries.append(F.struct(F.lit(BITS + number).alias("slot"), segment.alias("rest")))
        for place in range(width):
            rest = segment.bitwiseAND(F.lit(~(1 << place)))
            has = F.getbit(fp, F.lit(first + place)) == bit
            entries.append(F.when(has, F.struct(F.lit(first + place).alias("slot"), rest.alias("rest"))))
    return nodes.select(fp, F.explode(F.array_compact(F.array(*entries))).alias("e")).select("e.slot", "e.rest", "fp")


def fingerprint_links(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b), a <> b: every pair of distinct fingerprints in ``nodes`` (fp) that differ in 1 to ``distance`` bits."""
    zeros = _keys(nodes, distance, 0).select(F.col("slot").alias("slot_a"), F.col("rest").alias("rest_a"), F.col("fp").alias("a"))
    ones = _keys(nodes, distance, 1).select(F.col("slot").alias("slot_b"), F.col("rest").alias("rest_b"), F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    once = (F.col("slot_a") < BITS) | (F.col("a") < F.col("b"))
    same = (F.col("slot_a") == F.col("slot_b")) & (F.col("rest_a") == F.col("rest_b"))
    pairs = zeros.join(ones, same & near & once)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(documents: DataFrame, words: int = SHINGLE_WORDS, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, key, fp, component_id, keeper_key) per row of ``documents`` (doc_id, text).

    Rows whose fingerprints differ in at most ``distance`` bits are linked; ``component_id`` is the smallest doc_id
    reachable, ``keeper_key`` the text hash of that row. Copies share a fingerprint and are one node, so a group of any
    size costs one row per distinct fingerprint; links between different fingerprints are all found.

    Null texts are empty, and all empty texts share fingerprint zero. Repeated rows each come back. A null doc_id takes
    part; a component has a null id only if all its ids are null. Other columns of ``documents`` are ignored. An empty
    table gives no rows.
    """
    marks = checkpointed(fingerprints(documents, words))
    # nulls last: any id is smaller than none
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    nodes = checkpointed(marks.groupBy("fp").agg(F.min(first).alias("first")))
    return with_keepers(marks, nodes, fingerprint_links(nodes.select("fp"), distance), "fp")


def with_keepers(marks: DataFrame, nodes: DataFrame, links: DataFrame, node: str) -> DataFrame:
    """(doc_id, key, node, component_id, keeper_key) per row of ``marks``: the first row of its node's component.

    ``nodes`` holds each node once with its ``first`` row (none, doc_id, key); ``links`` (a, b) are between nodes.
    """
    rooted = components(links).select(F.col("node").alias(node), "root")
    linked = checkpointed(rooted.join(nodes, node).select(node, "root", "first"))
    least = checkpointed(linked.groupBy("root").agg(F.min("first").alias("least")))
    moved = linked.join(least, "root").select(node, "least")
    known = checkpointed(
        nodes.join(moved, node, "left").select(node, F.coalesce("least", "first").alias("keeper"))
    )
    return marks.join(known, node).select(
        "doc_id", "key", node, F.col("keeper.doc_id").alias("component_id"), F.col("keeper.key").alias("keeper_key")
    )


def without_copies(documents: DataFrame, words: int = SHINGLE_WORDS, distance: int = DISTANCE) -> DataFrame:
    """``documents`` with one row per group of near-duplicates: the one of the smallest doc_id.

    Rows repeated as they are count as one document; of rows that share that id but not the text, the one whose text
    has the smallest hash stays. All columns come through, whatever their names.
    """
    return keepers_only(documents, near_duplicates(documents, words, distance))


def keepers_only(documents: DataFrame, found: DataFrame) -> DataFrame:
    """One row of ``documents`` per component of ``found`` (doc_id, key, component_id, keeper_key)."""
    keep = (
        found.where(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("key") == F.col("keeper_key")))
        .select(F.struct("doc_id", "key").alias("kept_row"))
        .distinct()
    )
    mark = F.struct("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"))
    names = documents.columns
    rows = documents.select(F.struct(*names).alias("row"), mark.alias("row_mark"))
    kept = rows.join(keep, rows["row_mark"] == keep["kept_row"], "left_semi")
    return kept.groupBy("row_mark").agg(F.first("row").alias("row")).select("row.*")
