"""Helpers of the operators: Arrow passes over bounded chunks, held-out folds, bounded samples, vector blocks."""

from __future__ import annotations

import io
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import checkpointed, small_batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of text handled at once inside a task.
CHUNK_BYTES = 4 << 20


def chunks(batches: Iterator[pa.RecordBatch], column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``most`` bytes in a column; a longer single value is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes, dtype=np.int64) // most
        starts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [batch.num_rows]])
        for low, high in zip(starts[:-1], starts[1:], strict=True):
            yield batch.slice(low, high - low)


def over_texts(
    df: DataFrame,
    column: str,
    make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]],
    schema: T.StructType | str,
) -> DataFrame:
    """Map Arrow chunks of ``df``. ``make`` runs once per task and returns the function of a chunk.

    A batch holds texts of any length, so a task's memory follows the longest text, not the number of rows. Bounds the
    session's Arrow batches to BATCH_BYTES; workers live on from stage to stage, so what a task held is given back.
    """
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for part in chunks(batches, column):
            yield work(part)
        del work
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Texts of a chunk; null is empty."""
    return [s or "" for s in batch.column(column).to_pylist()]


def with_columns(batch: pa.RecordBatch, keep: list[str], **new: pa.Array) -> pa.RecordBatch:
    names = [*keep, *new]
    return pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *new.values()], names=names)


def sent(spark: SparkSession, model: object) -> Callable[[], object]:
    """A model of bounded size, broadcast once; the result gives it inside a task. It travels by value, class included."""
    held = spark.sparkContext.broadcast(cloudpickle.dumps(model))
    return lambda: cloudpickle.loads(held.value)


def fold(key: Column, modulus: int) -> Column:
    """crc32 of a key as text, modulo; a null key has fold null."""
    return F.crc32(key.cast("string")) % modulus


def held_out(key: Column, modulus: int, remainder: int) -> Column:
    """Whether a row belongs to the fold that no label is learned from; null keys carry no label and are not held out."""
    return F.coalesce(fold(key, modulus) == remainder, F.lit(False))


def labelled_sample(
    documents: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int, most: int
) -> DataFrame:
    """(text, y, n): at most ``most`` distinct labelled rows outside the held-out fold, with how often each is met.

    Labels without a key or a value teach nothing; a key labelled twice counts as its larger label. Keys are chosen by a
    hash, at most ``most`` pairs of numbers, so they are broadcast; the texts are not moved. Ids may be repeated in any
    number of rows: rows of equal text and label are one, and of more than ``most`` those of the smallest hashes stay,
    whatever their label. Only hashes are sorted, and nothing is written before it is bounded. The sample is checkpointed,
    so that what is learned from it in several passes reads the corpus no more.
    """
    known = (
        labels.select(F.col("doc_id").alias("k"), F.col(label).cast("int").alias("y"))
        .where(F.col("k").isNotNull() & F.col("y").isNotNull() & (fold(F.col("k"), modulus) != remainder))
        .groupBy("k")
        .agg(F.max("y").alias("y"))
    )
    chosen = checkpointed(known.orderBy(F.xxhash64("k"), "k").limit(most))
    texts = documents.select(F.col("doc_id").alias("k"), "text")
    rows = texts.join(F.broadcast(chosen), "k").select("text", "y", F.xxhash64("text", "y").alias("mark"))
    marks = checkpointed(rows.groupBy("mark").agg(F.count("*").alias("n")))
    last = marks.orderBy("mark").limit(most).agg(F.max("mark")).first()[0]
    kept = rows.where(F.col("mark") <= F.lit(last)).groupBy("mark")
    return checkpointed(kept.agg(F.first("text").alias("text"), F.first("y").alias("y"), F.count("*").alias("n")).drop("mark"))


# Vectors ---------------------------------------------------------------------------------------------------------------


def usable_vectors(vectors: DataFrame, nonzero: bool) -> DataFrame:
    """(vec_id, v, dim): vectors that are neither null nor empty and hold finite numbers only, as doubles."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select("vec_id", v.alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0) & finite)
    if nonzero:
        rows = rows.where(F.exists("v", lambda x: x != 0))
    return rows.where(F.col("vec_id").isNotNull()).withColumn("dim", F.size("v"))


#: Bytes of shards, as doubles, that a task of a search holds while all queries pass it.
SLOT_BYTES = 128 << 20


def packed(
    rows: DataFrame, count: int, build: Callable[[np.ndarray, np.ndarray], bytes], asked: bool, cells: Callable[[int], list[int]]
) -> DataFrame:
    """Rows (vec_id, v, dim) as blobs, (cell, asked, dim, blob): one per dimension and part of ``count``, in each of its cells.

    A hash of the id deals rows out evenly, whatever their values. Copies of a blob leave the task one after the other, for
    an explode holds all copies of a row on the heap.
    """
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(count)).cast("int"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        ids = table.column("vec_id").to_numpy()
        dim, part = table.column("dim")[0].as_py(), table.column("part")[0].as_py()
        matrix = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        order = np.argsort(ids, kind="stable")
        blob = pa.array([build(ids[order], np.ascontiguousarray(matrix[order]))], pa.binary())
        for cell in cells(part):
            yield pa.RecordBatch.from_arrays(
                [pa.array([cell], pa.int32()), pa.array([asked]), pa.array([dim], pa.int32()), blob],
                names=["cell", "asked", "dim", "blob"],
            )

    return dealt.groupBy("dim", "part").applyInArrow(pack, "cell int, asked boolean, dim int, blob binary")


def to_blob(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes; doubles that are all floats take half of them."""
    out = io.BytesIO()
    for a in arrays:
        if a.dtype == np.float64:
            with np.errstate(all="ignore"):
                short = a.astype(np.float32)
            a = short if np.array_equal(short, a) else a
        np.save(out, a, allow_pickle=False)
    return out.getvalue()


def from_blob(blob: bytes) -> list[np.ndarray]:
    """The arrays of ``to_blob``."""
    source, found = io.BytesIO(blob), []
    while source.tell() < len(blob):
        a = np.load(source, allow_pickle=False)
        found.append(a.astype(np.float64) if a.dtype == np.float32 else a)
    return found


def searched(
    vectors: DataFrame,
    queries: DataFrame,
    index: Callable[[np.ndarray, np.ndarray], bytes],
    search: Callable[[bytes, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]],
    k: int,
    shard_rows: int,
    block_rows: int,
    score: str,
) -> DataFrame:
    """(query_id, rank, vec_id, score): blocks of queries against every shard, the k best merged.

    A shard is built once, by one task. Shards are dealt to slots of about SLOT_BYTES, two per core at least as far as there
    are as many shards; where slots are fewer, blocks of queries are dealt to lanes. A cell is a slot and a lane: one task,
    which holds the slot's shards and lets the lane's blocks pass one by one. What moves is (slots x queries) and
    (lanes x shards), and back the k best per query and cell. Vectors of another dimension than the query's are never compared.
    """
    small_batches(vectors.sparkSession)
    tasks = 2 * vectors.sparkSession.sparkContext.defaultParallelism
    size = F.coalesce(F.sum("dim") * 8, F.lit(0))
    rows, held_bytes = vectors.agg(F.count("*"), size).first()
    shards, blocks = max(1, -(-rows // shard_rows)), max(1, -(-queries.count() // block_rows))
    slots = min(shards, max(tasks, -(-held_bytes // SLOT_BYTES)))
    lanes = min(blocks, -(-tasks // slots))
    cells = packed(vectors, shards, index, False, lambda part: [part % slots * lanes + lane for lane in range(lanes)]).unionAll(
        packed(queries, blocks, to_blob, True, lambda part: [slot * lanes + part % lanes for slot in range(slots)])
    )
    met = cells.repartitionById(slots * lanes, F.col("cell")).sortWithinPartitions("cell", "asked")
    kind = {"long": pa.int64(), "double": pa.float64()}[score]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}  # shards of the cell by dimension; they come before its queries
        at = None
        for batch in batches:
            for cell, asked, dim, blob in zip(*(batch.column(c) for c in ("cell", "asked", "dim", "blob")), strict=True):
                if cell.as_py() != at:
                    held, at = {}, cell.as_py()
                if not asked.as_py():
                    held.setdefault(dim.as_py(), []).append(blob.as_py())
                elif dim.as_py() in held:
                    query_ids, matrix = from_blob(blob.as_py())
                    q, v, s = merged((search(shard, query_ids, matrix) for shard in held[dim.as_py()]), k)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, kind)],
                        names=["query_id", "vec_id", "score"],
                    )

    found = met.mapInArrow(run, f"query_id long, vec_id long, score {score}")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def k_best(owner: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores per owner, ties to the smaller id."""
    down = ~scores if scores.dtype.kind == "i" else -scores  # the lowest long has no opposite
    order = np.lexsort((ids, down, owner))
    sorted_owner = owner[order]
    first = np.searchsorted(sorted_owner, sorted_owner, side="left")
    return order[np.arange(len(order)) - first < k]


#: Rows found, at least, between two cuts to the k best.
MERGED_ROWS = 1 << 18


def merged(found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best per owner of many searches: owners, ids, scores."""

    def cut(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        owner, ids, scores = (np.concatenate(x) for x in zip(*parts, strict=True))
        kept = k_best(owner, ids, scores, k)
        return owner[kept], ids[kept], scores[kept]

    held, rows, most = [], 0, MERGED_ROWS
    for part in found:
        held, rows = [*held, part], rows + len(part[0])
        if rows >= most:
            held = [cut(held)]
            rows = len(held[0][0])
            most = max(MERGED_ROWS, 2 * rows)
    return cut(held)


#: Fills the places of best lists that are not full; its score is minus infinity.
NO_ID = np.iinfo(np.int64).max


class Best:
    """The k best rows per query so far; ties go to the smaller id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.scores = np.full((queries, k), -np.inf)
        self.ids = np.full((queries, k), NO_ID)

    def floor(self) -> np.ndarray:
        """The score a row must reach to be competitive."""
        return self.scores[:, -1]

    def add(self, who: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Merge pairs (query, id, score)."""
        touched, place = np.unique(who, return_inverse=True)
        n = len(touched)
        owner = np.concatenate([np.repeat(np.arange(n), self.k), place])
        all_ids = np.concatenate([self.ids[touched].ravel(), ids])
        all_scores = np.concatenate([self.scores[touched].ravel(), scores])
        kept = k_best(owner, all_ids, all_scores, self.k)
        self.scores[touched] = all_scores[kept].reshape(n, self.k)
        self.ids[touched] = all_ids[kept].reshape(n, self.k)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query numbers, ids and scores held."""
        owner, slot = np.nonzero(self.scores > -np.inf)
        return owner, self.ids[owner, slot], self.scores[owner, slot]
