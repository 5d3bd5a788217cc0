"""Near copies by SimHash and Jaccard similarity: every pair of word shingle sets at or above the similarity, none below.

SimHash comes first: fingerprints of the same shingles are linked through the deletion-variant signatures of ``simhash``,
and what they link is verified on whole sets. At a similarity of 0.8 two fingerprints differ in about 10 of 64 bits, which
no selective signature reaches, so the pairs that SimHash leaves are found by an exact join, only between sets that it
has not connected.

Two sets of similarity t or more share an element among the first n - ceil(t n) + 1 of each, in any order that all sets
keep. So each distinct set is listed under these elements only. Where two sets meet early enough in both lists to share
that much, they are verified on all their elements.
The order puts elements that a sample of texts shows to be common last (common lines and passages lead to few meetings
then); it decides the cost, not the result. Where many sets meet, all are first compared with one of them; what is
linked by then needs no comparison of its own. The sets of a crowd that are still apart carry their bitmaps into the
join, which lets through only pairs that the bitmaps do not deny: a large group of near copies, or of sets that merely
share a passage, gives no rows for the square of its size.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed, small_batches
from .bloom import one_filter
from .common import chunks, over_texts, sent, with_columns
from .simhash import fingerprint_links, folded, keepers_only, shingle_hashes, with_keepers

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Texts looked at for common shingles, in how many of them one is common, and how many are told to the tasks.
SAMPLE_TEXTS = 8000
COMMON_IN = 4
COMMON_MOST = 1 << 13
#: Sets that meet under one element before they are compared with one of them first.
CROWD = 16
#: Places of a bitmap at least, and of those that the join of a crowd looks at.
PLACES = 1 << 10


def shingle_set(text: str, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Hashes of the distinct shingles of a whole text, sorted."""
    return _distinct(shingle_hashes(text, words))


def _distinct(blocks: Iterable[np.ndarray]) -> np.ndarray:
    """Distinct hashes of blocks, sorted."""
    blocks = [np.unique(h.astype(np.uint64)) for h in blocks]
    return np.unique(np.concatenate(blocks)) if blocks else np.zeros(0, np.uint64)


def listed_under(shingles: np.ndarray, common: np.ndarray, rank: np.ndarray, similarity: Fraction) -> tuple[np.ndarray, int]:
    """The first n - ceil(t n) + 1 shingles: rare ones by hash, then those in ``common`` (sorted) by ``rank``.

    The number of rare ones comes along.
    """
    n = len(shingles)
    most = n - -(-similarity.numerator * n // similarity.denominator) + 1
    rare = n
    if n and len(common):
        place = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        known = common[place] == shingles
        rare = n - int(known.sum())
        shingles = np.concatenate([shingles[~known], shingles[known][np.argsort(rank[place[known]])]])
    return shingles[:most], rare


def _lists(sets: list[np.ndarray]) -> pa.ListArray:
    values = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(values))


def _sets(rows: DataFrame, keep: str, words: int) -> DataFrame:
    """(keep, s) per row (keep, text) of type long."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        return lambda batch: with_columns(
            batch, [keep], s=_lists([shingle_set(t or "", words) for t in batch.column("text").to_pylist()])
        )

    return over_texts(rows.select(keep, "text"), "text", make, f"{keep} long, s array<long>")


def common_shingles(documents: DataFrame, words: int) -> np.ndarray:
    """Hashes of shingles that many texts of a sample hold, rarest first."""
    share = min(1.0, SAMPLE_TEXTS / max(documents.count(), 1))
    key = F.xxhash64(F.coalesce("text", F.lit(""))).alias("key")
    texts = documents.select(key, "text").where(F.pmod("key", F.lit(1 << 20)) < round(share * (1 << 20)))
    found = _sets(texts.dropDuplicates(["key"]), "key", words).select(F.explode("s").alias("h")).groupBy("h").count()
    rows = found.where(F.col("count") >= COMMON_IN).orderBy(F.desc("count"), "h").limit(COMMON_MOST).collect()
    return np.array([r["h"] for r in reversed(rows)], np.int64).view(np.uint64)


def bitmap(shingles: np.ndarray) -> bytes:
    """Which places of ``PLACES`` or more, about one per shingle, an odd number of the shingles falls on."""
    width = max(PLACES, 1 << (len(shingles) - 1).bit_length()) if len(shingles) else PLACES
    odd = np.bincount((shingles & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def differing(a: bytes, b: bytes) -> int:
    """Places at which two bitmaps differ, the wider one folded: at most as many as the sets have elements apart."""
    x, y = (np.frombuffer(v, np.uint8) for v in sorted((a, b), key=len))
    return int(np.unpackbits(x ^ narrowed(y, len(x))).sum())


def narrowed(bits: np.ndarray, size: int) -> np.ndarray:
    """A bitmap folded to so many bytes."""
    while len(bits) > size:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def _marks(documents: DataFrame, words: int, similarity: Fraction) -> DataFrame:
    """(doc_id, key, node, fp, n, rare, under, bits) per row: ``node`` a hash of the shingle set, ``n`` its size.

    ``fp`` is the text's SimHash over the same shingles, repeats included.
    """
    told = sent(documents.sparkSession, common_shingles(documents, words))

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        ranked = told()
        rank = np.argsort(ranked)
        common = ranked[rank]

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets, prints = [], []
            for t in batch.column("text").to_pylist():
                blocks = list(shingle_hashes(t or "", words))
                sets.append(_distinct(blocks))
                prints.append(folded(blocks))
            under = [listed_under(s, common, rank, similarity) for s in sets]
            return with_columns(
                batch,
                ["doc_id", "key"],
                node=pa.array(np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)),
                fp=pa.array(np.array(prints, np.uint64).view(np.int64)),
                n=pa.array([len(s) for s in sets], pa.int32()),
                rare=pa.array([r for _, r in under], pa.int32()),
                under=_lists([u for u, _ in under]),
                bits=pa.array([bitmap(s) for s in sets], pa.binary()),
            )

        return work

    rows = documents.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), "text")
    kind = documents.schema["doc_id"].dataType.simpleString()
    return over_texts(rows, "text", make, f"doc_id {kind}, key long, node long, fp long, n int, rare int, under array<long>, bits binary")


#: Bytes of a shingle's hash that are compared when a pair is verified.
HELD_BYTES = 5


def _held(shingles: np.ndarray) -> bytes:
    """The leading bytes of sorted hashes."""
    return shingles.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :HELD_BYTES].tobytes()


def _shared(a: bytes, b: bytes) -> int:
    """How many elements two sets of ``_held`` have in common."""

    def numbers(data: bytes) -> np.ndarray:
        wide = np.zeros((len(data) // HELD_BYTES, 8), np.uint8)
        wide[:, 8 - HELD_BYTES :] = np.frombuffer(data, np.uint8).reshape(-1, HELD_BYTES)
        return wide.view(">u8").ravel().astype(np.uint64)

    return len(np.intersect1d(numbers(a), numbers(b)))


def _asked_sets(documents: DataFrame, asked: DataFrame, words: int) -> DataFrame:
    """(node, s) of ``asked`` (node, doc_id, key): the sets of their texts, made where the texts are read.

    A Bloom filter of the asked rows is told to the tasks, so that no text moves and few sets are made for nothing.
    """
    mark = F.xxhash64("doc_id", "key")
    told = one_filter(asked.select(mark.alias("hash")), asked.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = told()
        for batch in batches:
            found = batch.take(pa.array(filters.holds(0, batch.column("mark").to_numpy().view(np.uint64))))
            for part in chunks(iter([found]), "text"):
                sets = [_held(shingle_set(t or "", words)) for t in part.column("text").to_pylist()]
                yield with_columns(part, ["doc_id", "key"], s=pa.array(sets, pa.binary()))

    key = F.xxhash64(F.coalesce("text", F.lit(""))).alias("key")
    rows = documents.select("doc_id", key, "text").withColumn("mark", mark)
    kind = documents.schema["doc_id"].dataType.simpleString()
    made = rows.mapInArrow(run, f"doc_id {kind}, key long, s binary")
    same = made["doc_id"].eqNullSafe(asked["doc_id"]) & (made["key"] == asked["key"])
    # a row repeated as it is gives its set again
    return made.join(asked, same).select("node", "s").groupBy("node").agg(F.max("s").alias("s"))


def _alike(p: int, q: int, names: list[str]):
    """Drops pairs whose bitmaps differ in more places than the similarity leaves apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("_na", "_nb", "_bitsa", "_bitsb"))
            apart = [differing(x, y) * (p + q) <= (m + n) * (q - p) for m, n, x, y in zip(*columns)]
            yield batch.select(names).filter(pa.array(apart, pa.bool_()))

    return run


def _narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, w): bitmaps of ``PLACES`` places as words of 64."""
    for batch in batches:
        kept = [narrowed(np.frombuffer(b.as_py(), np.uint8), PLACES // 8) for b in batch.column("bits")]
        words = pa.array(np.concatenate([np.zeros(0, np.uint8), *kept]).view(np.int64))
        starts = pa.array(np.arange(batch.num_rows + 1) * (PLACES // 64), pa.int32())
        yield with_columns(batch, ["node"], w=pa.ListArray.from_arrays(starts, words))


def _overlapping(p: int, q: int, names: list[str]):
    """Keeps pairs whose sets share enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [
                _shared(x.as_py(), y.as_py()) * (p + q) * HELD_BYTES >= (len(x.as_py()) + len(y.as_py())) * p
                for x, y in zip(batch.column("_sa"), batch.column("_sb"))
            ]
            yield batch.select(names).filter(pa.array(kept, pa.bool_()))

    return run


def _met(nodes: DataFrame) -> DataFrame:
    """(h, node, root, n, rare, at, met) of the listed shingles that several nodes list; ``met`` is how many do.

    Most shingles are listed once. They are counted as bare hashes, those met again go to a Bloom filter, and the lists
    are read once more through it, so that a lone shingle never moves with its node.
    """
    counts = nodes.select(F.explode("under").alias("h")).groupBy("h").agg(F.count("*").alias("met"))
    counts = checkpointed(counts.where("met > 1"))
    told = one_filter(counts.select(F.col("h").alias("hash")), counts.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = told()
        for batch in batches:
            lists = batch.column("under")
            flat = lists.flatten().to_numpy()
            sizes = np.diff(lists.offsets.to_numpy())
            owner = np.repeat(np.arange(batch.num_rows), sizes)
            place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            kept = filters.holds(0, flat.view(np.uint64))
            who = pa.array(owner[kept])
            columns = [pa.array(flat[kept]), *(batch.column(c).take(who) for c in ("node", "root", "n", "rare"))]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(place[kept].astype(np.int32))], names=["h", "node", "root", "n", "rare", "at"]
            )

    listed = nodes.select("node", "root", "n", "rare", "under").mapInArrow(run, "h long, node long, root long, n int, rare int, at int")
    return checkpointed(listed.join(counts, "h").withColumn("n", F.col("n").cast("long")))


def _fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b), one pair per node at most: what SimHash proposes to compare ``nodes`` (node, fp) with.

    Sets of one fingerprint are compared with one of them, and that one with the set of the smallest fingerprint that its
    own is linked to, so a large group costs a pair per set.
    """
    heads = checkpointed(nodes.groupBy("fp").agg(F.min("node").alias("head")))
    same = nodes.join(heads, "fp").where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    least = fingerprint_links(heads.select("fp")).groupBy("b").agg(F.min("a").alias("a"))
    mine = heads.select(F.col("fp").alias("b"), F.col("head").alias("more"))
    theirs = heads.select(F.col("fp").alias("a"), F.col("head").alias("less"))
    return same.union(least.join(mine, "b").join(theirs, "a").select(F.col("more").alias("a"), F.col("less").alias("b")))


def _roots(best: DataFrame, a: str, root: str) -> DataFrame:
    """(a, root): two links on at most along ``best`` (a, b); sets of one root are connected, those of different roots may be."""
    on = best.select(F.col("a").alias("b"), F.col("b").alias("further"))
    return best.join(on, "b", "left").select(F.col("a").alias(a), F.coalesce("further", "b").alias(root))


def links(documents: DataFrame, nodes: DataFrame, words: int, similarity: Fraction) -> DataFrame:
    """(a, b): pairs of ``nodes`` at or above the similarity, enough to connect all that such pairs connect.

    Pairs that SimHash proposes are verified first; every set then has a root, and only sets of different roots are
    compared further. The first shingle that two such sets share, in the common order, has so few before it in either that what follows can
    still hold all they must share. Only meetings at such places are joined; the sets of nodes that take part in one are
    made again from their texts and compared whole.
    """
    p, q = similarity.numerator, similarity.denominator
    def enough(shared: Column, m: Column, n: Column) -> Column:
        return shared * (p + q) >= (m + n) * p

    def may_be_first(m: Column, at_m: Column, n: Column, at_n: Column) -> Column:
        return enough(F.least(m - at_m, n - at_n), m, n)

    def not_denied() -> Column:
        # columns of their own, so that the join compares numbers only
        apart = sum((F.bit_count(F.col(f"w{i}_a").bitwiseXOR(F.col(f"w{i}_b"))) for i in range(PLACES // 64)), F.lit(0))
        return apart * (p + q) <= (F.col("n_a") + F.col("n_b")) * (q - p)

    def verified(pairs: DataFrame) -> DataFrame:
        """Those of ``pairs`` (a, b, ...) at or above the similarity, with their other columns.

        Bitmaps drop most of the others. The sets of what is left are made where its texts are, told by a Bloom filter,
        and a pair moves with one of them.
        """
        names = pairs.columns
        sized = [nodes.select(F.col("node").alias(x), F.col("n").alias(f"_n{x}"), F.col("bits").alias(f"_bits{x}")) for x in "ab"]
        near = pairs.join(sized[0], "a").join(sized[1], "b").select(*names, "_na", "_nb", "_bitsa", "_bitsb")
        near = checkpointed(near.mapInArrow(_alike(p, q, names), pairs.schema))
        asked = near.select(F.col("a").alias("node")).union(near.select("b")).distinct()
        asked = checkpointed(nodes.select("node", "first.doc_id", "first.key").join(asked, "node"))
        sets = _asked_sets(documents, asked, words)
        both = near.join(sets.select(F.col("node").alias("a"), F.col("s").alias("_sa")), "a")
        both = both.join(sets.select(F.col("node").alias("b"), F.col("s").alias("_sb")), "b")
        return both.select(*names, "_sa", "_sb").mapInArrow(_overlapping(p, q, names), pairs.schema)

    found = checkpointed(verified(checkpointed(_fingerprint_pairs(nodes))))
    known = _roots(found, "node", "known")
    met = _met(nodes.join(known, "node", "left").withColumn("root", F.coalesce("known", "node")))
    rooted = met
    crowd = met.where(F.col("met") > CROWD)
    if crowd.limit(1).count():
        # the leader of a crowd is the set with the fewest shingles of its own
        order = F.struct("rare", F.xxhash64("node").alias("chance"), "node", "n", "at", "root")
        led = crowd.groupBy("h").agg(F.min(order).alias("leader"))
        near = may_be_first(F.col("n"), F.col("at"), F.col("leader.n"), F.col("leader.at"))
        pairs = crowd.join(led, "h").where((F.col("root") != F.col("leader.root")) & near)
        order = F.struct("leader.rare", "leader.chance", "leader.node", "leader.root").alias("leader")
        pairs = checkpointed(pairs.select(F.col("node").alias("a"), F.col("leader.node").alias("b"), "root", order).distinct())
        led_to = checkpointed(verified(pairs))
        best = checkpointed(led_to.groupBy(F.col("root").alias("a")).agg(F.min("leader").getField("root").alias("b")))
        known = _roots(best, "root", "known")
        rooted = checkpointed(met.join(known, "root", "left").withColumn("root", F.coalesce("known", "root")).drop("known"))
        found = found.union(led_to.select("a", "b"))

    apart = rooted.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    names = ["h", "node", "n", "at", "root"]
    rest = checkpointed(rooted.join(apart.select("h"), "h", "left_semi").select(*names, "met"))
    meets = (F.col("node_a") < F.col("node_b")) & (F.col("root_a") != F.col("root_b"))
    meets &= may_be_first(F.col("n_a"), F.col("at_a"), F.col("n_b"), F.col("at_b"))

    def meeting(rows: DataFrame, more: list[str], meets: Column) -> DataFrame:
        a, b = (rows.select("h", *(F.col(c).alias(f"{c}_{x}") for c in [*names[1:], *more])) for x in "ab")
        return a.join(b, "h").where(meets).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))

    pairs = meeting(rest.where(F.col("met") <= CROWD), [], meets)
    crowd = rest.where(F.col("met") > CROWD)
    if crowd.limit(1).count():
        small_batches(documents.sparkSession)
        w = [f"w{i}" for i in range(PLACES // 64)]
        who = nodes.join(crowd.select("node").distinct(), "node").select("node", "bits")
        bits = who.mapInArrow(_narrowed, "node long, w array<long>").select("node", *(F.col("w")[i].alias(c) for i, c in enumerate(w)))
        pairs = pairs.union(meeting(crowd.join(bits, "node"), w, meets & not_denied()))
    pairs = checkpointed(pairs.distinct())
    return found.union(verified(pairs))


def near_copies(documents: DataFrame, words: int = SHINGLE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, key, node, component_id, keeper_key) per row of ``documents`` (doc_id, text).

    The stage near_duplicates of the pipeline: SimHash fingerprints, their links, and what is at the similarity beside them.
    Rows whose sets of shingles of ``words`` words have a Jaccard similarity of at least ``similarity`` (above 0) are
    linked; ``component_id`` is the smallest doc_id reachable, ``keeper_key`` the text hash of that row. Every such pair
    is found, up to collisions of 64-bit hashes. A text of fewer words is one shingle; null and empty texts are one
    group. Ids may be null or repeated, as in ``simhash.near_duplicates``. An empty table gives no rows.
    """
    level = Fraction(str(similarity))
    marks = checkpointed(_marks(documents, words, level))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    # texts of one set may repeat its shingles unlike; any one fingerprint stands for the set
    same = [F.min("fp").alias("fp"), *(F.first(c).alias(c) for c in ("n", "rare", "under", "bits"))]
    nodes = checkpointed(marks.groupBy("node").agg(F.min(first).alias("first"), *same))
    marks = marks.drop("fp", "n", "rare", "under", "bits")
    return with_keepers(marks, nodes, links(documents, nodes, words, level), "node")


def without_copies(documents: DataFrame, words: int = SHINGLE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``documents`` with one row per group of near copies, as ``simhash.without_copies`` chooses it."""
    return keepers_only(documents, near_copies(documents, words, similarity))
