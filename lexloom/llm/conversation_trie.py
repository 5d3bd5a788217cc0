"""Prefix trie of conversations, by collapsing whole sequences first.

A conversation's turns are hashed with their place, and the exclusive or of these hashes stands for the sequence: whole
sequences need no order, prefixes are running values. Identical conversations become one sequence with a weight, its
smallest id and a list of the conversations that end there. Only one conversation per distinct sequence is unrolled into
prefixes. Sequences that are proper prefixes of others are dropped by an anti-join; what is left are the leaves. The
weighted prefixes are then summed up per node.

Every step is a join or an aggregation of narrow rows, one per turn, so that a conversation, a first turn or a sequence
that holds a third of all rows is spread over many tasks: running values go through range blocks, sums are combined before
they move, lists of ids are joined up in runs.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scan import number_rows, running
from ..session import checkpointed

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Conversations that share first turns, and the most turns they share.
BASE = 100
SHARED = 6
#: Ids joined up before they move.
RUN_IDS = 4096
NODE = ["depth", "x1", "x2"]


def shared_turns(conv_id: Column) -> Column:
    """How many first turns a conversation takes from its base: crc32 of its decimal id, modulo ``SHARED``."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % SHARED).cast("int")


def marked_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, mark, chars): turns in order from 1, with a hash of role and text and the text's code points.

    Turns are ordered by ``turn``, null first; equal turns by the hash. Null role and text are empty. Rows without a
    conv_id belong to no conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    mark = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", mark.alias("mark"), F.char_length(text).cast("long").alias("chars")
    )
    return number_rows(rows, ["conv_id"], "turn", "at", ties=["mark", "chars"]).select("conv_id", "at", "mark", "chars")


def _hashes(depth: Column, mark: Column) -> list[Column]:
    return [F.xxhash64(F.lit(seed), mark, depth.cast("long")).alias(f"h{seed}") for seed in (1, 2)]


def rebuilt(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """(conv_id, depth, h1, h2, chars): the turns of every rebuilt conversation of ``ids`` (conv_id, base, shared).

    A conversation is the first ``shared`` turns of its base, then its own turns after as many.
    """
    openings = checkpointed(
        turns.where((F.col("conv_id") % BASE == 0) & (F.col("at") < SHARED)).withColumnRenamed("conv_id", "base")
    )
    taken = ids.join(openings, "base").where(F.col("at") <= F.col("shared"))
    first = taken.select("conv_id", F.col("at").alias("depth"), "mark", "chars")
    held = openings.groupBy("base").agg(F.count("*").alias("held"))
    own = turns.select("*", (F.col("conv_id") - F.col("conv_id") % BASE).alias("base"), shared_turns(F.col("conv_id")).alias("shared"))
    own = own.where(F.col("at") > F.col("shared")).join(held, "base", "left")
    depth = F.col("at") - F.col("shared") + F.least("shared", F.coalesce("held", F.lit(0)))
    rest = own.select("conv_id", depth.alias("depth"), "mark", "chars")
    both = first.union(rest).withColumn("depth", F.col("depth").cast("long"))
    return both.select("conv_id", "depth", *_hashes(F.col("depth"), F.col("mark")), "chars")


def ends(whole: DataFrame) -> DataFrame:
    """(depth, x1, x2, ends_sha256) of every node that a conversation of ``whole`` (conv_id, depth, x1, x2) ends at.

    Ids are ranged by node and id, joined up in runs inside the ranges, and the runs of a node streamed through one hash,
    in order: a node's list is never held as a whole.
    """

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, held = None, []

        def given() -> pa.RecordBatch:
            row = {"depth": node[0], "x1": node[1], "x2": node[2], "first": held[0], "ids": ",".join(map(str, held))}
            return pa.RecordBatch.from_pylist([row], schema)

        schema = pa.schema([(c, pa.int64()) for c in (*NODE, "first")] + [("ids", pa.string())])
        for batch in batches:
            rows = (batch.column(c).to_pylist() for c in (*NODE, "conv_id"))
            for depth, x1, x2, conv in zip(*rows):
                if held and (node != (depth, x1, x2) or len(held) == RUN_IDS):
                    yield given()
                    held = []
                node = (depth, x1, x2)
                held.append(conv)
        if held:
            yield given()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None

        def given(found: list) -> pa.RecordBatch:
            columns = zip(*found) if found else [[]] * 4
            return pa.RecordBatch.from_arrays(
                [pa.array(c, pa.string() if n == "ends_sha256" else pa.int64()) for n, c in zip([*NODE, "ends_sha256"], columns)],
                names=[*NODE, "ends_sha256"],
            )

        for batch in batches:
            done = []
            for depth, x1, x2, ids in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids"))):
                if node == (depth, x1, x2):
                    digest.update(b"," + ids.encode())
                    continue
                if node is not None:
                    done.append((*node, digest.hexdigest()))
                node, digest = (depth, x1, x2), hashlib.sha256(ids.encode())
            yield given(done)
        yield given([(*node, digest.hexdigest())] if node is not None else [])

    order = [*NODE, "conv_id"]
    ranged = whole.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    joined = ranged.mapInArrow(runs, "depth long, x1 long, x2 long, first long, ids string")
    streamed = joined.repartition(*NODE).sortWithinPartitions(*NODE, "first")
    return streamed.mapInArrow(hashed, "depth long, x1 long, x2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) per distinct prefix.

    ``conversations`` (conv_id, turn, role, text) are rebuilt by ``rebuilt``; each distinct sequence of first d turns is a
    node, from the empty one, the root, that all share. A node has its smallest member (also its parent's), its members,
    children and leaves below; the code points saved by sharing, summed over its subtree; and the SHA-256 of the ids that
    end there, ascending and joined by commas. Prefixes are told apart by 128 bits.

    Null turns come first, ties are ordered by a hash of role and text, null role and text are empty, rows repeated as
    they are count as turns. Rows without a conv_id are left out. Other columns are ignored. A conversation whose turns
    are all taken away is a member of the root alone. An empty table gives no rows.
    """
    turns = checkpointed(marked_turns(conversations))
    key = F.col("conv_id")
    ids = checkpointed(
        turns.select("conv_id").distinct().select(key, (key - key % BASE).alias("base"), shared_turns(key).alias("shared"))
    )
    rows = checkpointed(rebuilt(turns, ids))

    # whole sequences
    zero = F.lit(0).cast("long")
    sums = rows.groupBy("conv_id").agg(
        F.count("*").alias("depth"), F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"), F.sum("chars").alias("total")
    )
    filled = [F.coalesce(c, zero).alias(c) for c in (*NODE, "total")]
    whole = checkpointed(ids.select("conv_id").join(sums, "conv_id", "left").select("conv_id", *filled))
    sequences = checkpointed(
        whole.groupBy(*NODE).agg(F.count("*").alias("weight"), F.min("conv_id").alias("seq"), F.first("total").alias("total"))
    )

    # prefixes of distinct sequences
    unrolled = rows.join(sequences.select(F.col("seq").alias("conv_id")), "conv_id").withColumnRenamed("conv_id", "seq")
    paths = running(
        unrolled,
        ["seq"],
        "depth",
        {"x1": ("xor", F.col("h1")), "x2": ("xor", F.col("h2")), "upto": ("sum", F.col("chars"))},
    )
    above = [
        (F.col("depth") - 1).alias("p_depth"),
        F.col("x1").bitwiseXOR(F.col("h1")).alias("p_x1"),
        F.col("x2").bitwiseXOR(F.col("h2")).alias("p_x2"),
    ]
    before = (F.col("upto") - F.col("chars")).alias("before")
    paths = checkpointed(paths.select("seq", *NODE, *above, before))
    parent_keys = [F.col(f"p_{c}").alias(c) for c in NODE]

    # leaves: sequences that are no proper prefix
    proper = paths.select(*parent_keys).distinct()
    leaves = sequences.join(proper, NODE, "left_anti").select("seq", F.lit(1).cast("long").alias("leaf"))
    weighed = sequences.select("seq", "weight", "total").join(leaves, "seq", "left")
    weighed = checkpointed(weighed.withColumn("leaf", F.coalesce("leaf", zero)))
    root = [zero.alias(c) for c in NODE] + [F.lit(None).cast("long").alias(f"p_{c}") for c in NODE]
    unrolled = paths.join(weighed, "seq").select("seq", *NODE, *(f"p_{c}" for c in NODE), "before", "weight", "total", "leaf")
    unrolled = unrolled.union(weighed.select("seq", *root, zero.alias("before"), "weight", "total", "leaf"))
    unrolled = checkpointed(unrolled)

    # the turns from here on, of all members
    later = F.col("weight") * (F.col("total") - F.col("before"))
    nodes = checkpointed(
        unrolled.groupBy(*NODE).agg(
            F.min("seq").alias("conv_id"),
            F.sum("weight").alias("n_convs"),
            F.sum("leaf").alias("n_leaves"),
            F.sum(later).alias("spent"),
            *(F.min(f"p_{c}").alias(f"p_{c}") for c in NODE),
            F.min("before").alias("before"),
        )
    )
    # a node counts once: with the smallest sequence through it, whose nodes from ``since`` on are its own
    since = nodes.groupBy(F.col("conv_id").alias("seq")).agg(F.min("before").alias("since"))
    own = unrolled.join(since, "seq").select(*NODE, (F.col("total") - F.greatest("before", "since")).alias("kept"))
    none = F.lit(None).cast("long")
    facts = (
        nodes.select(*NODE, "conv_id", "n_convs", "n_leaves", "spent", *(f"p_{c}" for c in NODE), zero.alias("kept"), zero.alias("n_children"), F.lit(None).cast("string").alias("ends_sha256"))
        .union(own.groupBy(*NODE).agg(F.sum("kept").alias("kept")).select(*NODE, *[none] * 7, "kept", none, none.cast("string")))
        .union(nodes.where("depth > 0").groupBy(*parent_keys).count().select(*NODE, *[none] * 8, "count", none.cast("string")))
        .union(ends(whole).select(*NODE, *[none] * 9, "ends_sha256"))
    )
    joined = checkpointed(
        facts.groupBy(*NODE).agg(
            *(F.max(c).alias(c) for c in ("conv_id", "n_convs", "n_leaves", "spent", "p_depth", "p_x1", "p_x2")),
            F.sum("kept").alias("kept"),
            F.sum("n_children").alias("n_children"),
            F.max("ends_sha256").alias("ends_sha256"),
        )
    )
    parents = joined.select(*(F.col(c).alias(f"p_{c}") for c in NODE), F.col("conv_id").alias("parent_conv_id"))
    return joined.join(parents, [f"p_{c}" for c in NODE], "left").select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        (F.col("spent") - F.col("kept")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
