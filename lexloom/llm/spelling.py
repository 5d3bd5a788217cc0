"""Spelling variants: words one edit apart, found by probing generated edits against Bloom filters.

The vocabulary is cut in shards by word length. A shard's filter is blocked: a word sets a few bits in one block of 512, so
a probe touches one place of memory. The filters are built by Spark in pages of whole blocks and broadcast; how much is
broadcast at once is bounded, and a vocabulary beyond it is probed in several passes, each against some of the pages.

Every word generates its edits as hashes alone: a polynomial hash gives the hash of a word with one character taken out or
replaced without spelling it. Only edits that a filter holds are spelled and shuffled to an equality join with the
vocabulary, which removes false positives. Each near pair is generated once: a deletion by its longer word, a replacement
by the word with the smaller character.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from . import bloom
from .common import chunks, sent, texts_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEAST_LENGTH = 7
LEAST_COUNT = 2
#: A word's form is this many times as frequent.
TIMES = 10
#: One in so many runs loses a character before it is counted.
SLIPS = 31
RUNS = re.compile(rf"[a-zÀ-ÿ]{{{LEAST_LENGTH},}}")

#: Words that a task counts before it gives them on.
COUNTED = 200_000
#: Words of this length or more share a shard, whose filter is sparser, for long words have very many edits.
LONG = 64
LONG_BITS = 64
#: Edits probed at once.
EDITS = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def letter_values(codes: np.ndarray) -> np.ndarray:
    """What a character adds to a hash, before its place counts."""
    return bloom.mixed(codes.astype(np.uint64) + np.uint64(1))


def powers(count: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.full(max(count - 1, 0), _BASE)]).cumprod(dtype=np.uint64)[:count]


def codes_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words in one array, and the words' sizes."""
    return (
        np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32),
        np.array([len(w) for w in words], np.int64),
    )


def word_hashes(words: list[str]) -> np.ndarray:
    """Polynomial hash of each word, modulo 2^64."""
    codes, sizes = codes_of(words)
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(codes)) - np.repeat(starts, sizes)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(letter_values(codes) * powers(int(sizes.max(initial=0)))[place])])
    return total[starts + sizes] - total[starts]


def shard_of(length: int) -> int:
    return min(length, LONG)


def filter_blocks(words: int, shard: int) -> int:
    """Blocks of a shard's filter."""
    return max(bloom.PAGE, bloom.blocks_for(words, LONG_BITS)) if shard == LONG else bloom.blocks_for(words)


def counted_words(documents: DataFrame) -> DataFrame:
    """(word, n): the words of ``documents`` (doc_id, text) with their counts, at least ``LEAST_COUNT``.

    Words are the maximal runs of Latin letters up to U+00FF, A-Z in lower case; one run in ``SLIPS``, chosen by a
    checksum of document and run, loses one character. Runs are counted once per document, then inside the task, then by
    Spark. A null doc_id reads as empty, a null text as no words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def given() -> pa.RecordBatch:
            out = [pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())]
            total.clear()
            return pa.RecordBatch.from_arrays(out, names=["word", "n"])

        for batch in chunks(batches, "text"):
            keys = batch.column("doc_id").to_pylist()
            for key, text in zip(keys, texts_of(batch)):
                start = zlib.crc32(f"{key or ''}:".encode())
                lower = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
                for word, n in Counter(RUNS.findall(lower)).items():
                    check = zlib.crc32(word.encode(), start)
                    if not check % SLIPS:
                        at = check % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < LEAST_LENGTH:
                            continue
                    total[word] += n
                if len(total) > COUNTED:
                    yield given()
        yield given()

    rows = documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    found = rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return found.where(F.col("n") >= LEAST_COUNT)


def _passes(sizes: dict[tuple[int, int], int]) -> list[list[tuple[int, int]]]:
    """Pages in groups of at most ``bloom.BROADCAST_BYTES`` together."""
    groups, room = [], 0
    for page, size in sorted(sizes.items()):
        if not groups or size > room:
            groups.append([])
            room = bloom.BROADCAST_BYTES
        groups[-1].append(page)
        room -= size
    return groups


def edits(words: list[str], alphabet: np.ndarray, filters: bloom.Filters) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(word, place, letter) of the edits that the filters may hold; letter 0 takes the character out."""
    codes, sizes = codes_of(words)
    starts = np.cumsum(sizes) - sizes
    values, added = letter_values(codes), letter_values(alphabet)
    owner = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(codes)) - starts[owner]
    power = powers(int(sizes.max(initial=0)))
    terms = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * power[place])])
    whole = terms[starts + sizes] - terms[starts]
    shards = np.minimum(sizes, LONG)
    shorter = np.minimum(sizes - 1, LONG)
    # taking out any of equal neighbours gives one word
    anew = np.append(True, codes[1:] != codes[:-1]) | (place == 0)
    at = np.arange(len(codes))
    out = whole[owner] - values * power[place]
    behind = terms[(starts + sizes)[owner]] - terms[at + 1]
    taken = (out - behind) + behind * _BACK
    for shard in np.unique(shorter).tolist():
        mine = np.flatnonzero(anew & (shorter[owner] == shard))
        hit = mine[filters.holds(shard, taken[mine])]
        yield owner[hit], place[hit], np.zeros(len(hit), np.int64)
    step = max(1, EDITS // max(len(alphabet), 1))
    for shard in np.unique(shards).tolist():
        mine = at[shards[owner] == shard]
        for low in range(0, len(mine), step):
            part = mine[low : low + step]
            row, letter = np.nonzero(alphabet[None, :] > codes[part][:, None])
            spot = part[row]
            hashes = out[spot] + added[letter] * power[place[spot]]
            hit = filters.holds(shard, hashes)
            yield owner[spot[hit]], place[spot[hit]], alphabet[letter[hit]].astype(np.int64)


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): pairs of words of ``words`` (word, n, each word once) that are exactly one edit apart, once each.

    ``words`` is read several times; pass a table or a checkpoint. Null and empty words take no part.
    """
    spark = words.sparkSession
    words = words.where(F.length("word") > 0).select("word", F.col("n").cast("long").alias("n"))
    length = F.least(F.length("word"), F.lit(LONG))
    sizes = {r["shard"]: r["count"] for r in words.groupBy(length.alias("shard")).count().collect()}
    blocks = {s: filter_blocks(n, s) for s, n in sizes.items()}
    letters = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).distinct()
    alphabet = np.array(sorted(ord(r["c"]) for r in letters.collect() if r["c"]), np.uint32)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("word").to_pylist()
            shard = pa.array([shard_of(len(t)) for t in texts], pa.int32())
            yield pa.RecordBatch.from_arrays([shard, pa.array(word_hashes(texts).view(np.int64))], names=["shard", "hash"])

    pages = checkpointed(bloom.pages(words.select("word").mapInArrow(hashed, "shard int, hash long"), blocks))
    held = {(r["shard"], r["page"]): r["size"] for r in pages.select("shard", "page", F.length("data").alias("size")).collect()}
    found = None
    for group in _passes(held):
        asked = F.struct("shard", "page").isin([F.struct(F.lit(s), F.lit(p)) for s, p in group]) if len(group) < len(held) else F.lit(True)
        bytes_ = {(r["shard"], r["page"]): bytes(r["data"]) for r in pages.where(asked).collect()}
        hits = words.mapInArrow(_probe(sent(spark, (alphabet, bloom.Filters(blocks, bytes_)))), "edit string, a string, n_a long")
        found = hits if found is None else found.union(hits)
    if found is None:
        return words.where("false").select(F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("word").alias("b"), F.col("n").alias("n_b"))
    known = words.select(F.col("word").alias("b"), F.col("n").alias("n_b"))
    return found.join(known, F.col("edit") == F.col("b")).select("a", "n_a", "b", "n_b")


def _probe(told):
    """The pass of one broadcast over the vocabulary: edits that the filters may hold, spelled, with their word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alphabet, filters = told()
        for batch in chunks(batches, "word", EDITS // 8):
            words, counts = batch.column("word").to_pylist(), batch.column("n").to_numpy()
            for who, place, letter in edits(words, alphabet, filters):
                spelled = [
                    words[w][:p] + (chr(x) if x else "") + words[w][p + 1 :]
                    for w, p, x in zip(who.tolist(), place.tolist(), letter.tolist())
                ]
                out = [pa.array(spelled, pa.string()), pa.array([words[w] for w in who.tolist()], pa.string()), pa.array(counts[who])]
                yield pa.RecordBatch.from_arrays(out, names=["edit", "a", "n_a"])

    return run


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms`` (word, form), each word once: forms followed to the last, without a circle.

    Each round doubles how far a word sees, so the rounds grow with the logarithm of the longest chain.
    """
    seen = checkpointed(forms.select("word", F.col("form").alias("root")))
    while True:
        on = seen.select(F.col("word").alias("root"), F.col("root").alias("further"))
        further = checkpointed(seen.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), "further"))
        if not further.where(F.col("further").isNotNull()).limit(1).count():
            return seen
        seen = further.select("word", "root")


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) per row of ``words`` (word, n, each word once).

    A word's near words differ from it by exactly one inserted, deleted or replaced code point. Its form is the near word
    of largest n (ties: smallest by code points) if that is at least ``times`` its own n; else null. Its root is where
    its forms end, the word itself without one: n grows along forms, so there is no circle. Words without near words come
    back with n_near 0. A group around one word has at most as many members as there are edits of it, so no join key grows
    with the corpus. An empty table gives no rows.
    """
    words = checkpointed(words.select("word", F.col("n").cast("long").alias("n")))
    pairs = checkpointed(near_pairs(words))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")).union(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n"))
    )
    best = both.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    )
    enough = -F.col("best.less") >= F.col("n") * times
    formed = checkpointed(
        words.join(best, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(enough, F.col("best.near")).alias("form"),
            F.when(enough, -F.col("best.less")).alias("form_n"),
        )
    )
    rooted = roots(formed.where(F.col("form").isNotNull()).select("word", "form"))
    return formed.join(rooted, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def spelling_variants(documents: DataFrame) -> DataFrame:
    """``variants`` of the counted words of ``documents`` (doc_id, text); other columns are ignored.

    Null texts have no words, repeated rows count each. A table without words gives no rows.
    """
    return variants(counted_words(documents))
