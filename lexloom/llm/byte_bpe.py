"""Byte-level BPE encoding and decoding by length-bucketed matrices.

The distinct new pre-tokens of a chunk of texts are laid out by length, one padded row of token ids each. Every round
each row merges its leftmost pair of minimum rank: the pair's place is one argmin over a matrix of ranks, the merged row
loses one column, and only the two pairs beside the merge are looked up again, in a hashed table of all pairs that form a
token. Rows without a pair left leave the matrix. A token's id is its rank.

A pre-token too long for a matrix is merged alone: pairs of one rank are merged from left to right in one round, up to the
first merge that brings a pair of lower rank, so the order of merges is that of the rows.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from .common import over_texts, sent, texts_of, with_columns

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of the longest row of a matrix, and cells of one matrix.
ROW_BYTES = 512
CELLS = 1 << 20
#: Characters of pre-tokens that a task keeps the ids of, and pre-tokens of a long text handled at once.
KEPT_CHARS = 6_000_000
WORDS_AT_ONCE = 200_000
#: Rank of a pair that forms no token.
NONE = np.iinfo(np.int32).max
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Vocabulary:
    """Tokens by rank, the ids of single bytes, and the hashed table of pairs: left << 32 | right to rank."""

    tokens: list[bytes]
    bytes_: np.ndarray
    keys: np.ndarray
    values: np.ndarray

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where it forms no token or a side is padding (below 0)."""
        asked = (left.astype(np.int64) << 32) | right.astype(np.int64)
        slot = _slots(asked, len(self.keys))
        held = self.keys[slot]
        out = np.where(held == asked, self.values[slot], NONE)
        out[(left < 0) | (right < 0)] = NONE
        open_ = np.flatnonzero((held != asked) & (held >= 0) & (left >= 0) & (right >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            held = self.keys[slot[open_]]
            hit = held == asked[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (held >= 0)]
        return out


def _slots(keys: np.ndarray, size: int) -> np.ndarray:
    return ((keys.astype(np.uint64) * _SPREAD) >> np.uint64(65 - size.bit_length())).astype(np.int64)


def load_vocabulary(path: str) -> Vocabulary:
    """A rank file (base64 token, rank per line). Ranks may leave gaps; every single byte must have one."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    tokens = [b""] * (max(ranks.values()) + 1)
    pairs = {}
    for token, rank in ranks.items():
        tokens[rank] = token
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                pairs[left << 32 | right] = rank
    size = 1 << max(4, (4 * len(pairs)).bit_length())
    keys, values = np.full(size, -1, np.int64), np.full(size, NONE, np.int32)
    new, rank = np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int32)
    slot = _slots(new, size)
    while len(new):
        # one key per free slot settles, the rest moves on
        free = keys[slot] < 0
        _, first = np.unique(np.where(free, slot, -1), return_index=True)
        first = first[free[first]]
        keys[slot[first]], values[slot[first]] = new[first], rank[first]
        rest = np.ones(len(new), bool)
        rest[first] = False
        new, rank, slot = new[rest], rank[rest], (slot[rest] + 1) & (size - 1)
    return Vocabulary(tokens, np.array([ranks[bytes([b])] for b in range(256)], np.int32), keys, values)


class Encoder:
    """Encodes pre-tokens; made once per task."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary = vocabulary
        self.pattern = regex.compile(pattern)
        self.whole = {token: rank for rank, token in enumerate(vocabulary.tokens) if token}
        self.words: dict[str, bytes] = {}
        self.kept = 0

    def merged(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each of the words, none empty: one id if the word is a token, else what the merges leave."""
        out: list[np.ndarray | None] = [None] * len(words)
        buckets = defaultdict(list)
        for at, word in enumerate(words):
            rank = self.whole.get(word)
            if rank is not None:
                out[at] = np.array([rank], np.int32)
            elif len(word) > ROW_BYTES:
                out[at] = self.merge_long(self.vocabulary.bytes_[np.frombuffer(word, np.uint8)])
            else:
                buckets[(len(word) - 1).bit_length()].append(at)
        for bits, rows in buckets.items():
            width = 1 << bits
            step = max(1, CELLS // width)
            for low in range(0, len(rows), step):
                self.merge_rows(rows[low : low + step], words, width, out)
        return out

    def merge_rows(self, rows: list[int], words: list[bytes], width: int, out: list) -> None:
        """Merge the words of one bucket; the ids go to ``out`` at their places."""
        data = b"".join(words[r].ljust(width, b"\0") for r in rows)
        ids = self.vocabulary.bytes_[np.frombuffer(data, np.uint8)].reshape(len(rows), width)
        sizes = np.array([len(words[r]) for r in rows])
        ids[np.arange(width) >= sizes[:, None]] = -1
        places = np.array(rows)
        look = self.vocabulary.ranks
        ranks = look(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(rows), width - 1)
        while len(places):
            at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(places), np.int64)
            every = np.arange(len(places))
            best = ranks[every, at] if ranks.shape[1] else np.full(len(places), NONE)
            ended = best == NONE
            if ended.any():
                for place, row, size in zip(places[ended].tolist(), ids[ended], sizes[ended].tolist()):
                    out[place] = row[:size]
                kept = ~ended
                places, ids, ranks, sizes, at, best = (x[kept] for x in (places, ids, ranks, sizes, at, best))
                if not len(places):
                    return
                every = np.arange(len(places))
            n, width = ids.shape
            ids[every, at] = best
            left = np.ones(ids.shape, bool)
            left[every, at + 1] = False
            ids = ids[left].reshape(n, width - 1)
            left = np.ones(ranks.shape, bool)
            left[every, at] = False
            ranks = ranks[left].reshape(n, width - 2)
            sizes = sizes - 1
            before = np.flatnonzero(at > 0)
            ranks[before, at[before] - 1] = look(ids[before, at[before] - 1], best[before])
            after = np.flatnonzero(at < width - 2)
            ranks[after, at[after]] = look(best[after], ids[after, at[after] + 1])

    def merge_long(self, ids: np.ndarray) -> np.ndarray:
        """Merge one long row: places linked to their neighbours, and listed under the rank of the pair they start."""
        size, look = len(ids), self.vocabulary.ranks
        # one place more at the end, padding, so that every place has a next and (by -1) a previous one
        ids = np.append(ids, np.int32(-1))
        after = np.minimum(np.arange(1, size + 2), size)
        before = np.append(np.arange(-1, size - 1), size - 1)
        ranks = np.append(look(ids[:-1], ids[1:]), np.int32(NONE))
        waiting: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def listed(places: np.ndarray) -> None:
            of = ranks[places]
            places, of = places[of < NONE], of[of < NONE]
            order = np.argsort(of, kind="stable")
            places, of = places[order], of[order]
            cuts = np.flatnonzero(np.diff(of)) + 1
            for rank, part in zip(of[np.append(0, cuts)].tolist() if len(of) else [], np.split(places, cuts)):
                if rank not in waiting:
                    waiting[rank] = []
                    heapq.heappush(queue, rank)
                waiting[rank].append(part)

        listed(np.arange(size))
        while queue:
            rank = heapq.heappop(queue)
            places = np.unique(np.concatenate(waiting.pop(rank)))
            places = places[ranks[places] == rank]
            if not len(places):
                continue
            # of pairs that overlap, every other one from the left
            run = np.append(True, after[places[:-1]] != places[1:])
            number = np.arange(len(places))
            chosen = places[(number - np.maximum.accumulate(np.where(run, number, 0))) % 2 == 0]
            gone = after[chosen]
            beyond = after[gone]
            previous = before[chosen]
            beside = np.append(False, beyond[:-1] == chosen[1:])
            token = np.full(len(chosen), rank, np.int32)
            low = np.minimum(look(np.where(beside, rank, ids[previous]), token), look(token, ids[beyond])) < rank
            low[(previous < 0) & ~beside] = look(token, ids[beyond])[(previous < 0) & ~beside] < rank
            if low.any():
                stop = int(low.argmax()) + 1
                again = places[places >= chosen[stop]] if stop < len(chosen) else places[:0]
                chosen, gone, beyond = chosen[:stop], gone[:stop], beyond[:stop]
            else:
                again = places[:0]
            ids[chosen] = rank
            ids[gone], ranks[gone] = -2, NONE
            after[chosen], before[beyond] = beyond, chosen
            previous = before[chosen]
            touched = np.unique(np.concatenate([previous[previous >= 0], chosen]))
            ranks[touched] = look(ids[touched], ids[after[touched]])
            listed(np.concatenate([touched, again]))
        return ids[:size][ids[:size] >= 0]

    def learn(self, words: list[str]) -> None:
        """Keep the ids of pre-tokens not seen yet, as decimal numbers joined by blanks."""
        new = list(set(words).difference(self.words))
        self.kept += sum(map(len, new))
        for word, ids in zip(new, self.merged([w.encode("utf-8") for w in new])):
            self.words[word] = " ".join(map(str, ids.tolist())).encode()

    def blocks(self, text: str) -> Iterator[list[str]]:
        """Pre-tokens of a text, in blocks; they are all matches of the pattern, in order."""
        if len(text) <= 4 * WORDS_AT_ONCE:
            yield self.pattern.findall(text)
            return
        found = (m.group() for m in self.pattern.finditer(text))
        while block := list(islice(found, WORDS_AT_ONCE)):
            yield block

    def encoded(self, texts: list[str]) -> Iterator[Iterator[list[bytes]]]:
        """Per text, blocks of the ids of its pre-tokens in order; each block is to be used before the next is asked."""
        if self.kept > KEPT_CHARS:
            self.words, self.kept = {}, 0
        short = {i: next(self.blocks(t)) for i, t in enumerate(texts) if len(t) <= 4 * WORDS_AT_ONCE}
        self.learn(list(set(chain.from_iterable(short.values()))))
        for i, text in enumerate(texts):
            yield self._ids([short[i]] if i in short else self.blocks(text), i not in short)

    def _ids(self, blocks, unknown: bool) -> Iterator[list[bytes]]:
        for block in blocks:
            if unknown:
                if self.kept > KEPT_CHARS:
                    self.words, self.kept = {}, 0
                self.learn(block)
            yield [self.words[w] for w in block]


class Decoder:
    """Decodes ids; made once per task."""

    def __init__(self, vocabulary: Vocabulary):
        self.tokens = vocabulary.tokens
        self.known: dict[bytes, bytes] = {}
        self.kept = 0

    def data(self, ids: list[int]) -> bytes:
        """The bytes that ids stand for."""
        return b"".join(map(self.tokens.__getitem__, ids))

    def spelled(self, word: bytes) -> bytes:
        """The bytes of decimal ids joined by blanks, kept for words met again."""
        found = self.known.get(word)
        if found is None:
            if self.kept > 4 * KEPT_CHARS:
                self.known, self.kept = {}, 0
            found = self.known[word] = self.data(list(map(int, word.split())))
            self.kept += len(word)
        return found


def encode(documents: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(doc_id, ids) per row of ``documents`` (doc_id, text): ids as array<int>; null and empty texts have none."""
    told = sent(documents.sparkSession, load_vocabulary(ranks))

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        encoder = Encoder(told(), pattern)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = [
                np.array(b" ".join(chain.from_iterable(blocks)).split(), np.int32)
                for blocks in encoder.encoded(texts_of(batch))
            ]
            offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.int32), *ids])
            return with_columns(batch, ["doc_id"], ids=pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)))

        return work

    kind = documents.schema["doc_id"].dataType.simpleString()
    return over_texts(documents.select("doc_id", "text"), "text", make, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """(doc_id, data) per row of ``encoded`` (doc_id, ids): the bytes; null ids and null entries stand for none."""
    told = sent(encoded.sparkSession, load_vocabulary(ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(told())
        for batch in batches:
            lists = batch.column("ids").to_pylist()
            data = [decoder.data([i for i in x or [] if i is not None]) for x in lists]
            yield with_columns(batch, ["doc_id"], data=pa.array(data, pa.binary()))

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, data binary")


def digests(documents: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) per row of ``documents`` (doc_id, text).

    ``ids_sha256`` is of the decimal ids joined by one blank, ``decoded_sha256`` of the bytes the ids decode to; both
    lowercase hex. Encoding and decoding meet in one pass, so that ids of whole texts are not moved. Null and empty texts
    have no ids. Repeated rows each come back; doc_id may be null; other columns are ignored; an empty table gives none.
    Long texts pass in blocks of pre-tokens, and one very long pre-token takes memory in proportion to its bytes.
    """
    told = sent(documents.sparkSession, load_vocabulary(ranks))

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        vocabulary = told()
        encoder, decoder = Encoder(vocabulary, pattern), Decoder(vocabulary)

        def digest(blocks: Iterator[list[bytes]]) -> tuple[int, str, str]:
            count, ids, data = 0, hashlib.sha256(), hashlib.sha256()
            for block in blocks:
                joined = b" ".join(block)
                if joined:
                    ids.update(b" " + joined if count else joined)
                    count += joined.count(b" ") + 1
                    data.update(b"".join(map(decoder.spelled, block)))
            return count, ids.hexdigest(), data.hexdigest()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [digest(blocks) for blocks in encoder.encoded(texts_of(batch))]
            columns = zip(*found) if found else ([], [], [])
            kinds = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
            return with_columns(batch, ["doc_id"], **{k: pa.array(c, t) for (k, t), c in zip(kinds.items(), columns)})

        return work

    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return over_texts(documents.select("doc_id", "text"), "text", make, schema)
