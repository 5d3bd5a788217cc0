"""SentencePiece encoding and decoding by suffix-array matching.

The texts of a batch are cut in pre-tokens that no piece spans, and the distinct new ones are concatenated. A suffix
array of that text, sorted as far as the longest piece reaches, gives every piece's occurrences as one range found by two
binary searches. Each occurrence is an edge of the lattice; edges are sorted by where they start, and relaxed place by
place, for all pre-tokens at once: best[end] = max(best[start] + score). The best path of a pre-token is its ids. A
character that no piece holds becomes its bytes. Decoding joins the bytes of the pieces.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from .common import over_texts, texts_of, with_columns
from .pieces import BYTE_SCORE, SPACE, Pieces, load_pieces, pretoken_pattern, pretokens

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Pre-tokens a task keeps the ids of; characters indexed at once.
WORDS_KEPT = 400_000
INDEX_CHARS = 400_000
#: Characters of the longest pre-token that is relaxed together with others, place by place.
TOGETHER_CHARS = 8192
#: Between pre-tokens in the indexed text. Characters are their code points plus one, so that no text holds it.
GAP = 0


def codes_of(text: str) -> np.ndarray:
    """Code points plus one."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) + np.uint32(1)


def windows(codes: np.ndarray, depth: int) -> np.ndarray:
    """The next ``depth`` codes from each place on, as big-endian bytes, followed by zeros at the end."""
    padded = np.concatenate([codes, np.zeros(depth, codes.dtype)])
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, depth)[: len(codes)])


def suffix_array(rows: np.ndarray) -> np.ndarray:
    """Starts of all suffixes, sorted by the bytes of ``windows``: eight at a time, the last ones first."""
    data = rows.view(np.uint8).reshape(len(rows), -1)
    data = np.pad(data, ((0, 0), (0, -data.shape[1] % 8)))
    keys = data.view(">u8").astype(np.uint64)
    return np.lexsort(keys.T[::-1])


class Encoder:
    """Encodes texts; made once per task."""

    def __init__(self, pieces: Pieces):
        self.pattern = pretoken_pattern(pieces)
        self.longest = pieces.longest
        self.bytes_ = np.array(pieces.bytes_, np.int64)
        ordered = sorted(pieces.ids)  # by code points, as suffixes are
        self.ids = np.array([pieces.ids[p] for p in ordered], np.int64)
        self.scores = np.array([pieces.scores[p] for p in ordered])
        self.sizes = np.array([len(p) for p in ordered], np.int64)
        self.codes = np.zeros((len(ordered), self.longest), np.uint32)
        for row, p in zip(self.codes, ordered):
            row[: len(p)] = codes_of(p)
        self.inside = np.arange(self.longest) < self.sizes[:, None]
        self.words: dict[str, bytes] = {}

    def occurrences(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, piece) of every occurrence of a piece in a text of ``codes_of``.

        Code points are renumbered by the text's alphabet, GAP first; pieces with others do not occur. Suffixes and
        pieces are compared as bytes, so that one binary search runs over all pieces.
        """
        alphabet = np.unique(np.append(text, GAP))
        kind = ">u1" if len(alphabet) < 0xFF else ">u2" if len(alphabet) < 0xFFFF else ">u4"
        place = np.searchsorted(alphabet, self.codes)
        known = alphabet[np.minimum(place, len(alphabet) - 1)] == self.codes
        spelled = np.flatnonzero((known | ~self.inside).all(axis=1))
        rows = windows(np.searchsorted(alphabet, text).astype(kind), self.longest)
        order = suffix_array(rows)
        as_text = lambda x: np.ascontiguousarray(x).view(f"S{x.itemsize * self.longest}").ravel()
        keys = as_text(rows[order])
        codes, inside = place[spelled].astype(kind), self.inside[spelled]
        low = np.searchsorted(keys, as_text(np.where(inside, codes, 0).astype(kind)), "left")
        high = np.searchsorted(keys, as_text(np.where(inside, codes, np.iinfo(kind).max).astype(kind)), "right")
        counts = high - low
        piece = np.repeat(spelled, counts)
        at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(low, counts)
        return order[at], piece

    def lattice(self, words: list[str]) -> None:
        """Encode new pre-tokens and keep their ids."""
        spelled = [w.replace(" ", SPACE) for w in words]
        text = codes_of(" ".join(spelled) + " ")
        sizes = np.array([len(w) for w in spelled])
        first = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        text[first + sizes] = GAP
        start, piece = self.occurrences(text)
        # a byte edge over every character that no piece of one character covers
        single = np.zeros(len(text), bool)
        single[start[self.sizes[piece] == 1]] = True
        odd = np.flatnonzero(~single & (text != GAP))
        point = text[odd] - 1
        cost = 1 + (point > 0x7F) + (point > 0x7FF) + (point > 0xFFFF).astype(np.int64)
        start = np.concatenate([start, odd])
        size = np.concatenate([self.sizes[piece], np.ones(len(odd), np.int64)])
        score = np.concatenate([self.scores[piece], BYTE_SCORE * cost])
        edge = np.concatenate([piece, np.full(len(odd), -1)])
        used = np.concatenate([np.ones(len(piece), np.int64), cost])
        # edges by the place of their end inside the pre-token, then by end: all pre-tokens advance together
        owner = np.repeat(np.arange(len(words)), sizes + 1)[start]
        end = start + size
        by_end = np.argsort(end, kind="stable")
        step = (end - first[owner])[by_end]
        if sizes.max() < 1 << 15:
            step = step.astype(np.int16)
        sorted_ = by_end[np.argsort(step, kind="stable")]
        start, end, score, edge, used, step = (
            x[sorted_] for x in (start, end, score, edge, used, end - first[owner])
        )
        best = np.full(len(text) + 1, -np.inf)
        count = np.zeros(len(text) + 1, np.int64)
        back = np.full(len(text) + 1, -1)
        best[first] = 0.0
        cuts = np.flatnonzero(np.diff(step, prepend=-1))
        for low, high in zip(cuts, np.append(cuts[1:], len(step))):
            source = start[low:high]
            total = best[source] + score[low:high]
            pieces_used = count[source] + used[low:high]
            heads = np.flatnonzero(np.diff(end[low:high], prepend=-1))
            group = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, high - low)))
            # best first; fewer pieces among equals, then the longer last piece
            top = np.maximum.reduceat(total, heads)
            pieces_used[total < top[group]] = np.iinfo(np.int64).max  # bytes may outnumber characters
            fewest = np.minimum.reduceat(pieces_used, heads)
            source = np.where(pieces_used == fewest[group], source, len(text))
            earliest = np.minimum.reduceat(source, heads)
            chosen = np.flatnonzero(source == earliest[group])
            chosen = chosen[np.diff(group[chosen], prepend=-1) > 0]
            to = end[low + heads]
            best[to], count[to], back[to] = top, fewest, chosen + low
        self.keep(words, spelled, first, sizes, start, edge, back)

    def keep(self, words, spelled, first, sizes, start, edge, back) -> None:
        """Walk the best paths back, all pre-tokens at once."""
        at, active = first + sizes, np.arange(len(words))
        found: list[list[np.ndarray]] = [[], [], []]
        depth = 0
        while len(active):
            active = active[at[active] > first[active]]
            if not len(active):
                break
            taken = back[at[active]]
            found[0].append(active)
            found[1].append(edge[taken])
            found[2].append(start[taken])
            at[active] = start[taken]
            depth += 1
        if not found[0]:
            self.words.update((w, b"") for w in words)
            return
        owner, piece, begin = (np.concatenate(x) for x in found)
        order = np.lexsort((begin, owner))
        owner, piece, begin = owner[order], piece[order], begin[order]
        ids = np.where(piece >= 0, self.ids[piece], -1)
        if (ids < 0).any():
            owner, ids = self.as_bytes(owner, ids, begin - first[owner], spelled)
        data = ids.astype("<u4").tobytes()
        ends = np.searchsorted(owner, np.arange(len(words)), "right") * 4
        starts = np.concatenate([[0], ends[:-1]])
        self.words.update(zip(words, map(data.__getitem__, map(slice, starts.tolist(), ends.tolist()))))

    def as_bytes(self, owner, ids, place, spelled) -> tuple[np.ndarray, np.ndarray]:
        """Byte ids in the place of characters without a piece."""
        owners, out = [], []
        for o, i, p in zip(owner.tolist(), ids.tolist(), place.tolist()):
            new = [i] if i >= 0 else self.bytes_[list(spelled[o][p].encode("utf-8", "surrogatepass"))].tolist()
            out += new
            owners += [o] * len(new)
        return np.array(owners), np.array(out)

    def alone(self, word: str) -> bytes:
        """Ids of a very long pre-token: its lattice is made and relaxed block by block, in the order of its places."""
        spelled = word.replace(" ", SPACE)
        codes = codes_of(spelled)
        size = len(codes)
        taken, width = np.full(size + 1, -1, np.int32), np.zeros(size + 1, np.int32)
        score, count = [0.0], [0]
        for low in range(0, size, INDEX_CHARS):
            high = min(low + INDEX_CHARS, size)
            start, piece = self.occurrences(codes[low : min(high + self.longest, size)])
            inside = start < high - low
            start, piece = start[inside], piece[inside]
            single = np.zeros(high - low, bool)
            single[start[self.sizes[piece] == 1]] = True
            odd = np.flatnonzero(~single)
            point = codes[low + odd] - 1
            cost = 1 + (point > 0x7F) + (point > 0x7FF) + (point > 0xFFFF).astype(np.int64)
            order = np.argsort(np.concatenate([start, odd]), kind="stable")
            edges = zip(
                np.concatenate([start, odd])[order].tolist(),
                np.concatenate([self.sizes[piece], np.ones(len(odd), np.int64)])[order].tolist(),
                np.concatenate([self.scores[piece], BYTE_SCORE * cost])[order].tolist(),
                np.concatenate([np.ones(len(piece), np.int64), cost])[order].tolist(),
                np.concatenate([piece, np.full(len(odd), -1)])[order].tolist(),
            )
            room = high - low + self.longest + 1
            score += [-np.inf] * (room - len(score))
            count += [0] * (room - len(count))
            edge, wide = [-1] * room, [0] * room
            edge[: self.longest + 1] = taken[low : low + self.longest + 1].tolist() + [-1] * (low + self.longest - size)
            wide[: self.longest + 1] = width[low : low + self.longest + 1].tolist() + [0] * (low + self.longest - size)
            for at, length, value, used, which in edges:
                total, pieces, end = score[at] + value, count[at] + used, at + length
                if total > score[end] or total == score[end] and pieces < count[end]:
                    score[end], count[end], edge[end], wide[end] = total, pieces, which, length
            known = min(room, size + 1 - low)
            taken[low : low + known], width[low : low + known] = edge[:known], wide[:known]
            score, count = score[high - low :], count[high - low :]
        path = []
        end = size
        while end:
            path.append(end)
            end -= int(width[end])
        ends = np.array(path[::-1])
        piece = taken[ends]
        ids = np.where(piece >= 0, self.ids[piece], -1)
        if (ids < 0).any():
            _, ids = self.as_bytes(np.zeros(len(ids), np.int64), ids, ends - width[ends], [spelled])
        return ids.astype("<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian 32-bit bytes."""
        cut = [pretokens(t, self.pattern) for t in texts]
        if len(self.words) > WORDS_KEPT:
            self.words = {}
        new = list(set(chain.from_iterable(cut)).difference(self.words))
        for word in [w for w in new if len(w) > TOGETHER_CHARS]:
            self.words[word] = self.alone(word)
        new = [w for w in new if len(w) <= TOGETHER_CHARS]
        ends = np.cumsum([len(w) + 1 for w in new]) // INDEX_CHARS if new else np.zeros(0, np.int64)
        for part in np.split(np.arange(len(new)), np.flatnonzero(np.diff(ends)) + 1):
            if len(part):
                self.lattice([new[i] for i in part])
        return [b"".join(map(self.words.__getitem__, words)) for words in cut]


class Decoder:
    """Decodes ids; made once per task."""

    def __init__(self, pieces: Pieces):
        self.surface = pieces.surface()

    def decode(self, ids: bytes) -> str:
        """The text of ids: blanks for their mark, without the one added in front. Broken bytes are replaced."""
        data = b"".join(map(self.surface.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        text = data.decode("utf-8", "surrogatepass" if b"\xed" in data else "replace").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


def encode(documents: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids) per row of ``documents`` (doc_id, text): ids as array<int>; null and empty texts have none."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        encoder = Encoder(load_pieces(model))

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [np.frombuffer(b, "<i4") for b in encoder.encode(texts_of(batch))]
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
            flat = np.concatenate([*found, np.zeros(0, np.int32)]).astype(np.int32)
            return with_columns(batch, ["doc_id"], ids=pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)))

        return work

    kind = documents.schema["doc_id"].dataType.simpleString()
    return over_texts(documents.select("doc_id", "text"), "text", make, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) per row of ``encoded`` (doc_id, ids); null ids are none and give an empty text."""

    def run(batches):
        decoder = Decoder(load_pieces(model))
        for batch in batches:
            lists = batch.column("ids").to_pylist()
            texts = [decoder.decode(np.array(x or [], "<u4").tobytes()) for x in lists]
            yield with_columns(batch, ["doc_id"], text=pa.array(texts, pa.string()))

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def digests(documents: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_ids, ids_crc32, round_trip) per row: what ``encode`` gives, and whether ``decode`` gives the text back.

    Encoding and decoding meet in one pass, so that ids of whole texts are not moved. A text that holds the blank's mark
    itself decodes to blanks, so its round trip is false. Repeated rows each come back; doc_id may be null; other columns
    are ignored. A pre-token of more than TOGETHER_CHARS characters is encoded alone, in blocks of places: a very long word
    or text takes time and memory in proportion to its length.
    """

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        pieces = load_pieces(model)
        encoder, decoder = Encoder(pieces), Decoder(pieces)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = texts_of(batch)
            found = encoder.encode(texts)
            return with_columns(
                batch,
                ["doc_id"],
                n_ids=pa.array([len(b) // 4 for b in found], pa.int64()),
                ids_crc32=pa.array([zlib.crc32(b) for b in found], pa.int64()),
                round_trip=pa.array([decoder.decode(b) == t for b, t in zip(found, texts)], pa.bool_()),
            )

        return work

    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_ids long, ids_crc32 long, round_trip boolean"
    return over_texts(documents.select("doc_id", "text"), "text", make, schema)
