"""Word-by-word reconciliation of two noisy versions of a text.

The two texts of a row are aligned and fused in one Arrow pass. The alignment is
exact at any length: rows of the dynamic program are bit vectors, and rows kept
are thinned to a memory bound and recomputed in blocks. What a choice needs to
know of a word (letters, soundness, likeness to another) is worked out once per
distinct word of a task, for a corpus repeats its words.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import fixed_values as fv
from ..functions.text import BLANKS, word_count
from ..session import small_batches

# Workers need not have this package installed: its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROW_BYTES_KEPT = 64 * 1024 * 1024
#: Bytes of both texts whose words and results are held as Python objects at once; a longer row is held alone.
SLICE_BYTES = 1 << 20
_TOKEN = "struct<line:int,word:string>"


def common_subsequence(a: Sequence[str], b: Sequence[str], budget: int = ROW_BYTES_KEPT) -> list[tuple[int, int]]:
    """Matched index pairs of a longest common subsequence; ties skip ``a`` first."""
    # equal heads match, whatever follows; the dynamic program starts behind them
    head = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    if head:
        rest = common_subsequence(a[head:], b[head:], budget)
        return [(k, k) for k in range(head)] + [(i + head, j + head) for i, j in rest]
    n, m = len(a), len(b)
    if n == 0 or m == 0:
        return []
    places: dict[str, int] = {}
    for q, token in enumerate(reversed(b)):
        places[token] = places.get(token, 0) | (1 << q)
    full = (1 << m) - 1

    def advance(row: int, token: str) -> int:
        hit = row & places.get(token, 0)
        return ((row + hit) | (row - hit)) & full

    # Row p covers the last p tokens of a; a zero bit is a step of the length.
    stride = max(1, -(-n * (m // 8 + 32) // budget))
    kept = {0: full}
    row = full
    for p in range(1, n + 1):
        row = advance(row, a[n - p])
        if p % stride == 0:
            kept[p] = row
    block: dict[int, int] = {}

    def row_at(p: int) -> int:
        if p in kept:
            return kept[p]
        if p not in block:
            block.clear()
            base = p - p % stride
            current = kept[base]
            for r in range(base + 1, min(base + stride, n) + 1):
                current = advance(current, a[n - r])
                block[r] = current
        return block[p]

    def length(p: int, q: int) -> int:
        return q - (row_at(p) & ((1 << q) - 1)).bit_count()

    pairs = []
    i = j = 0
    left = length(n, m)
    while left and i < n and j < m:
        if a[i] == b[j]:
            pairs.append((i, j))
            i, j, left = i + 1, j + 1, left - 1
        elif not (row_at(n - i) >> (m - j - 1)) & 1 or length(n - i - 1, m - j) >= left:
            i += 1
        else:
            j += 1
    return pairs


#: Words a task remembers letters, soundness and likeness of; beyond it the memory starts anew.
WORDS_KEPT = 200_000
_WORD = re.compile("[^" + re.escape(BLANKS) + "]+")
_LETTERLESS = re.compile(r"[\s|.,;:()\[\]'\"–—]+")
_NO_LETTER = re.compile(f"[^{fv.SKELETON_CLASS}]+")
# A word with an issue, by the rules of the script audit; a word holds no blank.
_UNSOUND = re.compile(
    rf"[\uFFFD\uE000-\uF8FF\u200C]|(?<=[\u0900-\u097F])\||\|(?=[\u0900-\u097F])|(?<=[{fv.VOWEL_SIGNS}{fv.VIRAMA}])[{fv.VOWEL_SIGNS}]"
    rf"|(?<=[{fv.VOWEL_SIGNS}]){fv.NUKTA}|^[^\u0900-\u097F\u1CD0-\u1CFF.,;:()\[\]\"'0-9]*[{fv.VOWEL_SIGNS}]"
)
Token = tuple[int, str]
Pair = tuple[Token | None, Token | None]


def tokens_of(text: str) -> list[Token]:
    """(line, word) of a text; a word of pure punctuation joins the one before it."""
    out: list[Token] = []
    for number, line in enumerate(text.split("\n")):
        for word in _WORD.findall(line):
            if out and _LETTERLESS.fullmatch(word):
                out[-1] = (out[-1][0], out[-1][1] + word)
            else:
                out.append((number, word))
    return out


def distance_within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance is at most ``most``; only the band that can be is computed."""
    if abs(len(a) - len(b)) > most:
        return False
    far = most + 1
    row = [j if j <= most else far for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        low, high = max(1, i - most), min(len(b), i + most)
        last, row[low - 1] = row[low - 1], (i if low == 1 and i <= most else far)
        for j in range(low, high + 1):
            above = row[j] if j < i + most else far
            last, row[j] = above, min(above + 1, row[j - 1] + 1, last + (x != b[j - 1]), far)
    return row[len(b)] <= most


class Words:
    """What is known of the words of a corpus; each distinct one is looked at once."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.letters: dict[str, str] = {}
        self.sound: dict[str, bool] = {}
        self.like: dict[tuple[str, str], bool] = {}

    def tidy(self) -> None:
        if max(len(self.letters), len(self.sound), len(self.like)) > WORDS_KEPT:
            self.clear()

    def skeleton(self, word: str) -> str:
        found = self.letters.get(word)
        if found is None:
            found = self.letters[word] = _NO_LETTER.sub("", word)
        return found

    def is_sound(self, word: str) -> bool:
        found = self.sound.get(word)
        if found is None:
            found = self.sound[word] = _UNSOUND.search(word) is None
        return found

    def similar(self, a: str, b: str) -> bool:
        """The same word misspelled: letters within max(2, a third of the shorter)."""
        pair = (self.skeleton(a), self.skeleton(b))
        found = self.like.get(pair)
        if found is None:
            found = self.like[pair] = distance_within(*pair, max(2, min(map(len, pair)) // 3))
        return found


def paired(a: list[Token], b: list[Token], words: Words) -> list[Pair]:
    """Tokens matched by their letters; in the gaps between, alike words pair by place and the rest stand alone."""
    matched = common_subsequence([words.skeleton(w) for _, w in a], [words.skeleton(w) for _, w in b])
    out: list[Pair] = []
    i = j = 0
    for p, q in [*matched, (len(a), len(b))]:
        width = min(p - i, q - j)
        for x, y in zip(a[i : i + width], b[j : j + width]):
            out += [(x, y)] if words.similar(x[1], y[1]) else [(x, None), (None, y)]
        out += [(x, None) for x in a[i + width : p]]
        out += [(None, y) for y in b[j + width : q]]
        if p < len(a) and q < len(b):
            out.append((a[p], b[q]))
        i, j = p + 1, q + 1
    return out


def chosen(ocr: Token | None, layer: Token | None, words: Words) -> tuple[Token | None, bool]:
    """The side taken for a pair, and whether it wants review."""
    if layer is None:
        return ocr, True
    if ocr is None:
        return (layer if words.is_sound(layer[1]) else None), True
    if ocr[1] == layer[1]:
        return layer, False
    layer_sound = words.is_sound(layer[1])
    if words.skeleton(ocr[1]) == words.skeleton(layer[1]):
        if layer_sound:
            return layer, False
        return (ocr if words.is_sound(ocr[1]) else layer), True
    return (ocr if not layer_sound or words.is_sound(ocr[1]) else layer), True


def fused_text(ocr: str, layer: str, words: Words) -> tuple[str, list[dict[str, str | bool | None]]]:
    """The fused text, in the layer's lines, and the words that want review."""
    lines: dict[int, list[str]] = {}
    flags = []
    for x, y in paired(tokens_of(ocr), tokens_of(layer), words):
        taken, flagged = chosen(x, y, words)
        if flagged:
            word = (taken or y)[1]
            flags.append({"word": word, "ocr": x and x[1], "layer": y and y[1], "sound": words.is_sound(word)})
        if taken is not None:
            lines.setdefault((y or taken)[0], []).append(taken[1])
    return "\n".join(" ".join(lines[n]) for n in sorted(lines)), flags


def slices(batch: pa.RecordBatch, ocr: str, layer: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``most`` bytes in the two texts."""
    sizes = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in (ocr, layer))
    starts = np.flatnonzero(np.diff(np.cumsum(sizes) // most, prepend=-1))
    for low, high in zip(starts, [*starts[1:], batch.num_rows]):
        yield batch.slice(low, high - low)


def _with(df: DataFrame, ocr: str, layer: str, new: T.StructType, work: Callable[[str, str, Words], tuple]) -> DataFrame:
    """``df`` with the columns that ``work`` gives for two texts; null reads as empty. Words are known for a task.

    A batch is worked off in slices, so what a task holds follows its longest text, not the rows of a batch.
    """
    small_batches(df.sparkSession)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [f.type for f in to_arrow_schema(new)]
        words = Words()
        for batch in (part for whole in batches for part in slices(whole, ocr, layer)):
            found = []
            for x, y in zip(batch.column(ocr).to_pylist(), batch.column(layer).to_pylist()):
                found.append(work(x or "", y or "", words))
                words.tidy()
            columns = [pa.array(c, k) for c, k in zip(list(zip(*found)) or [[] for _ in kinds], kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*names, *new.names])
        del words
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, T.StructType(df.schema.fields + new.fields))


def align(df: DataFrame, ocr: str, layer: str) -> DataFrame:
    """Adds ``pairs``: array of (ocr, layer) tokens (line, word), either side null."""

    def work(a: str, b: str, words: Words) -> tuple:
        token = lambda t: t and {"line": t[0], "word": t[1]}
        return ([{"ocr": token(x), "layer": token(y)} for x, y in paired(tokens_of(a), tokens_of(b), words)],)

    return _with(df, ocr, layer, T.StructType.fromDDL(f"pairs array<struct<ocr:{_TOKEN},layer:{_TOKEN}>>"), work)


def fuse(df: DataFrame, ocr: str, layer: str) -> DataFrame:
    """Adds ``text`` (fused, in the layer's lines) and ``flags`` (word, ocr, layer, whether the word is sound)."""
    new = T.StructType.fromDDL("text string, flags array<struct<word:string,ocr:string,layer:string,sound:boolean>>")
    return _with(df, ocr, layer, new, fused_text)


def fusion_quality(fused: DataFrame) -> DataFrame:
    """One row: pages, words, flags, flag rate in percent, one-sided and unresolved flags."""
    one_sided = F.size(F.filter("flags", lambda f: f["ocr"].isNull() | f["layer"].isNull()))
    unresolved = F.size(F.filter("flags", lambda f: f["ocr"].isNotNull() & f["layer"].isNotNull() & ~f["sound"]))
    per_page = fused.select(
        word_count(F.col("text")).alias("w"), F.size("flags").alias("f"), one_sided.alias("o"), unresolved.alias("u")
    )
    rate = F.round(100 * F.sum("f") / F.greatest(F.sum("w"), F.lit(1)), 2)
    return per_page.agg(
        F.count(F.lit(1)).alias("pages"),
        F.sum("w").alias("words"),
        F.sum("f").alias("flags"),
        rate.alias("flag_percent"),
        F.sum("o").alias("one_sided"),
        F.sum("u").alias("unresolved"),
    )
