"""Displaced signs of Devanagari words, moved one consonant right.

A corpus repeats its words, so each distinct one is repaired once per task and
the texts are put together from the results. A move changes issues only around
itself, so it is judged on the characters beside it and the walk steps back as
far as it can matter: the work grows with the length of a word.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fv

# Workers need not have this package installed: its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Words a task remembers; beyond it the memory starts anew.
WORDS_KEPT = 200_000
SIGNS = fv.VOWEL_SIGNS
BEFORE_SIGN = fv.VOWEL_SIGNS + fv.VIRAMA
NUKTA = fv.NUKTA
PIECES = re.compile(r"\S+|\s+", re.ASCII)
# What ends the search for a word start: letters of the script, marks and digits.
STOP = re.compile(r"[ऀ-ॿ᳐-᳿.,;:()\[\]\"'0-9]")


def misplaced(before: str, ch: str) -> bool:
    """Whether a character may not follow the one before it."""
    return bool(before) and ((ch in SIGNS and before in BEFORE_SIGN) or (ch == NUKTA and before in SIGNS))


def repair_word(word: str) -> str:
    """The first move that lowers the number of issues is taken, until none does."""
    stop = STOP.search(word)
    start = stop.start() if stop and stop.group() in SIGNS else -1
    out = list(word)
    p = 0
    while p < len(out) - 1:
        ch, after = out[p], out[p + 1]
        at_start = p == start and ch in SIGNS
        if (ch in SIGNS or ch == NUKTA) and "क" <= after <= "ह":
            before = out[p - 1] if p else ""
            flagged = misplaced(before, ch)
            if flagged or at_start:
                beyond = out[p + 2] if p + 2 < len(out) else ""
                now = flagged + at_start + (bool(beyond) and misplaced(after, beyond))
                then = misplaced(after, ch) + (bool(beyond) and misplaced(ch, beyond))
                if then < now:
                    out[p], out[p + 1] = after, ch
                    p = max(p - 3, 0)
                    continue
        p += 1
    return "".join(out)


def repair_words(text: Column) -> Column:
    """Every word of a text repaired; blanks stay as they are and null stays null."""

    @F.pandas_udf("string")
    def repaired(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, str] = {}
        for batch in batches:
            texts = []
            for value in batch:
                if value is None:
                    texts.append(None)
                    continue
                pieces = PIECES.findall(value)
                for new in set(pieces).difference(known):
                    known[new] = repair_word(new)
                texts.append("".join(map(known.__getitem__, pieces)))
                if len(known) > WORDS_KEPT:
                    known = {}
            yield pd.Series(texts, dtype=object)

    return repaired(text)
