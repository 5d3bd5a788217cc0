"""Greedy packing of ordered text units into word-bounded chunks.

Words are counted once per unit. The fold then carries numbers: the words held, and where chunks begin; texts are cut by
those places at the end. Both folds run inside the item's row, so packing shuffles nothing and the work of an item is
bounded by its own text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.let import let
from ..functions.text import strip, word_count


def _joined(parts: Column) -> Column:
    return strip(F.array_join(parts, " "))


def sentence_pieces(text: Column, limit: Column) -> Column:
    """Sentences packed up to ``limit`` words; one longer sentence stands alone."""
    found = F.regexp_extract_all(text, F.lit(r"[^.!?]+[.!?]*"), F.lit(0))
    sentences = F.when(F.size(found) > 0, found).otherwise(F.array(text))
    start = F.struct(F.lit(0).alias("held"), F.array(F.lit(1)).alias("starts"))

    def step(acc: Column, s: Column) -> Column:
        full = (s["i"] > 0) & (acc["held"] + s["n"] > limit)
        return F.when(
            full, F.struct(s["n"].alias("held"), F.array_append(acc["starts"], s["i"] + 1).alias("starts"))
        ).otherwise(F.struct((acc["held"] + s["n"]).alias("held"), acc["starts"].alias("starts")))

    def cut(parts: Column) -> Column:
        counted = F.transform(parts, lambda s, i: F.struct(word_count(s).alias("n"), i.alias("i")))

        def pieces(starts: Column) -> Column:
            def piece(start: Column, k: Column) -> Column:
                end = F.coalesce(F.get(starts, k + 1), F.size(parts) + 1)
                return _joined(F.slice(parts, start, end - start))

            return F.transform(starts, piece)

        made = let(F.aggregate(counted, start, step, lambda acc: acc["starts"]), pieces)
        # only the last one can be blank without being asked for
        return let(made, lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p))

    return let(sentences, cut)


def units_of(prefix: Column, clauses: Column) -> Column:
    """Title and explainer first, then clauses; an oversized clause comes as sentences."""
    longest = F.lit(fv.CHUNK_MAX_WORDS)
    split = F.flatten(
        F.transform(
            clauses, lambda c: F.when(word_count(c) > longest, sentence_pieces(c, longest)).otherwise(F.array(strip(c)))
        )
    )
    return F.when(prefix != "", F.concat(F.array(prefix), split)).otherwise(split)


def pack(units: Column) -> Column:
    """Array of chunk texts of 120 to 180 words where the units allow it.

    A chunk that is full ends behind a unit; one that would overflow ends before it, or, still small, takes sentences of
    the unit up to the cap, and the last of them opens the next chunk.
    """
    low, high = fv.CHUNK_MIN_WORDS, fv.CHUNK_MAX_WORDS
    nowhere = F.array().cast("array<struct<at:int,room:int>>")
    whole = F.lit(None).cast("int")

    def state(held: Column, filled: Column, cuts: Column) -> Column:
        return F.struct(held.alias("held"), filled.alias("filled"), cuts.alias("cuts"))

    def cut(acc: Column, at: Column, room: Column = whole) -> Column:
        return F.array_append(acc["cuts"], F.struct(at.alias("at"), room.alias("room")))

    def append(acc: Column, u: Column) -> Column:
        held = acc["held"] + u["n"]
        return F.when(held >= low, state(F.lit(0), F.lit(False), cut(acc, u["i"] + 1))).otherwise(
            state(held, F.lit(True), acc["cuts"])
        )

    def absorb(acc: Column, u: Column) -> Column:
        room = F.lit(high) - acc["held"]

        def rest(pieces: Column) -> Column:
            last = F.coalesce(F.get(pieces, F.size(pieces) - 1), F.lit(""))
            return state(word_count(last), last != "", cut(acc, u["i"], room))

        return let(sentence_pieces(u["t"], room), rest)

    def step(acc: Column, u: Column) -> Column:
        over = acc["filled"] & (acc["held"] + u["n"] > high)
        flushed = state(F.lit(0), F.lit(False), cut(acc, u["i"]))
        return (
            F.when(over & (acc["held"] >= low // 2), let(flushed, lambda a: append(a, u)))
            .when(over, absorb(acc, u))
            .otherwise(append(acc, u))
        )

    def texts(all_units: Column) -> Column:
        counted = F.transform(
            all_units, lambda u, i: F.struct(u.alias("t"), word_count(u).alias("n"), i.alias("i"))
        )
        cuts = F.aggregate(counted, state(F.lit(0), F.lit(False), nowhere), step, lambda acc: acc["cuts"])

        def between(bounds: Column) -> Column:
            def chunk(begin: Column, k: Column) -> Column:
                end = F.get(bounds, k + 1)
                pieces = lambda b: sentence_pieces(F.get(all_units, b["at"]), b["room"])
                none = F.array().cast("array<string>")
                head = F.when(begin["room"].isNotNull(), F.slice(F.reverse(pieces(begin)), 1, 1)).otherwise(none)
                first = begin["at"] + F.when(begin["room"].isNotNull(), 1).otherwise(0)
                taken = lambda p: F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0)))
                tail = F.when(end["room"].isNotNull(), let(pieces(end), taken)).otherwise(none)
                middle = F.slice(all_units, first + 1, F.greatest(end["at"] - first, F.lit(0)))
                return _joined(F.concat(head, middle, tail))

            count = F.size(bounds) - 1
            made = F.transform(F.slice(bounds, F.lit(1), count), chunk)
            return let(made, lambda m: F.when(F.element_at(m, -1) == "", F.slice(m, F.lit(1), F.size(m) - 1)).otherwise(m))

        edge = lambda at: F.array(F.struct(at.alias("at"), whole.alias("room")))
        return let(F.concat(edge(F.lit(0)), cuts, edge(F.size(all_units))), between)

    return let(units, texts)
