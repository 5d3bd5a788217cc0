"""One ordered pass over classified lines: phase, footnotes, part, section, open item and marks of every line.

What a line means depends on what is open when it is met, so the pass is a small state machine. The lines of a document
lie together and in order, as they were exploded from its row, so nothing is shuffled or sorted for it, and each line is
looked at once. Tests on characters are made before, as columns; the machine sees their bits and a few numbers.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed_values as fv
from ..functions.text import BLANKS

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PHASES = ["pre", "preamble", "articles", "schedules", "appendices"]
PRE, PREAMBLE, ARTICLES, SCHEDULES, APPENDICES = range(5)

#: Boolean columns of a classified line, by bit.
FLAGS = (
    "is_blank is_page footnote_raw footnote_clean is_part is_chapter is_anchor is_appendix starts_schedule section_shape "
    "wins is_structural opens_preamble closes_preamble names_shape dash_in_rest dash_in_clean"
).split()
BIT = {name: 1 << place for place, name in enumerate(FLAGS)}

#: Other columns the machine reads: numbers of a heading, a part, and of marks where a piece of the line starts.
READ = {
    "number": "string",
    "bare_number": "string",
    "part_number": "string",
    "marker": "int",
    "mark_clean": "int",
    "mark_rest": "int",
    "mark_behind": "int",
    "mark_line": "int",
    "mark_note": "int",
}

#: What the machine adds to a line. ``role``: 1 title, 2 title with the dash that ends it, 3 body.
FOUND = {
    "phase": "int",
    "in_note": "boolean",
    "note_opens": "boolean",
    "note_no": "long",
    "note_item": "long",
    "item_number": "string",
    "fused": "int",
    "item_no": "long",
    "role": "int",
    "part": "string",
    "section": "string",
    "part_set": "string",
    "part_run": "long",
    "names_part": "boolean",
    "is_section": "boolean",
    "is_schedule": "boolean",
    "schedule_no": "long",
}
_ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}


def flag_bits() -> Column:
    """All flags of a line in one number."""
    bits = F.lit(0)
    for name, bit in BIT.items():
        bits = bits + F.when(F.col(name), bit).otherwise(0)
    return bits


def has_flag(name: str) -> Column:
    return F.col("flags").bitwiseAND(F.lit(BIT[name])) != 0


def leading_number(number: str) -> int:
    """Numeric part of "239AA"."""
    size = next((i for i, c in enumerate(number) if not "0" <= c <= "9"), len(number))
    return int(number[:size] or 0)


class Gate:
    """Item numbers in sequence. A heading far beyond it lost a digit to a marker; a bare number must continue it."""

    def __init__(self) -> None:
        self.last, self.open = 0, False

    def heading(self, number: str) -> tuple[str, int | None]:
        """The number a heading is accepted with, and the digit a marker fused onto it."""
        fused, limit = None, self.last + fv.SEQUENCE_JUMP
        if self.last > 0 and leading_number(number) > limit:
            tail = number[1:]
            digits = len(tail.rstrip("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
            shaped = 1 <= digits <= 3 and len(tail) - digits <= 2 and tail[:digits].isdecimal()
            if shaped and leading_number(tail) <= limit:
                number, fused = tail, int(number[0])
        self.accept(number)
        return number, fused

    def continues(self, number: str) -> bool:
        value = leading_number(number)
        further = value > self.last or (value == self.last and "A" <= number[-1] <= "Z")
        return self.open and further and value <= self.last + fv.SEQUENCE_JUMP

    def accept(self, number: str) -> None:
        self.last, self.open = leading_number(number) or self.last, True


def walk_document(flags: list[int], next_structural: list[bool], line_of, read: dict[str, list], start: int) -> list[tuple]:
    """The columns of FOUND per line of one document. ``line_of`` gives a line's text where it is needed."""
    b = BIT
    blank, page, skipped = b["is_blank"], b["is_page"], b["is_blank"] | b["is_page"]
    breaks, heading = b["is_blank"] | b["is_structural"], b["is_part"] | b["is_chapter"] | b["is_anchor"]
    number_of, bare_of, part_of = read["number"], read["bare_number"], read["part_number"]
    phase, note, note_no, gate, items = start, False, 0, Gate(), 0
    part, section, part_run, naming = "", None, 0, False
    schedule_no, in_title = 0, False
    marks: dict[int, int | None] = {}
    out = []
    for i, f in enumerate(flags):
        opens = is_section = is_schedule = named = False
        note_item = accepted = fused = part_set = None
        role = 0
        inside = note and not f & breaks
        note = inside
        if not inside and not f & skipped:
            if phase == PRE:
                if f & b["opens_preamble"]:
                    phase = PREAMBLE
            elif phase == PREAMBLE:
                opens = bool(f & b["footnote_raw"])
            elif phase != APPENDICES and f & b["is_appendix"]:
                phase, gate.open = APPENDICES, False
            elif phase != APPENDICES and f & b["starts_schedule"]:
                phase, gate.open, is_schedule = SCHEDULES, False, True
                schedule_no += 1
            elif phase == SCHEDULES:
                opens = bool(f & b["footnote_raw"])
                if not opens and read["mark_line"][i] is not None:
                    marks[read["mark_line"][i]] = None
            elif phase == ARTICLES and f & heading:
                part_set = part_of[i]
                if f & b["is_chapter"] and not f & b["is_part"]:
                    section = line_of(i).strip(BLANKS)
                else:
                    gate.open = False
                if part_set is not None:
                    part, part_run = part_set, part_run + 1
                naming = bool(f & b["is_part"]) and part_set is not None
            elif phase == ARTICLES and f & b["section_shape"] and next_structural[i]:
                is_section, gate.open, section = True, False, line_of(i).strip(BLANKS)
            elif phase == ARTICLES:
                mark = read["marker"][i]
                if f & b["footnote_clean"] and not f & b["wins"]:
                    opens = True
                    if mark is not None and gate.open:
                        marks[mark] = items
                else:
                    number = number_of[i]
                    if number is not None:
                        accepted, fused = gate.heading(number)
                    elif bare_of[i] is not None and gate.continues(bare_of[i]):
                        accepted = bare_of[i]
                        gate.accept(accepted)
                    if accepted is not None:
                        items, in_title = items + 1, True
                        mark = fused if mark is None else mark
                    if gate.open:
                        if mark is not None:
                            marks[mark] = items
                        headed = accepted is not None
                        dash = number is not None and f & b["dash_in_rest"] if headed else f & b["dash_in_clean"]
                        role = (2 if dash else 1) if in_title else 3
                        in_title = in_title and not dash
                        at = "mark_clean" if role == 3 else "mark_rest" if headed else "mark_behind"
                        if role > 1 and read[at][i] is not None:
                            marks[read[at][i]] = items
                    else:
                        named = naming and bool(f & b["names_shape"])
                        naming = naming and named
                        if not named and f & b["section_shape"]:
                            section = line_of(i).strip(BLANKS)
        open_item = items if gate.open else None
        if opens:
            note, note_no = True, note_no + 1
            mark = read["mark_note"][i]
            note_item = marks.get(mark)
            note_item = open_item if note_item is None else note_item
            if mark is not None:
                marks[mark] = None
        out.append(
            (
                phase,
                note,
                opens,
                note_no if note else None,
                note_item,
                accepted,
                fused,
                open_item,
                role,
                part,
                section,
                part_set,
                part_run,
                named,
                is_section,
                is_schedule,
                schedule_no,
            )
        )
        if phase == PREAMBLE and not note and not f & skipped and f & b["closes_preamble"]:
            opened_here = len(out) == 1 or out[-2][0] != PREAMBLE
            phase = PREAMBLE if opened_here else ARTICLES
    return out


def _complete(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole documents, with the place where each begins. A document begins where line numbers do not rise."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        number = batch.column("line_no").to_numpy()
        before = held[-1].column("line_no")[-1].as_py() if held else number[0]
        begins = np.flatnonzero(np.diff(number, prepend=before) <= 0)
        if not len(begins) or (begins[-1] == 0 and not held):
            held.append(batch)
            continue
        table = pa.Table.from_batches([*held, batch.slice(0, begins[-1])])
        held = [batch.slice(begins[-1])]
        number = table.column("line_no").to_numpy()
        yield table, np.flatnonzero(np.diff(number, prepend=number[0]) <= 0)
    if held:
        table = pa.Table.from_batches(held)
        number = table.column("line_no").to_numpy()
        yield table, np.flatnonzero(np.diff(number, prepend=number[0]) <= 0)


def walked(lines: DataFrame, start: int, keep: list[str]) -> DataFrame:
    """``lines`` with the columns of FOUND in place of those of READ; ``keep`` and ``flags`` come through as they are.

    Lines of a document must lie together, in order. A document is held while it is walked, as its row was before.
    """
    given = ["doc_id", "line_no", *keep, "flags"]
    kinds = {f.name: f.dataType for f in lines.schema.fields}
    schema = T.StructType([T.StructField(n, kinds[n]) for n in given])
    schema = T.StructType(schema.fields + T.StructType.fromDDL(", ".join(f"{n} {k}" for n, k in FOUND.items())).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        skipped = BIT["is_blank"] | BIT["is_page"]
        for table, begins in _complete(batches):
            flags = table.column("flags").to_numpy().astype(np.int64)
            ends = np.append(begins[1:], len(flags))
            counting = np.flatnonzero((flags & skipped) == 0)
            place = np.searchsorted(counting, np.arange(len(flags)), side="right")
            ahead = counting[np.minimum(place, max(len(counting) - 1, 0))] if len(counting) else np.zeros(len(flags), np.int64)
            end_of = np.repeat(ends, ends - begins)
            known = (place < len(counting)) & (ahead < end_of)
            structural = known & ((flags[ahead] & BIT["is_structural"]) != 0)
            line, bits, follows = table.column("line"), flags.tolist(), structural.tolist()
            read = {name: table.column(name).to_pylist() for name in READ}
            rows: list[tuple] = []
            for low, high in zip(begins.tolist(), ends.tolist()):
                mine = {name: values[low:high] for name, values in read.items()}
                rows += walk_document(bits[low:high], follows[low:high], lambda i: line[low + i].as_py(), mine, start)
            columns = [table.column(n) for n in given]
            columns += [pa.array(c, _ARROW[kind]) for c, kind in zip(zip(*rows), FOUND.values())]
            yield from pa.table(columns, names=[*given, *FOUND]).combine_chunks().to_batches()

    return lines.select(*given, *READ).mapInArrow(run, schema)
