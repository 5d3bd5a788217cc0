"""Statute text to parts, items, clauses, schedules and footnotes.

Lines are classified by their characters and walked once in order, both where
the document is read. The lines of an item, a footnote or a part are then
gathered by their key; documents are never gathered, so a long one is spread.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import numbers, text
from ..functions.let import constant_array, constant_map, let
from .statute_walk import PHASES, PREAMBLE, SCHEDULES, flag_bits, has_flag, walked


class Statute:
    """Tables of a segmented corpus, all keyed by ``doc_id`` and planned on first use.

    ``lines`` classified lines; ``items`` articles with clauses, status and
    amendments; ``clauses`` exploded; ``footnotes`` linked to items; ``parts``,
    ``schedules`` and ``preambles``. The tables share the plan up to ``lines``.
    """

    def __init__(self, lines: DataFrame, status_as_closed: bool = True):
        self.lines = lines
        self._as_closed = status_as_closed

    @cached_property
    def _groups(self) -> DataFrame:
        return _groups(self.lines)

    @cached_property
    def items(self) -> DataFrame:
        return _item_table(self._groups, self._as_closed)

    @cached_property
    def clauses(self) -> DataFrame:
        number = F.col("number").alias("item_number")
        items = self._groups.where("item is not null").select("doc_id", "item.*")
        exploded = items.select("doc_id", "item_no", number, F.posexplode("clauses").alias("clause_no", "_c"))
        return exploded.select("doc_id", "item_no", "item_number", "clause_no", "_c.*")

    @cached_property
    def footnotes(self) -> DataFrame:
        return self._groups.select("doc_id", F.inline("notes"))

    @cached_property
    def parts(self) -> DataFrame:
        return _parts(self.lines)

    @cached_property
    def schedules(self) -> DataFrame:
        return _schedules(self.lines)

    @cached_property
    def preambles(self) -> DataFrame:
        return _preambles(self.lines)


def numbered_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line): form feeds dropped, right blanks cut, 0-based numbers."""
    exploded = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    tidy = F.rtrim(F.replace("raw", F.lit("\f"), F.lit("")), F.lit(text.BLANKS))
    return exploded.select("doc_id", "line_no", tidy.alias("line"))


def meaningful(line: Column) -> Column:
    """Neither blank nor a bare page number."""
    return ~line.rlike(r"^\s*(?:\d\s*){0,3}$")


def _may_be_structural() -> str:
    """Anchored pattern that every part, chapter, schedule, appendix and anchor line meets.

    Most lines fail it on their first letter, which spares them the rewriting of
    the whole line that the exact tests need.
    """
    heads = ["PART", "CHAPTER", "APPENDIX", *fv.SCHEDULE_WORDS, *[a[0] for a in fv.PART_NAME_ANCHORS]]
    return r"(?i)^[\s\d\[]*(?:" + "|".join(text.spaced(h) for h in sorted({h[:5] for h in heads})) + ")"


def _starts_schedule_anchor(line: Column) -> Column:
    found = F.lit(False)
    for prefix, _, _ in fv.SCHEDULE_ANCHORS:
        found = found | line.rlike(r"^\s*" + text.spaced(prefix.replace(" ", "")))
    return found


def classify_lines(lines: DataFrame) -> DataFrame:
    """Boolean and extracted columns per line; no state, no shuffle.

    Tests that fail on a line's first characters come first and guard the rest.
    """
    line = F.col("line")
    clean, marker = text.split_marker(text.strip(line))
    out = lines.withColumns(
        {
            "structure": F.when(line.rlike(_may_be_structural()), text.structural_text(line)).otherwise(F.lit("")),
            "clean": clean,
            "marker": marker,
        }
    )
    schedule_words = "|".join(sorted(fv.SCHEDULE_WORDS, key=len, reverse=True))
    word = F.regexp_extract(
        F.regexp_replace(text.squish(line), r"^\d{1,2}\[?", ""), rf"^({schedule_words})SCHEDULE", 1
    )
    letters_apart = "^[^A-Z]*" + "[^A-Z]*".join("APPENDIXI")
    out = out.withColumns(
        {
            "is_blank": ~line.rlike(r"\S"),
            "is_page": line.rlike(r"^\s*(?:\d\s*){1,3}$"),
            "footnote_raw": text.is_footnote_line(line),
            "footnote_clean": text.is_footnote_line(F.col("clean")),
            "is_part": F.col("structure").rlike(fv.PART_HEADING),
            "is_chapter": F.col("structure").rlike(fv.CHAPTER_HEADING),
            "is_anchor": F.col("structure").isin([a[0] for a in fv.PART_NAME_ANCHORS]),
            "is_appendix": line.rlike(letters_apart),
            "schedule_word": F.when(F.col("structure") != "", F.nullif(word, F.lit(""))),
            "number": F.nullif(F.regexp_extract("clean", fv.ITEM_HEADING, 1), F.lit("")),
            "rest": F.regexp_extract("clean", fv.ITEM_HEADING, 2),
            "bare_number": F.nullif(F.regexp_extract("clean", fv.BARE_NUMBER, 1), F.lit("")),
            "section_shape": (F.length(text.strip(line)) < 60) & text.looks_like_section_heading(line),
        }
    )
    heads_schedule = F.col("structure").rlike(rf"^({schedule_words})SCHEDULE")
    dash_body = text.after_dash(F.col("clean")) != ""
    wins = F.col("number").isNotNull() & (~F.col("footnote_clean") | dash_body)
    return out.withColumns(
        {
            "wins": wins,
            "is_structural": F.col("is_part")
            | F.col("is_chapter")
            | F.startswith("structure", F.lit("APPENDIX"))
            | heads_schedule
            | F.col("bare_number").isNotNull()
            | wins,
        }
    )


def line_class(schedules: bool = True) -> Column:
    """One class name per classified line, in the order the rules are tried."""
    return (
        F.when(F.col("is_blank"), "blank")
        .when(F.col("is_page"), "page")
        .when(F.col("is_appendix"), "appendix")
        .when(F.col("schedule_word").isNotNull(), "schedule")
        .when(F.col("is_part"), "part")
        .when(F.col("is_chapter"), "chapter")
        .when(F.col("is_anchor"), "part-anchor")
        .when(F.col("footnote_clean") & ~F.col("wins"), "footnote")
        .when(F.col("number").isNotNull(), "item")
        .when(F.col("bare_number").isNotNull(), "bare-item")
        .otherwise("body")
    )


def _with_marks(lines: DataFrame) -> DataFrame:
    """``flags`` of classified lines, and the numbers the walk reads beside them."""

    def mark(c: Column) -> Column:
        return F.nullif(F.regexp_extract(c, fv.MARKER, 1), F.lit("")).cast("int")

    def dashed(c: Column) -> Column:
        """The mark at the head of what follows the title dash."""
        return F.when(text.dash_position(c) > 0, mark(text.strip_leading_dashes(text.after_dash(c))))

    line = F.col("line")
    name = part_name(line)
    anchors = constant_map({a[0]: a[1] for a in fv.PART_NAME_ANCHORS})
    found = {
        "starts_schedule": F.col("schedule_word").isNotNull() | _starts_schedule_anchor(line),
        "opens_preamble": F.startswith("line", F.lit(fv.PREAMBLE_OPENING)),
        "closes_preamble": line.rlike(text.spaced(fv.PREAMBLE_CLOSING) + r"\s*$"),
        "names_shape": line.rlike(r"^[\s\d*\[\]]*[A-Z]") & (F.length(name) > 1) & name.rlike(r"^[A-Z][A-Z\s&,'’().-]*$"),
        "dash_in_rest": text.dash_position(F.col("rest")) > 0,
        "dash_in_clean": text.dash_position(F.col("clean")) > 0,
        "part_number": F.when(F.col("is_part"), numbers.roman_number(_part_roman())).when(
            F.col("is_anchor"), anchors[F.col("structure")]
        ),
        "mark_clean": mark(F.col("clean")),
        "mark_rest": dashed(F.col("rest")),
        "mark_behind": dashed(F.col("clean")),
        "mark_line": mark(line),
        "mark_note": F.nullif(F.regexp_extract(text.strip(line), r"^(\d{1,2})\.", 1), F.lit("")).cast("int"),
    }
    return lines.withColumns(found).withColumn("flags", flag_bits())


def part_name(line: Column) -> Column:
    return text.normalize_space(F.regexp_replace(line, r"[\d*\[\]]", ""))


def _pieces(lines: DataFrame) -> DataFrame:
    """``title_piece``, ``body_piece`` and ``part_name_piece`` of walked lines, and the flags later steps read."""
    headed, role = F.col("item_number").isNotNull(), F.col("role")
    # the rest of a heading; a bare number has none
    rest = F.regexp_extract("clean", fv.ITEM_HEADING, 2)
    source = F.when(headed, rest).otherwise(F.col("clean"))
    flags = {n: has_flag(n) for n in ("is_blank", "is_page", "is_part", "is_anchor")}
    return lines.withColumns(
        {
            **flags,
            "title_piece": F.when(role.isin(1, 2), text.strip(text.before_dash(source))),
            "body_piece": F.when(role == 2, text.strip_leading_dashes(text.after_dash(source))).when(role == 3, F.col("clean")),
            "part_name_piece": F.when(F.col("names_part"), part_name(F.col("line"))),
        }
    )


def _part_roman() -> Column:
    return F.regexp_extract("structure", fv.PART_HEADING, 1)


def _joined(c: str, separator: str = " ") -> Column:
    ordered = F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("line_no", F.col(c).alias("t")))))
    return F.array_join(F.transform(ordered, lambda s: s["t"]), separator)


def _clause_piece(p: Column) -> Column:
    """Struct(marker, kind, number, text) of one body line."""
    marker = F.nullif(F.regexp_extract(p["piece"], fv.MARKER, 1), F.lit("")).cast("int")
    bare = F.regexp_replace(
        F.regexp_replace(p["piece"], r"^\d{1,2}\*?(?=\[)", ""), r"^\[\s*(?=\(\d{1,2}[A-Z]?\))", ""
    )

    def parsed(t: Column) -> Column:
        explained = F.regexp_replace(F.regexp_extract(t, fv.EXPLANATION, 2), r"^[\u2014\u23AF]\s*", "")

        def entry(kind: Column | None, number: Column | None, body: Column) -> Column:
            return F.struct(
                p["line_no"].alias("line_no"),
                marker.alias("marker"),
                (F.lit(None).cast("string") if kind is None else kind).alias("kind"),
                (F.lit(None).cast("string") if number is None else number).alias("number"),
                body.alias("text"),
            )

        return (
            F.when(t.rlike(fv.EXPLANATION), entry(F.lit("explanation"), None, explained))
            .when(t.rlike(text.ascii_edges(fv.ILLUSTRATION)), entry(F.lit("illustration"), None, F.regexp_extract(t, text.ascii_edges(fv.ILLUSTRATION), 1)))
            .when(
                t.rlike(fv.CLAUSE_START),
                entry(F.lit("clause"), F.regexp_extract(t, fv.CLAUSE_START, 1), F.regexp_extract(t, fv.CLAUSE_START, 2)),
            )
            .otherwise(entry(None, None, t))
        )

    return let(bare, parsed)


def _clauses_of(pieces: Column) -> Column:
    """Array of (number, text, kind) from parsed body lines of one item."""
    at = F.filter(
        F.transform(pieces, lambda p, i: F.when((i == 0) | p["kind"].isNotNull(), i + 1)), lambda i: i.isNotNull()
    )

    def build(starts: Column) -> Column:
        def clause(start: Column, k: Column) -> Column:
            end = F.coalesce(F.get(starts, k + 1), F.size(pieces) + 1)
            body = F.array_join(F.transform(F.slice(pieces, start, end - start), lambda p: p["text"]), " ")
            head = F.get(pieces, start - 1)
            return F.struct(
                head["number"].alias("number"),
                text.normalize_space(body).alias("text"),
                F.coalesce(head["kind"], F.lit("clause")).alias("kind"),
            )

        return F.filter(F.transform(starts, clause), lambda c: c["text"] != "")

    return let(at, build)


def _groups(lines: DataFrame) -> DataFrame:
    """(doc_id, item_no, item, notes): every item with its clauses, and the footnotes met while it was open.

    Lines outside items are a group with a null item_no, for their footnotes. Each line is read once for both.
    """
    parsed = "array<struct<line_no:int,marker:int,kind:string,number:string,text:string>>"
    stripped = text.strip(F.col("line"))
    marker = F.nullif(F.regexp_extract(stripped, r"^(\d{1,2})\.", 1), F.lit("")).cast("int")
    title = F.struct("line_no", F.col("title_piece").alias("t"))
    piece = F.struct("line_no", F.col("body_piece").alias("piece"))
    opening = F.when(F.col("note_opens"), marker).alias("marker")
    noted = F.struct("note_no", "line_no", stripped.alias("t"), opening, F.col("note_item").alias("target"))
    grouped = lines.where("item_no is not null or in_note").groupBy("doc_id", "item_no").agg(
        F.min("line_no").alias("line_no"),
        F.max("line_no").alias("last_line"),
        F.max("item_number").alias("number"),
        F.min_by("part", "line_no").alias("part"),
        F.min_by("section", "line_no").alias("section"),
        F.array_sort(F.collect_list(F.when(F.col("title_piece").isNotNull(), title))).alias("_titles"),
        F.array_sort(F.collect_list(F.when(F.coalesce("body_piece", F.lit("")) != "", piece))).alias("_pieces"),
        F.array_sort(F.collect_list(F.when(F.col("in_note"), noted))).alias("_noted"),
    )
    titled = text.clean_title(F.array_join(F.transform("_titles", lambda t: t["t"]), " "))
    whole = grouped.withColumn("_parsed", F.transform("_pieces", _clause_piece).cast(parsed)).withColumns(
        {"title": titled, "clauses": _clauses_of(F.col("_parsed"))}
    )
    item = F.when(F.col("item_no").isNotNull(), F.struct(*ITEM_FIELDS))
    return whole.select("doc_id", "item_no", item.alias("item"), _notes_of(F.col("_noted")).alias("notes"))


def _notes_of(rows: Column) -> Column:
    """Footnotes from their lines in order, with the item each belongs to.

    A footnote consumes its marker: the latest mark before it with the same number decides. A mark names the item it
    stands in, an earlier footnote or a mark in a schedule hides those before, and without an item the one open at the
    footnote takes it. The walk has decided that where the footnote opens.
    """
    starts = F.filter(
        F.transform(rows, lambda r, i: F.when((i == 0) | (r["note_no"] != F.get(rows, i - 1)["note_no"]), i + 1)),
        lambda i: i.isNotNull(),
    )

    def build(at: Column) -> Column:
        def note(start: Column, k: Column) -> Column:
            end = F.coalesce(F.get(at, k + 1), F.size(rows) + 1)
            first, last = F.get(rows, start - 1), F.get(rows, end - 2)
            return F.struct(
                first["note_no"].alias("note_no"),
                first["marker"].alias("marker"),
                first["line_no"].alias("line_no"),
                last["line_no"].alias("last_line"),
                first["target"].alias("item_no"),
                F.array_join(F.transform(F.slice(rows, start, end - start), lambda r: r["t"]), " ").alias("text"),
            )

        return F.transform(at, note)

    return let(starts, build)


ITEM_FIELDS = ["item_no", "line_no", "last_line", "number", "part", "section", "title", "clauses"]


def _item_table(groups: DataFrame, as_closed: bool) -> DataFrame:
    """Items with status and amendments: distinct, by the first place that cites them, in the item or its footnotes.

    A footnote may belong to an item closed before, so items and citations meet by the item's number.
    """
    kind = groups.schema["item"].dataType.simpleString()
    nowhere = F.lit(None).cast("struct<at:int,idx:int,n:int>").alias("place")

    def cited(target: Column, at: Column, body: Column) -> Column:
        def place(n: Column, i: Column) -> Column:
            return F.struct(at.alias("at"), i.alias("idx"), n.alias("n"))

        return F.transform(
            numbers.citations(body),
            lambda n, i: F.struct(target.alias("target"), F.lit(None).cast(kind).alias("item"), place(n, i).alias("place")),
        )

    item = F.col("item")
    itself = F.struct(F.col("item_no").alias("target"), item.alias("item"), nowhere)
    own = cited(F.col("item_no"), item["last_line"], F.array_join(F.transform(item["clauses"], lambda c: c["text"]), " "))
    noted = F.filter("notes", lambda n: n["item_no"].isNotNull())
    below = F.flatten(F.transform(noted, lambda n: cited(n["item_no"], n["last_line"], n["text"])))
    mine = F.when(item.isNotNull(), F.concat(F.array(itself), own))
    facts = groups.select("doc_id", F.explode(F.concat(F.coalesce(mine, F.slice(below, 1, 0)), below)).alias("f")).select("doc_id", "f.*")
    met = facts.groupBy("doc_id", "target").agg(
        F.first("item", ignorenulls=True).alias("item"), F.array_sort(F.collect_list("place")).alias("places")
    )
    counted = F.get("places", F.lit(0))["at"] <= item["last_line"] if as_closed else F.size("places") > 0
    first_clause = F.coalesce(F.get(item["clauses"], F.lit(0))["text"], F.lit(""))
    amendments = F.array_distinct(F.transform("places", lambda p: p["n"]))
    return met.select(
        "doc_id",
        *(item[f].alias(f) for f in ITEM_FIELDS),
        status(first_clause, F.coalesce(counted, F.lit(False))).alias("status"),
        F.transform(amendments, numbers.amendment_id).alias("amended_by"),
    )


def segment_statutes(docs: DataFrame, start_phase: str = "pre", status_as_closed: bool = True) -> Statute:
    """Segment (doc_id, text) documents, each row a document of its own with a distinct id.

    Lines are classified and walked where their document is read; what moves are the lines of items and footnotes, once,
    to where they are joined. ``start_phase="articles"`` reads body excerpts without a preamble. ``status_as_closed``
    leaves footnotes read behind an item's end out of its status; they count in ``amended_by`` either way. When several
    tables are written, checkpoint ``lines`` first and build ``Statute`` on the result.
    """
    lines = _with_marks(classify_lines(numbered_lines(docs)))
    return Statute(_pieces(walked(lines, PHASES.index(start_phase), ["line", "clean"])), status_as_closed)


def status(first_clause: Column, amended: Column) -> Column:
    """omitted over repealed over amended over in-force."""
    return (
        F.when(first_clause.rlike(r"(?i)^\[?\s*Omitted"), "omitted")
        .when(first_clause.rlike(r"(?i)^\[?\s*Repealed"), "repealed")
        .when(amended, "amended")
        .otherwise("in-force")
    )


def _parts(lines: DataFrame) -> DataFrame:
    names = constant_map({a[1]: a[2] for a in fv.PART_NAME_ANCHORS})
    anchored = F.col("is_anchor") & F.col("part_set").isNotNull()
    runs = lines.withColumn("_piece", F.when(anchored, names[F.col("part_set")]).otherwise(F.col("part_name_piece")))
    named = (
        runs.filter(F.col("_piece").isNotNull() & (F.col("part_run") > 0))
        .groupBy("doc_id", "part_run")
        .agg(F.first("part").alias("number"), F.min("line_no").alias("line_no"), text.normalize_space(_joined("_piece")).alias("name"))
    )
    return named.groupBy("doc_id", "number").agg(
        F.min("line_no").alias("line_no"), F.min_by("name", "line_no").alias("name")
    )


def _schedules(lines: DataFrame) -> DataFrame:
    words = "|".join(sorted(fv.SCHEDULE_WORDS, key=len, reverse=True))
    squeezed = F.regexp_replace(text.squish(F.col("line")), r"^\d{1,2}\[?", "")
    word = F.nullif(F.regexp_extract(squeezed, rf"^({words})SCHEDULE", 1), F.lit(""))
    number = F.array_position(constant_array(fv.SCHEDULE_WORDS), word).cast("int")
    title = F.lit(None).cast("string")
    for prefix, n, anchor_title in fv.SCHEDULE_ANCHORS:
        anchored = F.col("line").rlike(r"^\s*" + text.spaced(prefix.replace(" ", "")))
        number = F.coalesce(number, F.when(anchored, n))
        title = F.coalesce(title, F.when(word.isNull() & anchored, anchor_title))
    content = text.strip(F.regexp_replace("line", r"^\d{1,2}\*?(?=\[)", ""))
    inside = lines.filter((F.col("phase") == SCHEDULES) & ~F.col("in_note") & ~F.col("is_blank") & ~F.col("is_page"))
    inside = inside.withColumns(
        {
            "_number": F.when(F.col("is_schedule"), number),
            "_title": F.when(F.col("is_schedule"), title),
            "_content": F.when(~F.col("is_schedule"), content),
        }
    )
    out = inside.groupBy("doc_id", "schedule_no").agg(
        F.max("_number").alias("number"),
        F.max("_title").alias("title"),
        _joined("_content", "\n").alias("text"),
    )
    return out.withColumn(
        "title", F.coalesce("title", first_title(F.col("text")), F.concat(F.lit("Schedule "), F.col("number").cast("string")))
    )


def first_title(body: Column) -> Column:
    """First of the leading four lines that reads like a title."""
    heads = F.transform(F.slice(F.split(body, "\n"), 1, 4), text.strip)
    kept = F.filter(
        heads, lambda t: ~F.startswith(t, F.lit("[Articles")) & (F.length(t) > 2) & t.rlike("[a-zA-Z]")
    )
    return F.get(kept, F.lit(0))


def _preambles(lines: DataFrame) -> DataFrame:
    kept = lines.filter(
        (F.col("phase") == PREAMBLE) & ~F.col("in_note") & ~F.col("is_blank") & ~F.col("is_page")
    ).withColumn("_piece", F.regexp_replace(text.strip(F.col("line")), r"^\d{1,2}\*?(?=\[)", ""))
    return kept.groupBy("doc_id").agg(text.normalize_space(_joined("_piece")).alias("preamble"))
