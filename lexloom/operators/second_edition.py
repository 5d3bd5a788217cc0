"""Second-edition segmentation as one job: page lines to items, against the numbers of the first edition.

A heading offers several numbers in trust order: as printed, its digit tails (a marker fused onto it) and look-alikes of
its suffix. The first edition's numbers are a whitelist, and document order a cursor; the first candidate that passes both
is the item's number. What one of them refuses goes to review, what both refuse is apparatus. Words in front of a number
belong to the item before it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import script, text
from ..functions.let import constant_map
from ..session import checkpointed
from .aggregate import first_per_key
from .walk import first_above, sort_text

#: Events of a line: an anchor per entry of the list, then the heading.
_EVENTS = 64


@dataclass(frozen=True)
class Anchor:
    """A heading whose number is lost: the number and title to use where a page's line has the pattern."""

    number: str
    page: int
    pattern: str
    title: str


class Edition:
    """``items`` and ``review`` of a walked edition; each reads the walked rows once."""

    def __init__(self, met: DataFrame):
        self._met = met

    @property
    def items(self) -> DataFrame:
        """(doc_id, number, number_hi, title, text, page): items in document order of their numbers.

        The text is the heading's rest behind the title, the body lines up to the next accepted heading, and the words in
        front of that heading's number, joined by blanks. A document's numbers are distinct, for the cursor only rises.
        """
        title, head = text.heading_title_body(F.col("rest"))
        taken, kind = F.col("taken").isNotNull(), self._met.schema["page"].dataType

        def piece(item: Column, words: Column, *told: Column) -> Column:
            fields = told or [F.lit(None).cast("string")] * 3 + [F.lit(None).cast(kind)]
            names = ("number", "number_hi", "title", "page")
            return F.struct(item.alias("item"), *(f.alias(n) for f, n in zip(fields, names)), F.col("at"), words.alias("piece"))

        opens = piece(F.col("at"), head, F.col("picked.latin"), F.col("picked.number_hi"), title, F.col("page"))
        inside = F.col("before").isNotNull()
        body = F.col("rest").isNull() & F.col("line").isNotNull()
        pieces = F.array_compact(
            F.array(
                F.when(taken, opens),
                F.when(taken & inside, piece(F.col("before"), text.strip(F.col("prefix")))),
                F.when(body & inside, piece(F.col("before"), F.col("line"))),
            )
        )
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda s: s["piece"])
        whole = self._met.select("doc_id", F.inline(pieces)).groupBy("doc_id", "item").agg(
            *(F.max(c).alias(c) for c in ("number", "number_hi", "title", "page")), ordered.alias("pieces")
        )
        # a head without text takes no separator
        kept = F.when(F.get("pieces", F.lit(0)) == "", F.slice("pieces", 2, F.greatest(F.size("pieces") - 1, F.lit(0)))).otherwise(F.col("pieces"))
        return whole.select("doc_id", "number", "number_hi", "title", F.array_join(kept, " ").alias("text"), "page")

    @property
    def review(self) -> DataFrame:
        """(doc_id, page, line_no, latin, line): headings that either the whitelist or the order refuses, not both."""
        in_order = F.coalesce(sort_text(F.col("latin")) > F.col("cursor"), F.lit(False))
        refused = self._met.where("taken is null and latin is not null").where(F.col("listed") | in_order)
        return refused.select("doc_id", "page", "line_no", "latin", "line")


def walked_edition(
    lines: DataFrame,
    whitelist: DataFrame,
    anchors: Sequence[Anchor] = (),
    suffix_map: dict[str, str] | None = None,
    blocks: int | None = None,
) -> Edition:
    """Items and review rows of ``lines`` (doc_id, page, line_no, line), numbers gated by ``whitelist`` (number).

    Lines are in order of ``line_no``, unique in a document. ``anchors`` fire at their line before its own heading, in
    their order; they need not be on the whitelist. ``suffix_map`` overrides the reading of numbers by position.
    Blank lines, page furniture and footnotes are left out. Only narrow rows are walked; the text is joined by its line.
    Headings are looked for once and written with their lines, which offers, anchors and the walk's passes all read.
    """
    line = text.strip(script.restore_danda(F.col("line")))
    read = lines.select("doc_id", "page", F.col("line_no").cast("long").alias("line_no"), line.alias("line")).where("line <> ''")
    body = script.line_kind(F.col("line")) == "body"
    read = read.withColumn("heading", F.when(body, script.heading(F.col("line"), suffix_map))).withColumn("is_body", body)
    read = checkpointed(read)
    at = F.col("line_no") * _EVENTS

    numbers = script.number_candidates(F.col("heading.number_hi"))
    candidates = F.transform(
        numbers,
        lambda n: F.struct(
            n.alias("number_hi"),
            F.when(n == F.col("heading.number_hi"), F.col("heading.latin")).otherwise(script.latin_number(n)).alias("latin"),
        ),
    )
    place = F.posexplode(candidates).alias("trust", "c")
    offered = read.where("heading is not null").select("doc_id", "line_no", place).select("doc_id", "line_no", "trust", "c.*")
    known = whitelist.select(F.col("number").alias("latin")).where("latin is not null").distinct()
    listed = offered.join(known, "latin").withColumn("key", sort_text(F.col("latin"))).where("key is not null")
    gathered = listed.groupBy("doc_id", "line_no").agg(F.array_sort(F.collect_list(F.struct("trust", "key", "latin", "number_hi"))).alias("offers"))

    plain = read.where("is_body or heading is not null").join(gathered, ["doc_id", "line_no"], "left")
    own = F.exists(F.coalesce("offers", F.array().cast("array<struct<trust:int,key:string,latin:string,number_hi:string>>")), lambda o: o["trust"] == 0)
    rows = plain.select(
        "doc_id",
        "page",
        "line_no",
        (at + _EVENTS - 1).alias("at"),
        "line",
        F.col("heading.latin").alias("latin"),
        F.col("heading.rest").alias("rest"),
        F.coalesce("heading.prefix", F.lit("")).alias("prefix"),
        own.alias("listed"),
        F.transform("offers", lambda o: F.struct(o["key"].alias("key"), o["latin"].alias("latin"), o["number_hi"].alias("number_hi"))).alias("offers"),
    )
    if anchors:
        if len(anchors) >= _EVENTS:
            raise ValueError(f"at most {_EVENTS - 1} anchors")
        fires = F.array_compact(
            F.array(
                *(
                    F.when(
                        (F.col("page") == a.page) & F.col("line").rlike(a.pattern),
                        F.struct(F.lit(i).alias("seq"), F.lit(a.number).alias("number"), F.lit(f"{a.title}--").alias("rest")),
                    )
                    for i, a in enumerate(anchors)
                )
            )
        )
        hit = read.where(F.size(fires) > 0).select("doc_id", "page", "line_no", "line", F.explode(fires).alias("a"))
        key = sort_text(F.col("a.number"))
        given = F.struct(key.alias("key"), F.col("a.number").alias("latin"), F.col("a.number").alias("number_hi"))
        rows = rows.union(
            hit.select(
                "doc_id", "page", "line_no", (at + F.col("a.seq")).alias("at"), F.lit(None).cast("string").alias("line"), F.lit(None).cast("string").alias("latin"), F.col("a.rest"), F.lit("").alias("prefix"), F.lit(False).alias("listed"), F.array(given).alias("offers")
            )
        )
    keys = F.transform("offers", lambda o: o["key"])
    walk = first_above(rows.select("doc_id", "at", keys.alias("keys")), "doc_id", "at", "keys", blocks)
    met = rows.join(walk, ["doc_id", "at"]).withColumn(
        "picked", F.get(F.filter("offers", lambda o: o["key"] == F.col("taken")), F.lit(0))
    )
    return Edition(met)


def clean_text(c: Column) -> Column:
    """Displaced signs, misread dandas and joiners mended, blanks squeezed."""
    return text.normalize_space(script.repair(c))


_PART = r"^\[?भाग\s+(\d{1,2})([क-ह]{1,2})?\]?$"


def edition_parts(lines: DataFrame, whitelist: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, number, number_hi, name, page): the first heading of every part of ``whitelist`` (number) that is named.

    ``lines`` (doc_id, page, line_no, line). The name is the first usable one of the two lines below on the same page;
    ``names`` overrides names that were verified by hand. A part's label inside a schedule is not on the whitelist.
    """
    rows = lines.withColumn("_line", text.strip(F.col("line")))
    shown = text.strip(F.regexp_replace("_line", r"\.+$", ""))
    usable = (F.length(shown) > 0) & ~shown.rlike(r"^भाग\s") & script.heading(shown).isNull() & (script.line_kind(shown) == "body")
    page = W.partitionBy("doc_id", "page").orderBy("line_no")
    name = F.when(usable, shown)
    near = F.coalesce(F.lead(name, 1).over(page), F.lead(name, 2).over(page))
    digits, suffix = F.regexp_extract("_line", _PART, 1), F.coalesce(F.regexp_extract("_line", _PART, 2), F.lit(""))
    found = rows.select("doc_id", "page", "line_no", "_line", near.alias("name")).where(F.col("_line").rlike(_PART))
    number_hi = F.concat(digits, suffix)
    headed = found.select("doc_id", "page", "line_no", number_hi.alias("number_hi"), script.latin_number(number_hi).alias("number"), "name")
    listed = headed.where(F.length("name") >= 3).join(whitelist.select("number").distinct(), "number", "left_semi")
    first = first_per_key(listed, ["doc_id", "number"], [F.col("page"), F.col("line_no")])
    verified = F.coalesce(F.try_element_at(constant_map(names), F.col("number")), "name") if names else F.col("name")
    return first.select("doc_id", "number", "number_hi", verified.alias("name"), "page")


def assembled(
    items: DataFrame,
    first: DataFrame,
    titles: dict[str, str] | None = None,
    missing_title: str = "",
    missing_text: str = "",
) -> DataFrame:
    """The second edition's items beside the first's: (doc_id, number, number_hi, part, status, amended_by, title, clauses,
    page, printed, place).

    ``items`` as of ``Edition.items``, ``first`` (doc_id, number, part, status, amended_by). Texts are mended and cut in
    clauses; part, status and amendments come from the first edition, which carries the same items; ``titles`` overrides
    titles that were verified by hand. An item that only the first edition has stands in with the given title and text
    and page 0. ``place`` sorts a document's items.
    """
    title = clean_text(F.col("title"))
    if titles:
        title = F.coalesce(F.try_element_at(constant_map(titles), F.col("number")), title)
    printed = items.select(
        "doc_id", "number", "number_hi", title.alias("title"), script.inline_clauses(clean_text(F.col("text"))).alias("clauses"), "page", F.lit(True).alias("printed")
    )
    kind = printed.schema["clauses"].dataType
    stand_in = F.array(F.struct(F.lit(None).cast("string").alias("number"), F.lit(missing_text).alias("text"), F.lit("clause").alias("kind")))
    both = printed.join(first, ["doc_id", "number"], "full_outer")
    none = F.array().cast("array<string>")
    return both.select(
        "doc_id",
        "number",
        F.coalesce("number_hi", "number").alias("number_hi"),
        F.coalesce("part", F.lit("")).alias("part"),
        F.coalesce("status", F.lit("in-force")).alias("status"),
        F.coalesce("amended_by", none).alias("amended_by"),
        F.coalesce("title", F.lit(missing_title)).alias("title"),
        F.coalesce("clauses", stand_in.cast(kind)).alias("clauses"),
        F.coalesce("page", F.lit(0)).alias("page"),
        F.coalesce("printed", F.lit(False)).alias("printed"),
        sort_text(F.col("number")).alias("place"),
    )
