"""Column expressions on Devanagari: audit, repair, skeletons, suffixes, clauses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fv
from .let import constant_map, let, offsets
from .text import strip
from .word_repair import repair_words

_SIGN = f"[{fv.VOWEL_SIGNS}]"
_DEVA = r"[\u0900-\u097F]"
# Characters that end the search for a word start without being blank.
_STOP = r"\u0900-\u097F\u1CD0-\u1CFF.,;:()\[\]\"'\d"
SIGN_AFTER_SIGN = f"(?<=[{fv.VOWEL_SIGNS}{fv.VIRAMA}]){_SIGN}|(?<={_SIGN}){fv.NUKTA}"
RULES = {
    "replacement": "\uFFFD",
    "private-use": r"[\uE000-\uF8FF]",
    "zwnj": "\u200C",
    "pipe-danda": rf"(?<={_DEVA}\s{{0,2}})\||\|(?=\s{{0,2}}{_DEVA})",
    "sign-at-start": rf"(?:^|\s)[^\s{_STOP}]*{_SIGN}",
    "sign-after-sign": SIGN_AFTER_SIGN,
}
_SUSPECT = rf"[\uFFFD\uE000-\uF8FF\u200C|{fv.VOWEL_SIGNS}{fv.NUKTA}]"


def rule_count(text: Column, rule: str) -> Column:
    return F.regexp_count(text, F.lit(RULES[rule]))


def issue_count(text: Column) -> Column:
    total = F.lit(0)
    for rule in RULES:
        total = total + rule_count(text, rule)
    return F.when(text.rlike(_SUSPECT), total).otherwise(F.lit(0))


# A control character in front of each offence, by rule. The order matters: a
# mark between blank and letter would hide a later pipe or sign from its rule.
_MARKS = [
    ("pipe-danda", "\u0001", RULES["pipe-danda"], "$0"),
    ("replacement", "\u0002", RULES["replacement"], "$0"),
    ("private-use", "\u0003", RULES["private-use"], "$0"),
    ("zwnj", "\u0004", RULES["zwnj"], "$0"),
    ("sign-after-sign", "\u0005", SIGN_AFTER_SIGN, "$0"),
    ("sign-at-start", "\u0006", rf"((?:^|\s)[^\s{_STOP}]*)({_SIGN})", "$2"),
]


#: Characters of a block that excerpts are cut from.
_EXCERPT_BLOCK = 64


def has_issue(text: Column) -> Column:
    """Whether a text has an issue; the first one found ends the search."""
    found = F.lit(False)
    for pattern in RULES.values():
        found = found | text.rlike(pattern)
    return text.rlike(_SUSPECT) & found


def issues(text: Column) -> Column:
    """Array of (index, rule, excerpt), index 0-based; empty for sound text.

    Offences are marked by one pass per rule and the marked text is split once;
    an excerpt is cut from one or two short blocks of the text, so the work grows
    with the text, not with its square.
    """
    empty = F.array().cast("array<struct<index:int,rule:string,excerpt:string>>")

    def scan(t: Column) -> Column:
        marked = F.regexp_replace(t, "[\u0001-\u0006]", " ")
        for _, mark, pattern, offence in _MARKS:
            lead = "$1" if offence == "$2" else ""
            marked = F.regexp_replace(marked, pattern, f"{lead}{mark}{offence}")
        pieces = F.split(marked, "(?=[\u0001-\u0006])")
        names = F.create_map(*[F.lit(x) for rule, mark, _, _ in _MARKS for x in (mark, rule)])

        def rule_of(piece: Column) -> Column:
            return names[F.substring(piece, 1, 1)]

        def collect(v: Column) -> Column:
            starts = offsets(
                F.transform(v["pieces"], lambda p: F.length(p) - F.when(rule_of(p).isNotNull(), 1).otherwise(0))
            )

            def entry(piece: Column, at: Column) -> Column:
                first = F.greatest(at - 3, F.lit(1))
                block = F.floor((first - 1) / _EXCERPT_BLOCK).cast("int")
                around = F.concat(F.get(v["blocks"], block), F.coalesce(F.get(v["blocks"], block + 1), F.lit("")))
                return F.struct(
                    at.alias("index"),
                    rule_of(piece).alias("rule"),
                    F.substring(around, first - block * _EXCERPT_BLOCK, at + 6 - first).alias("excerpt"),
                )

            found = let(
                starts,
                lambda s: F.transform(
                    v["pieces"], lambda p, i: F.when(rule_of(p).isNotNull(), entry(p, F.get(s, i)))
                ),
            )
            return F.filter(found, lambda f: f.isNotNull())

        blocks = F.regexp_extract_all(t, F.lit(f"(?s).{{1,{_EXCERPT_BLOCK}}}"), F.lit(0))
        parts = F.struct(pieces.alias("pieces"), blocks.alias("blocks"))
        return F.when(has_issue(t), let(parts, collect)).otherwise(empty)

    return let(text, scan)


def restore_danda(text: Column) -> Column:
    """A pipe next to Devanagari is a misread danda."""
    return F.regexp_replace(
        F.regexp_replace(text, rf"({_DEVA})\s*\|", "$1 \u0964"), rf"\|\s*({_DEVA})", "\u0964 $1"
    )


def repair(text: Column) -> Column:
    """Displaced signs move one consonant right when that lowers the issue count; issues never cross blanks."""
    return repair_words(restore_danda(F.regexp_replace(text, "\u200C", "")))


def skeleton(word: Column) -> Column:
    """Letters of the script only."""
    return F.regexp_replace(word, f"[^{fv.SKELETON_CLASS}]", "")


def similar(a: Column, b: Column) -> Column:
    """Same word misspelled: distance within max(2, a third of the shorter)."""
    bound = F.greatest(F.lit(2), F.floor(F.least(F.length(a), F.length(b)) / 3).cast("int"))
    return ((a == "") & (b == "")) | (F.levenshtein(a, b) <= bound)


def script_share(text: Column, char_class: str = _DEVA) -> Column:
    return F.regexp_count(text, F.lit(char_class)) / F.greatest(F.length(text), F.lit(1))


def latin_suffix(suffix: Column) -> Column:
    """Consonants by alphabet position to Latin letters; null beyond the 26th."""
    latin = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    mapped = F.translate(suffix, fv.SUFFIX_CONSONANTS, latin)
    return F.when(mapped.rlike("^[A-Z]*$"), mapped)


def latin_number(number: Column) -> Column:
    digits = F.regexp_extract(number, r"^(\d*)", 1)
    return F.concat(digits, latin_suffix(F.regexp_replace(number, r"^\d*", "")))


def number_candidates(number: Column) -> Column:
    """The number as read, its 3- and 2-digit tails, and suffix look-alikes, in trust order."""
    digits = F.regexp_extract(number, r"^(\d*)", 1)
    suffix = F.regexp_replace(number, r"^\d*", "")

    def tail(k: int) -> Column:
        return F.concat(F.when(F.length(digits) > k, F.substring(digits, -k, k)).otherwise(digits), suffix)

    def variants(k: int) -> Column:
        """Look-alikes of the k-th suffix letter."""
        ch = F.substring(suffix, k, 1)
        swapped = F.array(
            *[
                F.when(
                    ch == src,
                    F.concat(digits, F.substring(suffix, 1, k - 1), F.lit(dst), F.substring(suffix, F.lit(k + 1), F.length(suffix))),
                )
                for src, dst in fv.SUFFIX_CONFUSIONS
            ]
        )
        return F.filter(swapped, lambda v: v.isNotNull())

    return F.array_distinct(F.concat(F.array(number, tail(3), tail(2)), variants(1), variants(2)))


_MID = r"^((?:\S+\s+){0,4})\[?(\d{1,4}[\u0915-\u0939]{0,2}[.\u0964]\s+\S.*)$"
_WIDE = r"^((?:\S+\s+){0,7})\[?(\d{2,4}[\u0915-\u0939]{0,2}[.\u0964]\s+\S.*)$"
_HEADING_SHAPE = r"^(\d{1,4})([\u0915-\u0939]{1,2})?[.\u0964]\s+(.+)$"


def _any_signal(c: Column) -> Column:
    return c.rlike("|".join(fv.FOOTNOTE_SIGNALS_HI))


def _split_prefix(line: Column) -> Column:
    """Struct(prefix, body): words carried in front of a number, and the rest."""

    def group(pattern: str) -> Column:
        return F.struct(
            strip(F.regexp_extract(line, pattern, 1)).alias("prefix"), F.regexp_extract(line, pattern, 2).alias("body")
        )

    return (
        F.when(line.rlike(_MID), group(_MID))
        .when(line.rlike(_WIDE), group(_WIDE))
        .otherwise(F.struct(F.lit("").alias("prefix"), line.alias("body")))
    )


def _heading_parts(split: Column) -> Column:
    part = [F.regexp_extract(split["body"], _HEADING_SHAPE, i) for i in (1, 2, 3)]
    return F.when(
        split["body"].rlike(_HEADING_SHAPE),
        F.struct(
            part[0].alias("digits"), part[1].alias("suffix"), part[2].alias("rest"), split["prefix"].alias("prefix")
        ),
    )


def _accepted_heading(h: Column, suffix_map: dict[str, str] | None = None) -> Column:
    digits = h["digits"]
    smallest = F.least(*[x.try_cast("int") for x in (digits, F.right(digits, F.lit(3)), F.right(digits, F.lit(2)))])
    ok = (
        (F.length(h["rest"]) >= 3)
        & (smallest <= fv.MAX_ITEM_NUMBER)
        & ~((F.length(digits) == 1) & _any_signal(h["rest"]))
    )
    printed, latin = F.concat(digits, h["suffix"]), F.concat(digits, latin_suffix(h["suffix"]))
    if suffix_map:
        # digits as printed, then their 3- and 2-digit tails: a marker may be fused onto the number
        known = constant_map(suffix_map)
        tails = [F.concat(d, h["suffix"]) for d in (digits, F.right(digits, F.lit(3)), F.right(digits, F.lit(2)))]
        mapped = F.coalesce(*[F.when(F.map_contains_key(known, t), t) for t in tails])
        printed, latin = F.coalesce(mapped, printed), F.coalesce(F.try_element_at(known, mapped), latin)
    return F.when(
        ok,
        F.struct(
            printed.alias("number_hi"),
            latin.alias("latin"),
            h["rest"].alias("rest"),
            F.when(h["prefix"] == "", "").otherwise(F.concat(h["prefix"], F.lit(" "))).alias("prefix"),
        ),
    )


def heading(line: Column, suffix_map: dict[str, str] | None = None) -> Column:
    """Struct(number_hi, latin, rest, prefix) of an item heading, null for other lines.

    ``suffix_map`` names numbers whose Latin form is known; others are read by the position of their suffix letters.
    """
    stripped = F.regexp_replace(strip(line), r"^[\[(\u0964\]\s]+", "")
    parsed = let(let(let(stripped, _split_prefix), _heading_parts), lambda h: _accepted_heading(h, suffix_map))
    # most lines have no dotted number; the shapes, which look for one behind a few words, are spared them
    return F.when(line.rlike(r"\d[\u0915-\u0939]{0,2}[.\u0964]\s"), parsed)


def line_kind(line: Column) -> Column:
    """body, footnote or furniture."""
    return let(strip(line), _kind_of)


def _kind_of(t: Column) -> Column:
    furniture = (
        t.rlike(r"^भारत का संविधान\s*\d*$")
        | (t == "THE CONSTITUTION OF INDIA")
        | t.rlike(r"^\d{1,3}$")
        | (t.rlike(r"^\(भाग\s") & t.rlike(r"\)\s*\d*$"))
    )
    return F.when(furniture, "furniture").when(t.rlike(r"^\d[.।]\s") & _any_signal(t), "footnote").otherwise("body")


_CUT = "\u0001"


def _with_heading_cut(text: Column, word: str, tag: str) -> Column:
    """A cut before the first heading word when a boundary precedes it."""
    return let(text, lambda marked: _heading_cut(marked, word, tag))


def _heading_cut(marked: Column, word: str, tag: str) -> Column:
    head = rf"^([\s\S]*?)(?:^|\s)((?:{word})[-\s])"
    lead = F.regexp_extract(marked, head, 1)
    at_boundary = lead.rlike(r"(?:^\[?|[।;:,–—\]\-)]\[?|और\[?)$")
    found = marked.rlike(rf"(?:^|\s)(?:{word})[-\s]")
    return F.when(found & at_boundary, F.regexp_replace(marked, head, f"$1{_CUT}\u0002{tag}$2")).otherwise(marked)


def inline_clauses(text: Column) -> Column:
    """Flowing text cut at enumerations that follow a boundary.

    Array of (number, text, kind). A cut is written into the text as a control
    character, so one split yields the pieces; the marker stays at the head of
    its piece and is parsed off there.
    """
    cleaned = strip(F.regexp_replace(F.regexp_replace(text, r"\(\s*[|।]?\s*\)\s*", " "), r"\s+", " "))
    # Text is single spaced here, so one optional blank and bracket suffice.
    boundary = r"(?:^\[?|(?<=[।;:,–—\]\-)])\s?\[?|(?<=और)\s?\[?)"
    marked = F.regexp_replace(
        cleaned, rf"({boundary})(\((?:\d{{1,2}}[क-ह]?|[क-ह])\))", f"{_CUT}$2"
    )
    # Only the first explanation and the first illustration are headings.
    for word, tag in (("स्पष्टीकरण", "E"), ("उदाहरण|दृष्टांत", "I")):
        marked = _with_heading_cut(marked, word, tag)
    piece_number = r"^\((\d{1,2}[क-ह]?|[क-ह])\)"

    def clause(piece: Column) -> Column:
        kind = (
            F.when(F.startswith(piece, F.lit("\u0002E")), "explanation")
            .when(F.startswith(piece, F.lit("\u0002I")), "illustration")
            .otherwise("clause")
        )
        number = F.nullif(F.regexp_extract(piece, piece_number, 1), F.lit(""))
        body = F.regexp_replace(F.regexp_replace(piece, "^\u0002[EI]", ""), rf"{piece_number}\s*", "")
        body = F.when(
            number.isNotNull() | (kind != "clause"), F.regexp_replace(body, r"^[-–—\s]+", "")
        ).otherwise(body)
        return F.struct(
            number.alias("number"),
            strip(F.regexp_replace(body, r"[\s;]+$", "")).alias("text"),
            kind.alias("kind"),
        )

    return F.filter(F.transform(F.split(marked, _CUT), clause), lambda s: s["text"] != "")
