"""Column expressions on prose: whitespace, marks, headings, HTML, titles."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fv
from .let import let


# ASCII blanks, the no-break ones, the other spaces of Unicode, line separators and the byte order mark.
BLANKS = " \t\n\x0b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
_ODD_BLANKS = "".join(b for b in BLANKS if b > "\x7f")
BLANK = r"[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
WORD = BLANK.replace("[", "[^", 1) + "+"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def spaced(letters: str) -> str:
    """Pattern of a literal whose characters may stand apart."""
    return r"\s*".join(re.escape(ch) for ch in letters)


def ascii_edges(pattern: str) -> str:
    r"""The pattern with every ``\b`` reading ASCII letters only.

    Java's own ``\b`` counts other letters as word characters, depending on its
    version, so that "üsch." would hide the "sch." a footnote is known by.
    """
    word = "[A-Za-z0-9_]"
    return pattern.replace(r"\b", f"(?:(?<!{word})(?={word})|(?<={word})(?!{word}))")


def plain_blanks(c: Column) -> Column:
    """Every blank beyond ASCII as a plain one, so that ``\\s`` sees them all; a class of them all is eight times slower."""
    return F.translate(c, _ODD_BLANKS, " " * len(_ODD_BLANKS))


def squish(c: Column) -> Column:
    """All whitespace removed."""
    return F.regexp_replace(plain_blanks(c), r"\s+", "")


def normalize_space(c: Column) -> Column:
    return strip(F.regexp_replace(plain_blanks(c), r"\s+", " "))


def word_count(c: Column) -> Column:
    return F.regexp_count(plain_blanks(c), F.lit(r"\S+"))


def words(c: Column) -> Column:
    return F.regexp_extract_all(plain_blanks(c), F.lit(r"\S+"), F.lit(0))


def _chain(c: Column, steps: list[tuple[str, str]]) -> Column:
    for pattern, replacement in steps:
        c = F.regexp_replace(c, pattern, replacement)
    return c


def clean_legal_text(c: Column) -> Column:
    """Editorial marks dropped, space before punctuation closed up."""
    return strip(
        _chain(
            c,
            [
                (r"\d{1,2}\s*\[", " ["),
                (r"\[\s*", " "),
                (r"\s*\]", " "),
                (r"\s+([.,;:)])", "$1"),
                (r"([(\[])\s+", "$1"),
                (r"\s+", " "),
            ],
        )
    )


def clean_title(c: Column) -> Column:
    """Brackets and marker digits dropped, one closing period unless empty."""
    bare = F.regexp_replace(normalize_space(_chain(c, [(r"\d{0,2}\[", ""), (r"\]", "")])), r"\s*\.+$", "")
    return let(bare, lambda t: F.when(t == "", t).otherwise(F.concat(t, F.lit("."))))


def visible_text(html: Column) -> Column:
    """Text a reader sees: scripts, styles, comments and tags removed."""
    return strip(
        _chain(
            html,
            [
                (r"(?i)<script[\s\S]*?</script>", ""),
                (r"(?i)<style[\s\S]*?</style>", ""),
                (r"<!--[\s\S]*?-->", ""),
                (r"<[^>]+>", " "),
                (f"{BLANK}+", " "),
            ],
        )
    )


def page_links(html: Column, extension: str | None = "pdf") -> Column:
    """Distinct href targets in page order; ``extension`` narrows to a file type."""
    tail = r"[^\"]+" if extension is None else rf"[^\"]+\.{extension}[^\"]*"
    found = F.regexp_extract_all(html, F.lit(rf'(?i)href="({tail})"'), F.lit(1))
    return F.array_distinct(F.transform(found, strip))


def phrase_number(c: Column, noun: str = "amendments?") -> Column:
    """The count in a phrase such as "106 amendments"; null when absent."""
    return F.nullif(F.regexp_extract(c, ascii_edges(rf"(?i)(\d{{1,3}})\s+{noun}\b"), 1), F.lit("")).cast("int")


def first_year(c: Column, pattern: str = fv.YEAR) -> Column:
    return F.nullif(F.regexp_extract(c, ascii_edges(pattern), 1), F.lit(""))


def trim_to_band(c: Column) -> Column:
    """40 to 60 words: cut at the last sentence end inside the band, else hard at 55."""

    def cut(head: Column) -> Column:
        # 0-based offset of the last ". "; the reversed text shows it as " .".
        back = F.instr(F.reverse(head), " .")
        last_stop = F.when(back > 0, F.length(head) - back - 1).otherwise(F.lit(-1))
        return F.when(last_stop > 200, F.substring(head, F.lit(1), last_stop + 1)).otherwise(
            F.concat(head, F.lit("."))
        )

    def band(ws: Column) -> Column:
        hard = F.concat(F.array_join(F.slice(ws, 1, 55), " "), F.lit("."))
        return F.when(F.size(ws) <= 60, F.array_join(ws, " ")).otherwise(
            let(
                let(F.array_join(F.slice(ws, 1, 60), " "), cut),
                lambda v: F.when(word_count(v) >= 40, v).otherwise(hard),
            )
        )

    return let(words(c), band)


def lede(title: Column, body: Column, explainer: Column | None = None) -> Column:
    derived = trim_to_band(F.concat(F.regexp_replace(title, r"\.$", ""), F.lit(". "), clean_legal_text(body)))
    if explainer is None:
        return derived
    return F.when(F.coalesce(explainer, F.lit("")) != "", trim_to_band(explainer)).otherwise(derived)


def strip_site_suffix(title: Column, site: str) -> Column:
    return F.regexp_replace(title, rf"\s*\|\s*{site}\s*$", "")


def clamp_title(title: Column, suffix: str, limit: int = 60) -> Column:
    """At most ``limit`` characters; a site suffix survives, the rest gives way."""
    content = F.substring(title, 1, limit - len(suffix) - 1)
    with_suffix = F.concat(F.regexp_replace(content, r"\s+$", ""), F.lit("\u2026" + suffix))
    plain = F.concat(F.regexp_replace(F.substring(title, 1, limit - 3), r"\s+$", ""), F.lit("\u2026"))
    return F.when(F.length(title) <= limit, title).when(F.endswith(title, F.lit(suffix)), with_suffix).otherwise(plain)


def clamp_description(c: Column, limit: int = 155) -> Column:
    return F.substring(c, 1, limit)


def snippet(c: Column, limit: int = 160) -> Column:
    return F.concat(F.substring(c, 1, limit), F.lit("…"))


def canonical_url(site: str, path: Column) -> Column:
    """Site plus path in its one-slash form."""
    bare = F.regexp_replace(path, r"^/+|/+$", "")
    return F.when(bare == "", F.lit(site + "/")).otherwise(F.concat(F.lit(site + "/"), bare, F.lit("/")))


def sentence_case(c: Column) -> Column:
    lowered = F.lower(c)
    return F.concat(F.upper(F.substring(lowered, 1, 1)), F.substring(lowered, F.lit(2), F.length(lowered)))


def display_date(c: Column) -> Column:
    return F.date_format(c, "d MMMM yyyy")


def similarity_tokens(c: Column) -> Column:
    """Distinct lower-case words longer than one character, marks removed."""
    plain = _chain(F.lower(c), [(r"\d{1,2}\[", " "), (r"[\]\[()“”\".,;:—⎯–-]", " ")])
    return F.array_distinct(F.filter(words(plain), lambda w: F.length(w) > 1))


def search_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9]+"), F.lit(0))


# --- structure of a line ------------------------------------------------------


def dash_normalized(line: Column) -> Column:
    """Leading ornaments dropped, ".-" read as a title dash."""
    return _chain(line, [(r"(\.)\s*-\s*", "$1\u2014 "), (r"^[\uE000-\uF8FF]+", ""), (r"^\[(?=\d)", "")])


def split_marker(line: Column) -> tuple[Column, Column]:
    """(text without its leading footnote marker, marker number or null)."""
    base = dash_normalized(line)
    marker = F.nullif(F.regexp_extract(base, fv.MARKER, 1), F.lit("")).cast("int")
    return F.regexp_replace(base, fv.MARKER, ""), marker


def is_footnote_line(line: Column) -> Column:
    return line.rlike(fv.FOOTNOTE_START) | (line.rlike(fv.FOOTNOTE_NUMBER) & line.rlike(ascii_edges(fv.FOOTNOTE_SIGNAL)))


def structural_text(line: Column) -> Column:
    return _chain(F.upper(squish(line)), [(r"^\d{1,2}\[?", ""), (r"\]+$", "")])


def dash_position(line: Column) -> Column:
    """1-based position of the first title dash, 0 when there is none."""
    found = F.regexp_extract(line, rf"^([^{fv.TITLE_DASHES}]*)[{fv.TITLE_DASHES}]", 0)
    return F.length(found)


def before_dash(line: Column) -> Column:
    return F.regexp_replace(line, rf"[{fv.TITLE_DASHES}][\s\S]*$", "")


def after_dash(line: Column) -> Column:
    """Text behind the first title dash, blanks trimmed; '' without a dash."""
    return strip(F.regexp_extract(line, rf"^[^{fv.TITLE_DASHES}]*[{fv.TITLE_DASHES}]([\s\S]*)$", 1))


def strip_leading_dashes(c: Column) -> Column:
    return F.regexp_replace(c, rf"^[{fv.TITLE_DASHES}]+\s*", "")


def looks_like_section_heading(line: Column) -> Column:
    return let(strip(line), _section_heading_shape)


def _section_heading_shape(t: Column) -> Column:
    return (
        (F.length(t) > 2)
        & (F.length(t) < 60)
        & ~t.rlike(r"[.,;:\]]$")
        & ~F.contains(t, F.lit(";"))
        & t.rlike(r"^[A-Z]")
        & t.rlike(r"[a-z]")
    )


def heading_title_body(rest: Column) -> tuple[Column, Column]:
    """Title up to the first ",--", "--", " - " or " -danda"; the rest opens the body."""
    pattern = r"^([\s\S]*?)(?:,--|--|\s-\s|\s-।)([\s\S]*)$"
    title = F.when(rest.rlike(pattern), strip(F.regexp_extract(rest, pattern, 1))).otherwise(
        strip(F.regexp_replace(rest, r"[-–]$", ""))
    )
    return title, strip(F.regexp_extract(rest, pattern, 2))


def pick_url_path(url: Column) -> Column:
    """Path of a URL without query and fragment, '/' when empty."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    return F.when(path == "", F.lit("/")).otherwise(path)


def meta_description(html: Column) -> Column:
    """Content of the page's description, null without one."""
    pattern = r'(?i)<meta\s+name="description"\s+content="([^"]*)"'
    return F.when(html.rlike(pattern), F.regexp_extract(html, pattern, 1))


def shown_length(c: Column) -> Column:
    """Characters as a reader sees them: a character reference is one."""
    return F.length(F.regexp_replace(c, r"&(?:#\d+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);", "_"))


def html_title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?i)<title>([^<]*)</title>", 1)


def page_tokens(text: Column, letterless: str = r"^[\s|.,;:()\[\]'\"–—]+$") -> Column:
    """Array of (line, word); a token of pure punctuation joins the word before it."""
    raw = F.flatten(
        F.transform(
            F.split(text, "\n"),
            lambda l, i: F.transform(words(l), lambda w: F.struct(i.alias("line"), w.alias("word"))),
        )
    )

    # a blank in front of every word that stays one: words hold none, so one split gives them whole
    def glue(tokens: Column) -> Column:
        joined = F.array_join(F.transform(tokens, lambda t: F.when(t["head"], F.concat(F.lit(" "), t["word"])).otherwise(t["word"])), "")

        def build(parts: Column) -> Column:
            heads = F.filter(tokens, lambda t: t["head"])
            return F.transform(heads, lambda t, k: F.struct(t["line"].alias("line"), F.get(parts, k + 1).alias("word")))

        return let(F.split(joined, " "), build)

    def marked(tokens: Column) -> Column:
        head = lambda t, i: (i == 0) | ~t["word"].rlike(letterless)
        return F.transform(tokens, lambda t, i: F.struct(t["line"].alias("line"), t["word"].alias("word"), head(t, i).alias("head")))

    return let(marked(raw), glue)
