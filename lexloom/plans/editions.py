"""Queries on a second edition whose numbers are gated by the first."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.let import constant_array
from ..operators.second_edition import Anchor, Edition, assembled, edition_parts, walked_edition
from ..sources.tables import spread
from .registry import Tables, query

PAGE_LINES = 40
SUFFIXES = ["", "A", "B", "ZH", "E"]
ANCHORS = [
    Anchor("7", 0, "क ।", "First lost title"),
    Anchor("60", 1, "th", "Second lost title"),
    Anchor("150A", 2, "e", "Third lost title"),
]


def _shaped(doc: Column, line: Column, i: Column) -> Column:
    """Every line of a document, kept whole, in the shape of a second edition's line its position selects."""
    shape, s = (doc * 31 + i * 17 + 3) % 18, F.lit
    number = (i * 2 + doc % 5 + 1).cast("string")
    short = F.substring(line, 1, 24)
    forms = [
        F.concat(number, s(". "), short, s("--"), line),
        F.concat(number, s("क. "), short, s(" - "), line),
        F.concat(s("4"), number, s(". "), short, s(",--"), line),
        F.concat(s("और ["), number, s("। "), line),
        F.concat(number, s("यझ. "), line),
        F.concat(s("1. अधिनियम "), line),
        F.concat(i.cast("string"), s("\n"), line),
        F.concat(s("(भाग "), number, s(")\n"), line),
        F.concat(s("क | "), line, s(" |ख")),
        F.concat(s("एक दो तीन चार पांच छह "), (i * 2 + doc % 5 + 11).cast("string"), s(". "), line),
        F.concat((i % 7 + 1).cast("string"), s(". "), line),
        F.concat(s("THE CONSTITUTION OF INDIA\n"), line),
        F.concat(number, s("ङ. "), line),
        F.concat(s("["), number, s("ख. "), short, s(" -। "), line),
        F.concat(s("[भाग "), (i % 30 + 1).cast("string"), F.element_at(constant_array(["", "क", "ख"]), (doc % 3 + 1).cast("int")), s("]\n"), line),
    ]
    out = F.when(shape == 0, forms[0])
    for k, form in enumerate(forms[1:], 1):
        out = out.when(shape == k, form)
    return out.otherwise(line)


def edition_lines(t: Tables) -> DataFrame:
    """(doc_id, page, line_no, line)"""
    shaped = F.transform(F.split("text", "\n"), lambda l, i: _shaped(F.col("doc_id"), l, i.cast("long")))
    lines = F.split(F.array_join(shaped, "\n"), "\n")
    rows = spread(t.documents.select("doc_id", "text")).select("doc_id", F.posexplode(lines).alias("line_no", "line"))
    return rows.select("doc_id", F.floor(F.col("line_no") / PAGE_LINES).cast("int").alias("page"), "line_no", "line")


def whitelist(t: Tables) -> DataFrame:
    """(number): numbers with suffixes, a few hundred at most."""
    suffix = F.element_at(constant_array(SUFFIXES), (F.floor(F.col("p_partkey") / 400) % 5 + 1).cast("int"))
    return t.part.select(F.concat((F.col("p_partkey") % 400 + 1).cast("string"), suffix).alias("number")).distinct()


def _edition(t: Tables) -> Edition:
    return walked_edition(edition_lines(t), whitelist(t), ANCHORS)


@cache
def _edition_sql(select: str) -> str:
    """The walk as a recursive query over the events of every document."""
    mid = r"^((?:\S+\s+){0,4})\[?(\d{1,4}[क-ह]{0,2}[.।]\s+\S.*)$"
    wide = r"^((?:\S+\s+){0,7})\[?(\d{2,4}[क-ह]{0,2}[.।]\s+\S.*)$"
    head = r"^(\d{1,4})([क-ह]{1,2})?[.।]\s+(.+)$"
    deva = r"\x{0900}-\x{097F}"
    signals = "|".join(fv.FOOTNOTE_SIGNALS_HI)
    latin = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    confused = ", ".join(
        f"CASE WHEN substr(sfx, {k}, 1) = '{a}' THEN digits || substr(sfx, 1, {k - 1}) || '{b}' || substr(sfx, {k + 1}) END"
        for k in (1, 2)
        for a, b in fv.SUFFIX_CONFUSIONS
    )
    anchors = " UNION ALL ".join(
        f"""SELECT doc_id, page, line_no, {i} AS seq, NULL AS line, NULL AS latin, '{a.title}--' AS rest, '' AS prefix, false AS listed,
          [{{'trust': 0::BIGINT, 'key': lpad('{a.number.rstrip(latin)}', 12, '0') || '{a.number.lstrip("0123456789")}', 'latin': '{a.number}', 'number_hi': '{a.number}'}}] AS offers
        FROM read WHERE page = {a.page} AND regexp_matches(line, '{a.pattern}')"""
        for i, a in enumerate(ANCHORS)
    )
    return rf"""WITH RECURSIVE raw AS (
          SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
        shaped AS (
          SELECT doc_id, i, l, (doc_id * 31 + i * 17 + 3) % 18 AS shape, CAST(i * 2 + doc_id % 5 + 1 AS VARCHAR) AS num, substr(l, 1, 24) AS short FROM raw),
        texts AS (
          SELECT doc_id, string_split(string_agg(CASE shape
            WHEN 0 THEN num || '. ' || short || '--' || l
            WHEN 1 THEN num || 'क. ' || short || ' - ' || l
            WHEN 2 THEN '4' || num || '. ' || short || ',--' || l
            WHEN 3 THEN 'और [' || num || '। ' || l
            WHEN 4 THEN num || 'यझ. ' || l
            WHEN 5 THEN '1. अधिनियम ' || l
            WHEN 6 THEN CAST(i AS VARCHAR) || chr(10) || l
            WHEN 7 THEN '(भाग ' || num || ')' || chr(10) || l
            WHEN 8 THEN 'क | ' || l || ' |ख'
            WHEN 9 THEN 'एक दो तीन चार पांच छह ' || CAST(i * 2 + doc_id % 5 + 11 AS VARCHAR) || '. ' || l
            WHEN 10 THEN CAST(i % 7 + 1 AS VARCHAR) || '. ' || l
            WHEN 11 THEN 'THE CONSTITUTION OF INDIA' || chr(10) || l
            WHEN 12 THEN num || 'ङ. ' || l
            WHEN 13 THEN '[' || num || 'ख. ' || short || ' -। ' || l
            WHEN 14 THEN '[भाग ' || CAST(i % 30 + 1 AS VARCHAR) || (['', 'क', 'ख'])[doc_id % 3 + 1] || ']' || chr(10) || l
            ELSE l END, chr(10) ORDER BY i), chr(10)) AS rows FROM shaped GROUP BY doc_id),
        lines AS (SELECT doc_id, unnest(rows) AS raw_line, unnest(range(len(rows))) AS line_no FROM texts),
        read AS (
          SELECT * FROM (SELECT doc_id, CAST(line_no // {PAGE_LINES} AS INTEGER) AS page, line_no, regexp_replace(regexp_replace(regexp_replace(raw_line,
            '([{deva}])\s*\|', '\1 ।', 'g'), '\|\s*([{deva}])', '। \1', 'g'), '^\s+|\s+$', '', 'g') AS line FROM lines) WHERE line <> ''),
        bodies AS (
          SELECT *, regexp_replace(line, '^[\[(।\]\s]+', '') AS t FROM read
          WHERE NOT (regexp_matches(line, '^भारत का संविधान\s*\d*$') OR line = 'THE CONSTITUTION OF INDIA' OR regexp_matches(line, '^\d{{1,3}}$')
            OR (regexp_matches(line, '^\(भाग\s') AND regexp_matches(line, '\)\s*\d*$')) OR (regexp_matches(line, '^\d[.।]\s') AND regexp_matches(line, '{signals}')))),
        cut AS (
          SELECT *, CASE WHEN regexp_matches(t, '{mid}') THEN regexp_extract(t, '{mid}', 2) WHEN regexp_matches(t, '{wide}') THEN regexp_extract(t, '{wide}', 2) ELSE t END AS head,
            regexp_replace(CASE WHEN regexp_matches(t, '{mid}') THEN regexp_extract(t, '{mid}', 1) WHEN regexp_matches(t, '{wide}') THEN regexp_extract(t, '{wide}', 1) ELSE '' END, '\s+$', '') AS prefix FROM bodies),
        parts AS (
          SELECT *, regexp_extract(head, '{head}', 1) AS digits, regexp_extract(head, '{head}', 2) AS sfx, regexp_extract(head, '{head}', 3) AS tail FROM cut),
        parsed AS (
          SELECT *, digits <> '' AND length(tail) >= 3 AND NOT (length(digits) = 1 AND regexp_matches(tail, '{signals}'))
            AND least(TRY_CAST(digits AS INTEGER), TRY_CAST(right(digits, 3) AS INTEGER), TRY_CAST(right(digits, 2) AS INTEGER)) <= {fv.MAX_ITEM_NUMBER} AS is_heading FROM parts),
        known AS (
          SELECT DISTINCT CAST(p_partkey % 400 + 1 AS VARCHAR) || (['', 'A', 'B', 'ZH', 'E'])[p_partkey // 400 % 5 + 1] AS latin FROM part),
        candidates AS (
          SELECT doc_id, line_no, unnest(c) AS number_hi, unnest(range(len(c))) AS trust FROM (
            SELECT doc_id, line_no, list_filter([digits || sfx, right(digits, 3) || sfx, right(digits, 2) || sfx, {confused}], lambda x: x IS NOT NULL) AS c FROM parsed WHERE is_heading)),
        offers AS (
          SELECT doc_id, line_no, list({{'trust': trust, 'key': lpad(regexp_extract(latin, '^\d+'), 12, '0') || regexp_extract(latin, '[A-Z]*$'), 'latin': latin, 'number_hi': number_hi}} ORDER BY trust) AS offers
          FROM (SELECT *, translate(number_hi, '{fv.SUFFIX_CONSONANTS}', '{latin}') AS latin FROM candidates) JOIN known USING (latin) GROUP BY doc_id, line_no),
        events AS (
          SELECT doc_id, page, line_no, 63 AS seq, line, CASE WHEN is_heading THEN translate(digits || sfx, '{fv.SUFFIX_CONSONANTS}', '{latin}') END AS latin,
            CASE WHEN is_heading THEN tail END AS rest, prefix, coalesce(list_contains(list_transform(offers, lambda o: o.trust), 0), false) AS listed, offers
          FROM parsed LEFT JOIN offers USING (doc_id, line_no)
          UNION ALL {anchors}),
        numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, seq) AS k FROM events),
        walk AS (
          SELECT DISTINCT doc_id, CAST(0 AS BIGINT) AS k, repeat('0', 12) AS cursor, CAST(NULL AS BIGINT) AS item, CAST(NULL AS VARCHAR) AS met, CAST(NULL AS BIGINT) AS before FROM numbered
          UNION ALL
          SELECT n.doc_id, n.k, coalesce(p.o.key, w.cursor), CASE WHEN p.o IS NOT NULL THEN n.k ELSE w.item END, w.cursor, w.item
          FROM walk w JOIN numbered n ON n.doc_id = w.doc_id AND n.k = w.k + 1,
            LATERAL (SELECT list_filter(n.offers, lambda o: o.key > w.cursor)[1] AS o) p),
        met AS (
          SELECT n.*, w.met AS cursor, w.before, w.item, coalesce(w.item = n.k, false) AS taken, list_filter(n.offers, lambda o: o.key > w.met)[1] AS pick
          FROM numbered n JOIN walk w USING (doc_id, k)),
        {select}"""


_SPLIT = r"^([\s\S]*?)(?:,--|--|\s-\s|\s-।)([\s\S]*)$"


@query(
    "edition_items",
    _edition_sql(
        rf"""heads AS (
          SELECT doc_id, k AS item, pick.latin AS number, pick.number_hi AS number_hi, page, rest,
            regexp_replace(CASE WHEN regexp_matches(rest, '{_SPLIT}') THEN regexp_extract(rest, '{_SPLIT}', 1) ELSE regexp_replace(rest, '[-–]$', '') END, '^\s+|\s+$', '', 'g') AS title,
            regexp_replace(regexp_extract(rest, '{_SPLIT}', 2), '^\s+|\s+$', '', 'g') AS head
          FROM met WHERE taken),
        pieces AS (
          SELECT doc_id, item, item AS k, head AS piece FROM heads WHERE head <> ''
          UNION ALL SELECT doc_id, before, k, line FROM met WHERE before IS NOT NULL AND rest IS NULL
          UNION ALL SELECT doc_id, before, k, prefix FROM met WHERE before IS NOT NULL AND taken),
        bodies_of AS (SELECT doc_id, item, string_agg(piece, ' ' ORDER BY k) AS text FROM pieces GROUP BY ALL)
        SELECT doc_id, number, number_hi, title, coalesce(text, '') AS text, page FROM heads LEFT JOIN bodies_of USING (doc_id, item)"""
    ),
)
def edition_items(t: Tables) -> DataFrame:
    return _edition(t).items


@query(
    "edition_review",
    _edition_sql(
        r"""refused AS (
          SELECT *, lpad(regexp_extract(latin, '^\d+'), 12, '0') || regexp_extract(latin, '[A-Z]*$') > cursor AS in_order FROM met WHERE NOT taken AND latin IS NOT NULL)
        SELECT doc_id, page, line_no, latin, line FROM refused WHERE listed OR in_order"""
    ),
)
def edition_review(t: Tables) -> DataFrame:
    return _edition(t).review


PART_NAMES = {"7": "A verified name", "12A": "Another verified name"}
TITLES = {"9": "A verified title"}


@query(
    "edition_parts",
    _edition_sql(
        rf"""shown AS (
          SELECT l.doc_id, CAST(l.line_no // {PAGE_LINES} AS INTEGER) AS page, l.line_no, regexp_replace(l.raw_line, '^\s+|\s+$', '', 'g') AS line FROM lines l),
        usable AS (
          SELECT s.*, regexp_replace(regexp_replace(s.line, '\.+$', ''), '\s+$', '') AS shown, p.is_heading FROM shown s LEFT JOIN parsed p USING (doc_id, line_no)),
        names AS (
          SELECT *, CASE WHEN shown <> '' AND NOT regexp_matches(shown, '^भाग\s') AND is_heading IS NOT NULL AND NOT is_heading THEN shown END AS name FROM usable),
        near AS (SELECT *, coalesce(lead(name) OVER w, lead(name, 2) OVER w) AS below FROM names WINDOW w AS (PARTITION BY doc_id, page ORDER BY line_no)),
        heads_of AS (
          SELECT doc_id, page, line_no, regexp_extract(line, '^\[?भाग\s+(\d{{1,2}})', 1) || regexp_extract(line, '([क-ह]{{1,2}})?\]?$', 1) AS number_hi, below
          FROM near WHERE regexp_matches(line, '^\[?भाग\s+(\d{{1,2}})([क-ह]{{1,2}})?\]?$') AND length(below) >= 3),
        numbered_parts AS (SELECT *, translate(number_hi, '{fv.SUFFIX_CONSONANTS}', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS number FROM heads_of),
        first_parts AS (
          SELECT *, row_number() OVER (PARTITION BY doc_id, number ORDER BY page, line_no) AS rn FROM numbered_parts
          WHERE number IN (SELECT CAST(s_suppkey % 30 + 1 AS VARCHAR) || (['', 'A'])[s_suppkey % 2 + 1] FROM supplier))
        SELECT doc_id, number, number_hi, CASE number WHEN '7' THEN 'A verified name' WHEN '12A' THEN 'Another verified name' ELSE below END AS name, page FROM first_parts WHERE rn = 1"""
    ),
)
def edition_part_names(t: Tables) -> DataFrame:
    suffix = F.element_at(constant_array(["", "A"]), (F.col("s_suppkey") % 2 + 1).cast("int"))
    listed = t.supplier.select(F.concat((F.col("s_suppkey") % 30 + 1).cast("string"), suffix).alias("number"))
    return edition_parts(edition_lines(t), listed, PART_NAMES)


@query(
    "edition_assembled",
    _edition_sql(
        rf"""heads AS (
          SELECT doc_id, pick.latin AS number, pick.number_hi AS number_hi, page,
            regexp_replace(CASE WHEN regexp_matches(rest, '{_SPLIT}') THEN regexp_extract(rest, '{_SPLIT}', 1) ELSE regexp_replace(rest, '[-–]$', '') END, '^\s+|\s+$', '', 'g') AS title
          FROM met WHERE taken),
        first AS (
          SELECT doc_id, CAST(n AS VARCHAR) || (['', 'A', 'ZH'])[n % 3 + 1] AS number, CAST(n // 10 + 1 AS VARCHAR) AS part, (['in-force', 'amended', 'omitted'])[(doc_id + n) % 3 + 1] AS status, n % 4 AS amendments
          FROM (SELECT doc_id, unnest(range(1, 40)) AS n FROM documents))
        SELECT coalesce(h.doc_id, f.doc_id) AS doc_id, coalesce(h.number, f.number) AS number, coalesce(h.number_hi, f.number) AS number_hi, coalesce(part, '') AS part,
          coalesce(status, 'in-force') AS status, coalesce(amendments, 0) AS n_amendments,
          CASE WHEN h.number IS NULL THEN 'Not printed' WHEN h.number = '9' THEN 'A verified title' ELSE regexp_replace(title, '\s+', ' ', 'g') END AS title,
          coalesce(page, 0) AS page, h.number IS NOT NULL AS printed
        FROM heads h FULL OUTER JOIN first f ON h.doc_id = f.doc_id AND h.number = f.number"""
    ),
)
def edition_assembled(t: Tables) -> DataFrame:
    """Items of the second edition with part, status and amendments of the first; what is not printed stands in."""
    n = F.col("n")
    first = t.documents.select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(39))).alias("n")).select(
        "doc_id",
        F.concat(n.cast("string"), F.element_at(constant_array(["", "A", "ZH"]), n % 3 + 1)).alias("number"),
        F.floor(n / 10 + 1).cast("string").alias("part"),
        F.element_at(constant_array(["in-force", "amended", "omitted"]), ((F.col("doc_id") + n) % 3 + 1).cast("int")).alias("status"),
        F.array_repeat(F.lit("1st-amendment"), n % 4).alias("amended_by"),
    )
    out = assembled(_edition(t).items, first, TITLES, "Not printed", "No entry is printed.")
    return out.select("doc_id", "number", "number_hi", "part", "status", F.size("amended_by").alias("n_amendments"), "title", "page", "printed")
