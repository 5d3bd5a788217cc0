"""Statute-like text derived from ``documents``, for queries and their SQL.

The given prose has no headings, markers or footnotes. Each line of each whole
document is kept whole and gets the shape its position selects: a part or item
heading, a clause, a marker, a footnote with a citation, and so on. A shape that
is a line of its own (a heading, a page number) stands on a line before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.let import constant_array
from ..functions.numbers import ordinal_words
from ..sources.tables import spread
from .registry import Tables

PARTS = ["I", "II", "III", "IV", "IVA", "V", "VI", "XLIX", "CXIV"]
PART_NUMBERS = ["1", "2", "3", "4", "4A", "5", "6", "49", "114"]


def _line(doc: Column, line: Column, i: Column) -> Column:
    shape = (doc * 31 + i * 17 + 3) % 20
    mark = ((doc + i) % 3 + 1).cast("string")
    number = (i * 2 + doc % 5 + 1).cast("string")
    short = F.substring(line, 1, 24)
    cited = F.concat(
        F.lit("by the Constitution ("),
        ordinal_words((doc + i) % 110 + 1),
        F.lit(" Amendment) Act, "),
        ((doc + i) % 70 + 1950).cast("string"),
    )
    s = F.lit
    below = F.concat(s("\n"), line)
    return (
        F.when(i == 0, F.concat(s("WE, THE PEOPLE OF INDIA, "), line))
        .when(i == 1, F.concat(line, s(" THIS CONSTITUTION.")))
        .when(shape == 0, F.concat(s("PART "), F.element_at(constant_array(PARTS), (i % 9 + 1).cast("int")), below))
        .when(shape.isin(1, 11), F.concat(number, s(". "), short, s(".—"), line))
        .when(shape == 2, F.concat(mark, s("["), number, s("."), below))
        .when(shape == 3, F.concat(mark, s("["), number, s("A. "), short, s(".—(1) "), line, s("]")))
        .when(shape == 4, F.concat(s("(1) "), line))
        .when(shape == 5, F.concat(mark, s("[(2A) "), line, s("]")))
        .when(shape == 6, F.concat(mark, s(". Subs. "), cited, s(", s. 2, for "), line))
        .when(shape == 7, F.concat(s("4"), number, s(". "), short, s(".—Omitted "), cited, below))
        .when(shape == 8, below)
        .when(shape == 9, F.concat(i.cast("string"), below))
        .when(shape == 10, F.concat(s("Explanation I.—"), line))
        .when(shape == 12, F.concat(s("Illustration. "), line))
        .when(shape == 13, F.concat(mark, s("["), line))
        .when(shape == 14, F.concat(s("Right of the Item"), below))
        .when(shape == 15, F.concat(number, s(". "), short, below))
        .when(
            (shape == 16) & (i > 30),
            F.concat(F.element_at(constant_array(fv.SCHEDULE_WORDS), (i % 40 + 1).cast("int")), s(" SCHEDULE"), below),
        )
        .when((shape == 17) & (i > 60), F.concat(s("APPENDIX I"), below))
        .when((shape == 18) & (i > 4), F.concat(mark, s(". Ins. "), cited, s("\n[Articles 59(3), 65(3)] "), line))
        .when((shape == 19) & (i > 24), F.concat(s("\n[Articles 59(3), 65(3)]"), below))
        .when((shape == 17) & (i > 12), F.concat(s("CHAPTER II.—"), short, below))
        .when((shape == 16) & (i > 12), F.concat(s("PART "), F.element_at(constant_array(PARTS), (i % 9 + 1).cast("int")), s("\nTHE UNION AND ITS\n2[TERRITORY]"), below))
        .otherwise(line)
    )


def statutes(t: Tables) -> DataFrame:
    """(doc_id, text)"""
    lines = F.transform(F.split("text", "\n"), lambda line, i: _line(F.col("doc_id"), line, i.cast("long")))
    return spread(t.documents.select("doc_id", "text")).select("doc_id", F.array_join(lines, "\n").alias("text"))


# --- the same derivation for the SQL side ------------------------------------


def _sql_ordinals(limit: int) -> str:
    """Ordinal words 1..limit as a SQL list, by the rule of the English names."""

    def name(n: int) -> str:
        if n >= 100:
            head = fv.CARDINAL_UNITS[n // 100 - 1] + " hundred"
            return head + "th" if n % 100 == 0 else head + " and " + name(n % 100)
        if n < 20:
            return fv.ORDINAL_UNITS[n - 1]
        ten = fv.TENS[n // 10 - 2]
        return ten[:-1] + "ieth" if n % 10 == 0 else ten + "-" + fv.ORDINAL_UNITS[n % 10 - 1]

    names = ", ".join("'" + name(n)[0].upper() + name(n)[1:] + "'" for n in range(1, limit + 1))
    return f"[{names}]"


def _sql_list(items: list[str]) -> str:
    return "[" + ", ".join(f"'{i}'" for i in items) + "]"


ORDINALS_CTE = f"""
ordinals AS (
  SELECT n, word FROM (
    SELECT unnest(range(1, 1000)) AS n, unnest({_sql_ordinals(999)}) AS word)
)"""

# Lines of the derived statutes: (doc_id, line_no, raw).
STATUTE_LINES_CTE = f"""
raw_lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS i
  FROM documents
),
shaped AS (
  SELECT doc_id, l, i, (doc_id * 31 + i * 17 + 3) % 20 AS shape, CAST((doc_id + i) % 3 + 1 AS VARCHAR) AS mark,
    CAST(i * 2 + doc_id % 5 + 1 AS VARCHAR) AS num, substr(l, 1, 24) AS short,
    'by the Constitution (' || ({_sql_ordinals(110)})[(doc_id + i) % 110 + 1] || ' Amendment) Act, '
      || CAST((doc_id + i) % 70 + 1950 AS VARCHAR) AS cited
  FROM raw_lines
),
shaped_texts AS (
  SELECT doc_id, string_split(string_agg(raw, chr(10) ORDER BY i), chr(10)) AS rows FROM (SELECT doc_id, i, CASE
    WHEN i = 0 THEN 'WE, THE PEOPLE OF INDIA, ' || l
    WHEN i = 1 THEN l || ' THIS CONSTITUTION.'
    WHEN shape = 0 THEN 'PART ' || ({_sql_list(PARTS)})[i % 9 + 1] || chr(10) || l
    WHEN shape IN (1, 11) THEN num || '. ' || short || '.—' || l
    WHEN shape = 2 THEN mark || '[' || num || '.' || chr(10) || l
    WHEN shape = 3 THEN mark || '[' || num || 'A. ' || short || '.—(1) ' || l || ']'
    WHEN shape = 4 THEN '(1) ' || l
    WHEN shape = 5 THEN mark || '[(2A) ' || l || ']'
    WHEN shape = 6 THEN mark || '. Subs. ' || cited || ', s. 2, for ' || l
    WHEN shape = 7 THEN '4' || num || '. ' || short || '.—Omitted ' || cited || chr(10) || l
    WHEN shape = 8 THEN chr(10) || l
    WHEN shape = 9 THEN CAST(i AS VARCHAR) || chr(10) || l
    WHEN shape = 10 THEN 'Explanation I.—' || l
    WHEN shape = 12 THEN 'Illustration. ' || l
    WHEN shape = 13 THEN mark || '[' || l
    WHEN shape = 14 THEN 'Right of the Item' || chr(10) || l
    WHEN shape = 15 THEN num || '. ' || short || chr(10) || l
    WHEN shape = 16 AND i > 30 THEN ({_sql_list(fv.SCHEDULE_WORDS)})[i % 40 + 1] || ' SCHEDULE' || chr(10) || l
    WHEN shape = 17 AND i > 60 THEN 'APPENDIX I' || chr(10) || l
    WHEN shape = 18 AND i > 4 THEN mark || '. Ins. ' || cited || chr(10) || '[Articles 59(3), 65(3)] ' || l
    WHEN shape = 19 AND i > 24 THEN chr(10) || '[Articles 59(3), 65(3)]' || chr(10) || l
    WHEN shape = 17 AND i > 12 THEN 'CHAPTER II.—' || short || chr(10) || l
    WHEN shape = 16 AND i > 12 THEN 'PART ' || ({_sql_list(PARTS)})[i % 9 + 1] || chr(10) || 'THE UNION AND ITS' || chr(10) || '2[TERRITORY]' || chr(10) || l
    ELSE l END AS raw
  FROM shaped) GROUP BY doc_id
),
statute_lines AS (
  SELECT doc_id, unnest(rows) AS raw, CAST(unnest(range(len(rows))) AS INTEGER) AS line_no FROM shaped_texts
),
lines AS (
  SELECT doc_id, line_no, regexp_replace(replace(raw, chr(12), ''), '\\s+$', '') AS line FROM statute_lines
)"""


def _sq(pattern: str) -> str:
    """A pattern as a SQL string literal body, case flag moved out of the way."""
    return pattern.replace("'", "''")


_SCHED = "|".join(fv.SCHEDULE_WORDS)
_D = fv.TITLE_DASHES

# Per-line facts, one row per line.
FLAGS_CTE = f"""
cleaned AS (
  SELECT doc_id, line_no, line, regexp_replace(line, '\\s+', '', 'g') AS squeezed,
    regexp_replace(regexp_replace(upper(regexp_replace(line, '\\s+', '', 'g')), '^\\d{{1,2}}\\[?', ''), '\\]+$', '') AS structure,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, '^\\s+|\\s+$', '', 'g'),
      '(\\.)\\s*-\\s*', '\\1— ', 'g'), '^[\\x{{E000}}-\\x{{F8FF}}]+', ''), '^\\[(\\d)', '\\1') AS base
  FROM lines
),
split AS (
  SELECT *, regexp_replace(base, '{_sq(fv.MARKER)}', '') AS clean,
    TRY_CAST(nullif(regexp_extract(base, '{_sq(fv.MARKER)}', 1), '') AS INTEGER) AS marker
  FROM cleaned
),
flags0 AS (
  SELECT *, squeezed = '' AS is_blank, regexp_matches(squeezed, '{fv.PAGE_NUMBER}') AS is_page,
    regexp_matches(line, '{_sq(fv.FOOTNOTE_START)}')
      OR (regexp_matches(line, '{fv.FOOTNOTE_NUMBER}') AND regexp_matches(line, '{_sq(fv.FOOTNOTE_SIGNAL)}')) AS footnote_raw,
    regexp_matches(clean, '{_sq(fv.FOOTNOTE_START)}')
      OR (regexp_matches(clean, '{fv.FOOTNOTE_NUMBER}') AND regexp_matches(clean, '{_sq(fv.FOOTNOTE_SIGNAL)}')) AS footnote_clean,
    regexp_matches(structure, '{fv.PART_HEADING}') AS is_part,
    regexp_matches(structure, '{fv.CHAPTER_HEADING}') AS is_chapter,
    structure IN ({", ".join("'" + a[0] + "'" for a in fv.PART_NAME_ANCHORS)}) AS is_anchor,
    regexp_matches(regexp_replace(squeezed, '[^A-Z]', '', 'g'), '{fv.APPENDIX_HEADING}') AS is_appendix,
    nullif(regexp_extract(regexp_replace(squeezed, '^\\d{{1,2}}\\[?', ''), '^({_SCHED})SCHEDULE', 1), '') AS schedule_word,
    nullif(regexp_extract(clean, '{fv.ITEM_HEADING}', 1), '') AS number,
    regexp_extract(clean, '{fv.ITEM_HEADING}', 2) AS rest,
    nullif(regexp_extract(clean, '{fv.BARE_NUMBER}', 1), '') AS bare_number,
    length(regexp_extract(clean, '^([^{_D}]*)[{_D}]', 0)) AS dash_at,
    regexp_matches(regexp_extract(clean, '^[^{_D}]*[{_D}](.*)$', 1), '\\S') AS dash_body,
    regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS t
  FROM split
),
flags AS (
  SELECT *,
    number IS NOT NULL AND (dash_body OR NOT footnote_clean) AS wins,
    is_part OR is_chapter OR starts_with(structure, 'APPENDIX') OR regexp_matches(structure, '^({_SCHED})SCHEDULE')
      OR bare_number IS NOT NULL OR (number IS NOT NULL AND (dash_body OR NOT footnote_clean)) AS is_structural,
    length(t) > 2 AND length(t) < 60 AND NOT regexp_matches(t, '[.,;:\\]]$') AND NOT contains(t, ';')
      AND regexp_matches(t, '^[A-Z]') AND regexp_matches(t, '[a-z]') AS section_shape
  FROM flags0
)"""

# Document phases and footnote blocks: a walk line by line, for a footnote hides what its lines would start.
NOTES_CTE = f"""
sectioned AS (
  SELECT *, NOT is_blank AND NOT is_page AS counts, is_blank OR is_structural AS breaks,
    schedule_word IS NOT NULL OR starts_with(squeezed, '[Articles59(3)') AS starts_schedule,
    starts_with(line, '{fv.PREAMBLE_OPENING}') AS opens_preamble, regexp_matches(squeezed, 'THISCONSTITUTION\\.$') AS closes_preamble,
    NOT is_part AND NOT is_chapter AND NOT is_anchor AND section_shape AND coalesce(first_value(
      CASE WHEN NOT is_blank AND NOT is_page THEN is_structural END IGNORE NULLS)
      OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), false) AS heads_section
  FROM flags
),
steps AS MATERIALIZED (
  SELECT doc_id, line_no, counts, breaks, starts_schedule, opens_preamble, closes_preamble, is_appendix, footnote_raw,
    footnote_clean AND NOT wins AND NOT (is_part OR is_chapter OR is_anchor) AND NOT heads_section AS notes_item
  FROM sectioned
),
line_walk AS (
  SELECT DISTINCT doc_id, -1 AS line_no, 0 AS phase, 0 AS after, false AS note, false AS opens, false AS is_schedule FROM steps
  UNION ALL
  SELECT s.doc_id, s.line_no, c.phase, CASE WHEN c.free AND w.after = 1 AND NOT c.opens AND s.closes_preamble THEN 2 ELSE c.phase END,
    NOT c.free AND c.inside OR c.opens, c.opens, c.is_schedule
  FROM line_walk w JOIN steps s ON s.doc_id = w.doc_id AND s.line_no = w.line_no + 1,
  LATERAL (SELECT w.note AND NOT s.breaks AS inside, NOT (w.note AND NOT s.breaks) AND s.counts AS free) a,
  LATERAL (SELECT a.inside, a.free, a.free AND w.after IN (2, 3) AND s.is_appendix AS ends) b,
  LATERAL (SELECT b.inside, b.free, b.ends, b.free AND w.after IN (2, 3) AND NOT b.ends AND s.starts_schedule AS is_schedule) d,
  LATERAL (SELECT d.inside, d.free, d.is_schedule,
    CASE WHEN d.free AND w.after = 0 AND s.opens_preamble THEN 1 WHEN d.ends THEN 4 WHEN d.is_schedule THEN 3 ELSE w.after END AS phase,
    d.free AND NOT d.ends AND NOT d.is_schedule AND CASE WHEN w.after IN (1, 3) THEN s.footnote_raw WHEN w.after = 2 THEN s.notes_item ELSE false END AS opens) c
),
noted AS (
  SELECT s.*, w.phase, w.note AS in_note, w.opens AS note_opens, w.is_schedule, w.phase = 2 AND s.counts AND s.heads_section AS section_candidate,
    CASE WHEN w.note THEN sum(CASE WHEN w.opens THEN 1 ELSE 0 END)
      OVER (PARTITION BY s.doc_id ORDER BY s.line_no ROWS UNBOUNDED PRECEDING) END AS note_no
  FROM sectioned s JOIN line_walk w USING (doc_id, line_no)
)"""

# Heading events gated by the running sequence, and the open item of each line.
ITEMS_CTE = f"""
eventful AS (
  SELECT *, phase = 2 AND counts AND NOT in_note AS free,
    section_candidate AND NOT in_note AS is_section,
    phase = 2 AND counts AND NOT in_note AND NOT is_part AND NOT is_chapter AND NOT is_anchor
      AND NOT section_candidate AS ordinary
  FROM noted
),
events AS (
  SELECT doc_id, line_no, CASE WHEN (free AND (is_part OR is_anchor)) OR is_section THEN 'C'
      WHEN ordinary AND number IS NOT NULL THEN 'H' WHEN ordinary AND bare_number IS NOT NULL THEN 'B' END AS kind,
    coalesce(number, bare_number) AS num
  FROM eventful
),
gate_lists AS (
  SELECT doc_id, list({{'line_no': line_no, 'kind': kind, 'num': num,
      'v': coalesce(TRY_CAST(regexp_extract(num, '^\\d+') AS BIGINT), 0), 'last': CAST(0 AS BIGINT), 'open': false, 'out': CAST(NULL AS VARCHAR),
      'fused': CAST(NULL AS INTEGER)}} ORDER BY line_no) AS ev
  FROM events WHERE kind IS NOT NULL GROUP BY doc_id
),
ranked AS (
  SELECT doc_id, unnest(ev) AS e, unnest(range(1, len(ev) + 1)) AS k FROM gate_lists
),
gate AS (
  WITH RECURSIVE walk AS (
    SELECT doc_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS last, false AS open,
      CAST(NULL AS INTEGER) AS line_no, CAST(NULL AS VARCHAR) AS out, CAST(NULL AS INTEGER) AS fused
    FROM gate_lists
    UNION ALL
    SELECT r.doc_id, r.k,
      CASE WHEN c.act = 'F' AND tv > 0 THEN tv WHEN c.act = 'A' AND r.e.v > 0 THEN r.e.v ELSE w.last END,
      CASE WHEN r.e.kind = 'C' THEN false WHEN c.act IN ('F', 'A') THEN true ELSE w.open END,
      r.e.line_no,
      CASE WHEN c.act = 'F' THEN substr(r.e.num, 2) WHEN c.act = 'A' THEN r.e.num END,
      CASE WHEN c.act = 'F' THEN CAST(substr(r.e.num, 1, 1) AS INTEGER) END
    FROM walk w JOIN ranked r ON r.doc_id = w.doc_id AND r.k = w.k + 1,
    LATERAL (SELECT coalesce(TRY_CAST(regexp_extract(substr(r.e.num, 2), '^\\d+') AS BIGINT), 0) AS tv) tails,
    LATERAL (SELECT CASE WHEN r.e.kind = 'C' THEN 'C'
      WHEN r.e.kind = 'H' AND w.last > 0 AND r.e.v > w.last + {fv.SEQUENCE_JUMP}
        AND regexp_matches(substr(r.e.num, 2), '^\\d{{1,3}}[A-Z]{{0,2}}$') AND tv <= w.last + {fv.SEQUENCE_JUMP} THEN 'F'
      WHEN r.e.kind = 'H' THEN 'A'
      WHEN w.open AND (r.e.v > w.last OR (r.e.v = w.last AND regexp_matches(r.e.num, '[A-Z]$')))
        AND r.e.v <= w.last + {fv.SEQUENCE_JUMP} THEN 'A' ELSE 'N' END AS act) c
  )
  SELECT doc_id, line_no, out AS item_number, fused FROM walk WHERE out IS NOT NULL
),
gated AS (
  SELECT e.*, g.item_number, g.fused FROM eventful e LEFT JOIN gate g USING (doc_id, line_no)
),
counted AS (
  SELECT *, sum(CASE WHEN item_number IS NOT NULL THEN 1 ELSE 0 END) OVER w AS cnt,
    coalesce(last_value(CASE WHEN item_number IS NOT NULL THEN true
      WHEN (free AND (is_part OR is_anchor)) OR is_section OR phase >= 3 THEN false END IGNORE NULLS) OVER w, false) AS opn
  FROM gated WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)
),
itemized0 AS (
  SELECT *, CASE WHEN opn THEN cnt END AS item_no, ordinary AND opn AS inside,
    CASE WHEN item_number IS NOT NULL THEN CASE WHEN number IS NOT NULL THEN rest ELSE '' END ELSE clean END AS source
  FROM counted
),
itemized1 AS (
  SELECT *, min(line_no) FILTER (inside AND regexp_matches(source, '[{_D}]')
      AND (item_number IS NULL OR number IS NOT NULL)) OVER (PARTITION BY doc_id, item_no) AS title_end
  FROM itemized0
),
itemized AS (
  SELECT *, CASE WHEN inside AND (title_end IS NULL OR line_no <= title_end)
      THEN regexp_replace(regexp_replace(source, '[{_D}].*$', ''), '^\\s+|\\s+$', '', 'g') END AS title_piece,
    CASE WHEN inside AND line_no = title_end THEN regexp_replace(regexp_replace(
        regexp_extract(source, '^[^{_D}]*[{_D}](.*)$', 1), '^\\s+|\\s+$', '', 'g'), '^[{_D}]+\\s*', '')
      WHEN inside AND NOT (title_end IS NULL OR line_no <= title_end) THEN clean END AS body_piece
  FROM itemized1
)"""

# Body lines with clause numbers, markers and texts.
BODY_CTE = f"""
pieces0 AS (
  SELECT doc_id, item_no, line_no, TRY_CAST(nullif(regexp_extract(body_piece, '{_sq(fv.MARKER)}', 1), '') AS INTEGER) AS body_marker,
    regexp_replace(regexp_replace(body_piece, '^\\d{{1,2}}\\*?\\[', '['), '^\\[\\s*(\\(\\d{{1,2}}[A-Z]?\\))', '\\1') AS piece
  FROM itemized WHERE coalesce(body_piece, '') <> ''
),
pieces1 AS (
  SELECT *, CASE WHEN regexp_matches(piece, '{fv.EXPLANATION}') THEN 'explanation'
      WHEN regexp_matches(piece, '{fv.ILLUSTRATION}') THEN 'illustration'
      WHEN regexp_matches(piece, '{fv.CLAUSE_START}') THEN 'clause' END AS kind_start
  FROM pieces0
),
pieces2 AS (
  SELECT *, CASE kind_start WHEN 'explanation' THEN regexp_replace(regexp_extract(piece, '{fv.EXPLANATION}', 2), '^[—⎯]\\s*', '')
      WHEN 'illustration' THEN regexp_extract(piece, '{fv.ILLUSTRATION}', 1)
      WHEN 'clause' THEN regexp_extract(piece, '{fv.CLAUSE_START}', 2) ELSE piece END AS clause_text,
    CASE WHEN kind_start = 'clause' THEN regexp_extract(piece, '{fv.CLAUSE_START}', 1) END AS clause_number,
    CASE WHEN kind_start IS NOT NULL OR row_number() OVER (PARTITION BY doc_id, item_no ORDER BY line_no) = 1 THEN 1 ELSE 0 END AS starts_clause
  FROM pieces1
),
pieces AS (
  SELECT *, sum(starts_clause) OVER (PARTITION BY doc_id, item_no ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS clause_seq
  FROM pieces2
),
clause_rows AS (
  SELECT doc_id, item_no, clause_seq, first(clause_number ORDER BY line_no) AS number,
    coalesce(first(kind_start ORDER BY line_no), 'clause') AS kind,
    regexp_replace(regexp_replace(string_agg(clause_text, ' ' ORDER BY line_no), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS text
  FROM pieces GROUP BY doc_id, item_no, clause_seq
),
clauses AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item_no ORDER BY clause_seq) - 1 AS clause_no
  FROM clause_rows WHERE text <> ''
)"""

# Footnote blocks linked to items.
LINKS_CTE = f"""
note_rows AS (
  SELECT doc_id, note_no, min(line_no) AS line_no, max(line_no) AS last_line, first(item_no ORDER BY line_no) AS open_item,
    TRY_CAST(nullif(regexp_extract(first(t ORDER BY line_no), '^(\\d{{1,2}})\\.', 1), '') AS INTEGER) AS marker,
    string_agg(t, ' ' ORDER BY line_no) AS text
  FROM itemized WHERE in_note GROUP BY doc_id, note_no
),
mark_events AS (
  SELECT doc_id, CASE WHEN item_number IS NOT NULL THEN coalesce(marker, fused) ELSE marker END AS marker,
    line_no, 0 AS seq, item_no AS target, CAST(NULL AS HUGEINT) AS note_no
  FROM itemized WHERE phase = 2 AND item_no IS NOT NULL AND (ordinary OR note_opens)
    AND CASE WHEN item_number IS NOT NULL THEN coalesce(marker, fused) ELSE marker END IS NOT NULL
  UNION ALL
  SELECT doc_id, body_marker, line_no, 1, item_no, NULL FROM pieces WHERE body_marker IS NOT NULL
  UNION ALL
  SELECT doc_id, TRY_CAST(regexp_extract(line, '{_sq(fv.MARKER)}', 1) AS INTEGER), line_no, 0, NULL, NULL
  FROM itemized WHERE phase = 3 AND NOT in_note AND NOT is_schedule AND regexp_matches(line, '{_sq(fv.MARKER)}')
  UNION ALL
  SELECT doc_id, marker, line_no, 2, NULL, note_no FROM note_rows WHERE marker IS NOT NULL
),
previous AS (
  SELECT doc_id, note_no, lag(target) OVER (PARTITION BY doc_id, marker ORDER BY line_no, seq) AS before
  FROM mark_events
),
notes AS (
  SELECT n.doc_id, n.note_no, n.marker, n.line_no, n.last_line, coalesce(p.before, n.open_item) AS item_no, n.text
  FROM note_rows n LEFT JOIN previous p ON p.doc_id = n.doc_id AND p.note_no = n.note_no
)"""

# Part, section and part name of every line.
CONTEXT_CTE = f"""
loose_lines AS (
  SELECT *, ordinary AND NOT opn AS loose, free AND (is_part OR is_chapter OR is_anchor) AS flushes,
    CASE WHEN free AND is_part THEN ({_sql_list(PART_NUMBERS)})[list_position({_sql_list(PARTS)}, regexp_extract(structure, '{fv.PART_HEADING}', 1))]
      WHEN free AND is_anchor THEN {"CASE structure " + " ".join(f"WHEN '{a[0]}' THEN '{a[1]}'" for a in fv.PART_NAME_ANCHORS) + " END"} END AS part_set,
    regexp_replace(regexp_replace(regexp_replace(line, '[\\d*\\[\\]]', '', 'g'), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS part_line
  FROM itemized
),
shaped_names AS (
  SELECT *, loose AND length(part_line) > 1 AND regexp_matches(part_line, '^[A-Z][A-Z\\s&,''’().-]*$') AS names,
    sum(CASE WHEN flushes THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS flush_no
  FROM loose_lines
),
named AS (
  SELECT *, names AND sum(CASE WHEN loose AND NOT names THEN 1 ELSE 0 END) OVER g = 0
    AND first_value(is_part AND free AND part_set IS NOT NULL) OVER g AS names_part
  FROM shaped_names WINDOW g AS (PARTITION BY doc_id, flush_no ORDER BY line_no ROWS UNBOUNDED PRECEDING)
),
placed AS (
  SELECT *, coalesce(last_value(part_set IGNORE NULLS) OVER w, '') AS part,
    last_value(CASE WHEN is_section OR (free AND is_chapter AND NOT is_part) OR (loose AND section_shape AND NOT names_part) THEN t END IGNORE NULLS) OVER w AS section,
    sum(CASE WHEN part_set IS NOT NULL THEN 1 ELSE 0 END) OVER w AS part_run
  FROM named WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)
)"""

_CHAIN = [STATUTE_LINES_CTE, FLAGS_CTE, NOTES_CTE, ITEMS_CTE, BODY_CTE, LINKS_CTE, CONTEXT_CTE]


def statute_sql(depth: int, select: str, *extra: str) -> str:
    """SQL over the first ``depth`` steps: 1 lines, 2 flags, 3 notes, 4 items, 5 clauses, 6 links, 7 context."""
    return "WITH RECURSIVE " + ",".join([*_CHAIN[:depth], *extra]) + "\n" + select
