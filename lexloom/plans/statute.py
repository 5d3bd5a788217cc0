"""Queries on the structure of statute-like text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import numbers, text
from ..operators import segment
from ..sources.tables import spread
from .derive import ORDINALS_CTE, statute_sql, statutes
from .registry import Tables, query


def _segmented(t: Tables) -> segment.Statute:
    return segment.segment_statutes(statutes(t))


@query(
    "lines",
    r"""SELECT doc_id, CAST(i AS INTEGER) AS line_no, line FROM (
          SELECT doc_id, i, regexp_replace(replace(l, chr(12), ''), '\s+$', '') AS line FROM (
            SELECT doc_id, unnest(string_split(text, chr(10))) AS l,
              unnest(range(len(string_split(text, chr(10))))) AS i FROM documents))
        WHERE NOT regexp_matches(regexp_replace(line, '\s+', '', 'g'), '^\d{0,3}$')""",
)
def lines(t: Tables) -> DataFrame:
    return segment.numbered_lines(spread(t.documents.select("doc_id", "text"))).filter(
        segment.meaningful(F.col("line"))
    )


@query(
    "line_classes",
    statute_sql(
        2,
        """SELECT doc_id, line_no, marker, clean, CASE WHEN is_blank THEN 'blank' WHEN is_page THEN 'page'
             WHEN is_appendix THEN 'appendix' WHEN schedule_word IS NOT NULL THEN 'schedule' WHEN is_part THEN 'part'
             WHEN is_chapter THEN 'chapter' WHEN is_anchor THEN 'part-anchor'
             WHEN footnote_clean AND NOT wins THEN 'footnote' WHEN number IS NOT NULL THEN 'item'
             WHEN bare_number IS NOT NULL THEN 'bare-item' ELSE 'body' END AS class FROM flags""",
    ),
)
def line_classes(t: Tables) -> DataFrame:
    flagged = segment.classify_lines(segment.numbered_lines(statutes(t)))
    return flagged.select("doc_id", "line_no", "marker", "clean", segment.line_class().alias("class"))


@query(
    "section_headings",
    statute_sql(4, "SELECT doc_id, line_no, t AS section, heads_section AS next_structural FROM eventful WHERE is_section"),
)
def section_headings(t: Tables) -> DataFrame:
    found = _segmented(t).lines.filter("is_section")
    return found.select("doc_id", "line_no", text.strip(F.col("line")).alias("section"), F.lit(True).alias("next_structural"))


@query(
    "title_body_split",
    statute_sql(
        2,
        f"""SELECT doc_id, line_no, number,
              regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
                regexp_replace(rest, '[{fv.TITLE_DASHES}].*$', ''), '\\d{{0,2}}\\[', '', 'g'), '\\]', '', 'g'),
                '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g'), '\\s*\\.+$', ''), '(.)$', '\\1.') AS title,
              regexp_replace(regexp_replace(regexp_extract(rest, '^[^{fv.TITLE_DASHES}]*[{fv.TITLE_DASHES}](.*)$', 1),
                '^\\s+|\\s+$', '', 'g'), '^[{fv.TITLE_DASHES}]+\\s*', '') AS body
            FROM flags WHERE wins""",
    ),
)
def title_body_split(t: Tables) -> DataFrame:
    headings = segment.classify_lines(segment.numbered_lines(statutes(t))).filter("wins")
    return headings.select(
        "doc_id",
        "line_no",
        "number",
        text.clean_title(text.before_dash(F.col("rest"))).alias("title"),
        text.strip_leading_dashes(text.after_dash(F.col("rest"))).alias("body"),
    )


@query("phases", statute_sql(3, "SELECT doc_id, phase, count(*) AS n_lines, min(line_no) AS first_line FROM noted GROUP BY ALL"))
def phases(t: Tables) -> DataFrame:
    return _segmented(t).lines.groupBy("doc_id", "phase").agg(
        F.count(F.lit(1)).alias("n_lines"), F.min("line_no").alias("first_line")
    )


@query(
    "footnote_blocks",
    statute_sql(
        3,
        """SELECT doc_id, note_no, min(line_no) AS line_no, max(line_no) AS last_line, count(*) AS n_lines,
             string_agg(t, ' ' ORDER BY line_no) AS text FROM noted WHERE in_note GROUP BY doc_id, note_no""",
    ),
)
def footnote_blocks(t: Tables) -> DataFrame:
    kept = _segmented(t).lines.filter("in_note").withColumn("t", text.strip(F.col("line")))
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "t")))
    return kept.groupBy("doc_id", "note_no").agg(
        F.min("line_no").alias("line_no"),
        F.max("line_no").alias("last_line"),
        F.count(F.lit(1)).alias("n_lines"),
        F.array_join(F.transform(ordered, lambda s: s["t"]), " ").alias("text"),
    )


@query("gated_sequence", statute_sql(4, "SELECT doc_id, line_no, item_number, fused FROM gate"))
def gated_sequence(t: Tables) -> DataFrame:
    accepted = _segmented(t).lines.filter(F.col("item_number").isNotNull())
    return accepted.select("doc_id", "line_no", "item_number", "fused")


@query(
    "segments",
    statute_sql(
        5,
        r"""SELECT doc_id, item_no, line_no, number, title, coalesce(body, '') AS body FROM (
              SELECT doc_id, item_no, min(line_no) AS line_no, max(item_number) AS number,
                regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
                  string_agg(title_piece, ' ' ORDER BY line_no), '\d{0,2}\[', '', 'g'), '\]', '', 'g'), '\s+', ' ', 'g'),
                  '^\s+|\s+$', '', 'g'), '\s*\.+$', ''), '(.)$', '\1.') AS title
              FROM itemized WHERE item_no IS NOT NULL GROUP BY doc_id, item_no)
            LEFT JOIN (SELECT doc_id, item_no, string_agg(text, ' ' ORDER BY clause_no) AS body FROM clauses
              GROUP BY doc_id, item_no) USING (doc_id, item_no)""",
    ),
)
def segments(t: Tables) -> DataFrame:
    items = _segmented(t).items
    body = F.array_join(F.transform("clauses", lambda c: c["text"]), " ")
    return items.select("doc_id", "item_no", "line_no", "number", "title", body.alias("body"))


@query("clauses", statute_sql(5, "SELECT doc_id, item_no, CAST(clause_no AS INTEGER) AS clause_no, number, kind, text FROM clauses"))
def clauses(t: Tables) -> DataFrame:
    return _segmented(t).clauses.select("doc_id", "item_no", "clause_no", "number", "kind", "text")


@query("footnote_asof", statute_sql(6, "SELECT doc_id, note_no, marker, line_no, last_line, item_no, text FROM notes"))
def footnote_asof(t: Tables) -> DataFrame:
    return _segmented(t).footnotes


_CITED = (
    ORDINALS_CTE
    + f""",
cited AS (
  SELECT c.doc_id, c.item_no, c.seen_at, c.src, c.idx, o.n FROM (
    SELECT doc_id, item_no, seen_at, src, unnest(range(len(ws))) AS idx, unnest(ws) AS w FROM (
      SELECT b.doc_id, b.item_no, i.last_line AS seen_at, 0 AS src, regexp_extract_all(b.body, '{fv.CITATION}', 1) AS ws
      FROM (SELECT doc_id, item_no, string_agg(text, ' ' ORDER BY clause_no) AS body FROM clauses GROUP BY ALL) b
      JOIN (SELECT doc_id, item_no, max(line_no) AS last_line FROM itemized WHERE item_no IS NOT NULL GROUP BY ALL) i
        USING (doc_id, item_no)
      UNION ALL
      SELECT doc_id, item_no, last_line, 1, regexp_extract_all(text, '{fv.CITATION}', 1) FROM notes WHERE item_no IS NOT NULL
    )) c JOIN ordinals o ON lower(o.word) = lower(c.w)
)"""
)


@query(
    "item_context",
    statute_sql(
        7,
        """SELECT doc_id, item_no, part, section, amended_by, CASE WHEN regexp_matches(coalesce(c.text, ''), '(?i)^\\[?\\s*Omitted') THEN 'omitted'
             WHEN regexp_matches(coalesce(c.text, ''), '(?i)^\\[?\\s*Repealed') THEN 'repealed'
             WHEN a.first_at <= h.last_line THEN 'amended' ELSE 'in-force' END AS status
           FROM (SELECT doc_id, item_no, max(line_no) AS last_line, first(part ORDER BY line_no) AS part, first(section ORDER BY line_no) AS section
             FROM placed WHERE item_no IS NOT NULL GROUP BY ALL) h
           LEFT JOIN (SELECT * FROM clauses WHERE clause_no = 0) c USING (doc_id, item_no)
           LEFT JOIN (SELECT doc_id, item_no, min(f.seen_at) AS first_at, string_agg(n || CASE WHEN n % 100 IN (11, 12, 13) THEN 'th'
               WHEN n % 10 = 1 THEN 'st' WHEN n % 10 = 2 THEN 'nd' WHEN n % 10 = 3 THEN 'rd' ELSE 'th' END || '-amendment', ',' ORDER BY f.seen_at, f.idx, n) AS amended_by
             FROM (SELECT doc_id, item_no, n, min({'seen_at': seen_at, 'idx': idx}) AS f FROM cited GROUP BY ALL) GROUP BY ALL) a USING (doc_id, item_no)""",
        _CITED,
    ),
)
def item_context(t: Tables) -> DataFrame:
    touched = F.nullif(F.array_join("amended_by", ","), F.lit(""))
    return _segmented(t).items.select("doc_id", "item_no", "part", "section", touched.alias("amended_by"), "status")


@query(
    "parts",
    statute_sql(
        7,
        f"""SELECT doc_id, number, min(line_no) AS line_no, first(name ORDER BY line_no) AS name FROM (
              SELECT doc_id, part_run, any_value(part) AS number, min(line_no) AS line_no, string_agg(piece, ' ' ORDER BY line_no) AS name FROM (
                SELECT *, CASE WHEN is_anchor AND part_set IS NOT NULL THEN CASE part_set {" ".join(f"WHEN '{a[1]}' THEN '{a[2]}'" for a in fv.PART_NAME_ANCHORS)} END
                  WHEN names_part THEN part_line END AS piece FROM placed) WHERE piece IS NOT NULL AND part_run > 0 GROUP BY doc_id, part_run)
            GROUP BY doc_id, number""",
    ),
)
def parts(t: Tables) -> DataFrame:
    return _segmented(t).parts.select("doc_id", "number", "line_no", "name")


@query(
    "schedules",
    statute_sql(
        3,
        f"""SELECT doc_id, schedule_no, number, coalesce(title, list_filter(list_transform(string_split(text, chr(10))[1:4], lambda x: trim(x)),
              lambda x: NOT starts_with(x, '[Articles') AND length(x) > 2 AND regexp_matches(x, '[a-zA-Z]'))[1], 'Schedule ' || number) AS title, text FROM (
              SELECT doc_id, schedule_no, max(CASE WHEN is_schedule THEN coalesce(list_position({fv.SCHEDULE_WORDS}, schedule_word), {fv.SCHEDULE_ANCHORS[0][1]}) END) AS number,
                max(CASE WHEN is_schedule AND schedule_word IS NULL THEN '{fv.SCHEDULE_ANCHORS[0][2]}' END) AS title,
                coalesce(string_agg(CASE WHEN NOT is_schedule THEN regexp_replace(regexp_replace(line, '^\\d{{1,2}}\\*?\\[', '['), '^\\s+|\\s+$', '', 'g') END, chr(10) ORDER BY line_no), '') AS text
              FROM (SELECT *, sum(CASE WHEN is_schedule THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS schedule_no FROM noted)
              WHERE phase = 3 AND NOT in_note AND counts GROUP BY doc_id, schedule_no)""",
    ),
)
def schedules(t: Tables) -> DataFrame:
    return _segmented(t).schedules.select("doc_id", "schedule_no", "number", "title", "text")


@query(
    "preambles",
    statute_sql(
        3,
        """SELECT doc_id, regexp_replace(regexp_replace(string_agg(regexp_replace(t, '^\\d{1,2}\\*?\\[', '['), ' ' ORDER BY line_no), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS preamble
           FROM noted WHERE phase = 1 AND NOT in_note AND counts GROUP BY doc_id""",
    ),
)
def preambles(t: Tables) -> DataFrame:
    return _segmented(t).preambles.select("doc_id", "preamble")


@query(
    "status_counts",
    statute_sql(
        6,
        """SELECT status, count(*) AS n FROM (
             SELECT h.doc_id, h.item_no, CASE WHEN regexp_matches(coalesce(c.text, ''), '(?i)^\\[?\\s*Omitted') THEN 'omitted'
               WHEN regexp_matches(coalesce(c.text, ''), '(?i)^\\[?\\s*Repealed') THEN 'repealed'
               WHEN a.first_at <= h.last_line THEN 'amended' ELSE 'in-force' END AS status
             FROM (SELECT doc_id, item_no, max(line_no) AS last_line FROM itemized WHERE item_no IS NOT NULL GROUP BY ALL) h
             LEFT JOIN (SELECT * FROM clauses WHERE clause_no = 0) c USING (doc_id, item_no)
             LEFT JOIN (SELECT doc_id, item_no, min(seen_at) AS first_at FROM cited GROUP BY ALL) a USING (doc_id, item_no))
           GROUP BY ROLLUP (status)""",
        _CITED,
    ),
)
def status_counts(t: Tables) -> DataFrame:
    return _segmented(t).items.rollup("status").agg(F.count(F.lit(1)).alias("n"))


@query(
    "ordered_distinct_list",
    statute_sql(
        6,
        """SELECT doc_id, item_no, string_agg(CAST(n AS VARCHAR), ',' ORDER BY seen_at, idx, n) AS amendments, count(*) AS n_amendments
           FROM (SELECT doc_id, item_no, n, f.seen_at AS seen_at, f.idx AS idx FROM (
             SELECT doc_id, item_no, n, min({'seen_at': seen_at, 'idx': idx}) AS f FROM cited GROUP BY ALL))
           GROUP BY doc_id, item_no""",
        _CITED,
    ),
)
def ordered_distinct_list(t: Tables) -> DataFrame:
    touched = _segmented(t).items.filter(F.size("amended_by") > 0)
    plain = F.transform("amended_by", lambda a: F.regexp_extract(a, r"^(\d+)", 1))
    return touched.select(
        "doc_id", "item_no", F.array_join(plain, ",").alias("amendments"), F.size("amended_by").alias("n_amendments")
    )


@query(
    "citations",
    statute_sql(
        1,
        f"""SELECT c.doc_id, c.line_no, CAST(c.pos AS INTEGER) AS pos, o.n FROM (
              SELECT doc_id, line_no, unnest(ws) AS w, unnest(range(len(ws))) AS pos FROM (
                SELECT doc_id, line_no, regexp_extract_all(line, '{fv.CITATION}', 1) AS ws FROM lines)) c
            JOIN ordinals o ON lower(o.word) = lower(c.w)""",
        ORDINALS_CTE,
    ),
)
def citations(t: Tables) -> DataFrame:
    found = segment.numbered_lines(statutes(t))
    return found.select("doc_id", "line_no", F.posexplode(numbers.citations(F.col("line"))).alias("pos", "n"))


@query(
    "first_year",
    statute_sql(1, f"SELECT doc_id, nullif(regexp_extract(string_agg(line, ' ' ORDER BY line_no), '{fv.YEAR}', 1), '') AS year FROM lines GROUP BY doc_id"),
)
def first_year(t: Tables) -> DataFrame:
    flat = F.regexp_replace("text", r"[ \t]*\n", " ")
    return statutes(t).select("doc_id", text.first_year(flat).alias("year"))


@query(
    "modal_value",
    statute_sql(
        1,
        f"""SELECT act, year, n FROM (
              SELECT act, year, n, row_number() OVER (PARTITION BY act ORDER BY n DESC, first_doc, first_line) AS rn FROM (
                SELECT act, year, count(*) AS n, min(pos).d AS first_doc, min(pos).l AS first_line FROM (
                  SELECT regexp_extract(line, '{fv.CITATION_YEAR}', 1) AS act,
                    TRY_CAST(regexp_extract(line, '{fv.CITATION_YEAR}', 2) AS INTEGER) AS year,
                    {{'d': doc_id, 'l': line_no}} AS pos
                  FROM lines WHERE regexp_matches(line, '{fv.CITATION_YEAR}'))
                GROUP BY act, year)) WHERE rn = 1""",
    ),
)
def modal_value(t: Tables) -> DataFrame:
    cited = segment.numbered_lines(statutes(t)).filter(F.col("line").rlike(fv.CITATION_YEAR))
    seen = cited.select(
        F.regexp_extract("line", fv.CITATION_YEAR, 1).alias("act"),
        F.regexp_extract("line", fv.CITATION_YEAR, 2).cast("int").alias("year"),
        F.struct("doc_id", "line_no").alias("pos"),
    )
    from ..operators.aggregate import most_frequent

    return most_frequent(seen, ["act"], "year", "pos")


@query(
    "first_title",
    r"""SELECT doc_id, list_filter(list_transform(list_slice(string_split(text, chr(10)), 1, 4),
          lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')),
          lambda x: NOT starts_with(x, '[Articles') AND length(x) > 2 AND regexp_matches(x, '[a-zA-Z]'))[1] AS title
        FROM documents""",
)
def first_title(t: Tables) -> DataFrame:
    return spread(t.documents.select("doc_id", "text")).select("doc_id", segment.first_title(F.col("text")).alias("title"))


_NUMBERED = r"""numbered AS (
  SELECT doc_id, pos, TRY_CAST(regexp_extract(tok, '^(\d+)', 1) AS INTEGER) AS num, regexp_extract(tok, '^\d+([A-Z]*)', 1) AS suffix FROM (
    SELECT doc_id, unnest(toks) AS tok, unnest(range(len(toks))) AS pos FROM (
      SELECT doc_id, regexp_extract_all(string_agg(line, chr(10) ORDER BY line_no), '\b[1-9]\d{0,2}[A-Z]{0,2}\.') AS toks
      FROM lines GROUP BY doc_id)))"""


@query(
    "monotone_numbers",
    statute_sql(
        1,
        f"""SELECT doc_id, CAST(pos AS INTEGER) AS pos, num, suffix FROM (
              SELECT *, max(num) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top
              FROM numbered)
            WHERE top IS NULL OR num > top OR (num = top AND suffix <> '')""",
        _NUMBERED,
    ),
)
def monotone_numbers(t: Tables) -> DataFrame:
    from ..operators.order import monotone_contents

    return monotone_contents(statutes(t), r"\b([1-9]\d{0,2}[A-Z]{0,2})\.")


@query(
    "monotone_headings",
    statute_sql(
        2,
        """SELECT doc_id, line_no, number FROM (
             SELECT doc_id, line_no, number, num, sfx, max({'n': num, 's': sfx}) OVER (
               PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top
             FROM (SELECT *, TRY_CAST(regexp_extract(number, '^\\d+') AS INTEGER) AS num, regexp_extract(number, '[A-Z]*$') AS sfx
                   FROM flags WHERE wins))
           WHERE top IS NULL OR num > top.n OR (num = top.n AND sfx > top.s)""",
    ),
)
def monotone_headings(t: Tables) -> DataFrame:
    from ..operators.order import monotone_rows

    headed = segment.classify_lines(segment.numbered_lines(statutes(t))).filter("wins").select("doc_id", "line_no", "number")
    return monotone_rows(headed, "doc_id", "line_no", "number").select("doc_id", "line_no", "number")


@query(
    "heading_names",
    statute_sql(
        2,
        r"""SELECT doc_id, line_no, structure AS heading, CASE
              WHEN n1 IS NOT NULL AND c1 THEN n1 WHEN n2 IS NOT NULL AND c2 THEN n2 END AS name FROM (
              SELECT doc_id, line_no, is_part, structure,
                lead(regexp_replace(t, '\.+$', '')) OVER w AS n1, lead(usable) OVER w AS c1,
                lead(regexp_replace(t, '\.+$', ''), 2) OVER w AS n2, lead(usable, 2) OVER w AS c2
              FROM (SELECT *, NOT is_blank AND NOT is_page AND NOT is_part AND number IS NULL AND NOT footnote_clean
                      AND length(regexp_replace(t, '\.+$', '')) >= 3 AS usable FROM flags)
              WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)) WHERE is_part""",
    ),
)
def heading_names(t: Tables) -> DataFrame:
    from ..operators.order import names_below

    flagged = segment.classify_lines(segment.numbered_lines(statutes(t).repartition("doc_id")))
    name = F.regexp_replace(text.strip(F.col("line")), r"\.+$", "")
    usable = (
        ~F.col("is_blank") & ~F.col("is_page") & ~F.col("is_part") & F.col("number").isNull() & ~F.col("footnote_clean") & (F.length(name) >= 3)
    )
    return names_below(flagged, "doc_id", "line_no", F.col("is_part"), name, usable).select(
        "doc_id", "line_no", F.col("structure").alias("heading"), "name"
    )
