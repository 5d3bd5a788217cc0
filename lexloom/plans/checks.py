"""Queries on sources, schemas, prose rules and change detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import prose, text
from ..operators import changes, quality
from ..session import checkpointed
from ..sources import json_walk, manifest, sinks
from ..sources.tables import page_subset, spread, text_map
from .registry import Tables, query
from .texts import _VISIBLE, JUDGED, LATIN, SOUNDS, _TRIM

# --- sources ------------------------------------------------------------------


@query("json_scan", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_scan(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "int").alias("k"))


@query(
    "json_map_explode",
    "SELECT event_id, unnest(json_keys(props)) AS key, json_extract_string(props, '$.' || unnest(json_keys(props))) AS value FROM events",
)
def json_map_explode(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.explode(text_map(F.col("props"))).alias("key", "value"))


@query(
    "nested_flatten",
    """SELECT doc_id, CAST(i AS INTEGER) AS pos, l AS text, 'clause' AS kind FROM (
         SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)""",
)
def nested_flatten(t: Tables) -> DataFrame:
    schema = "articles array<struct<number: bigint, clauses: array<struct<text: string, kind: string>>>>"
    clauses = F.transform(F.split("text", "\n"), lambda l: F.struct(l.alias("text")))
    document = F.to_json(F.struct(F.array(F.struct(F.col("doc_id").alias("number"), clauses.alias("clauses"))).alias("articles")))
    read = spread(t.documents).select(F.from_json(document, schema).alias("d")).select(F.inline("d.articles"))
    flat = read.select(F.col("number").alias("doc_id"), F.posexplode_outer("clauses").alias("pos", "c"))
    return flat.select("doc_id", "pos", "c.text", F.coalesce("c.kind", F.lit("clause")).alias("kind"))


@query(
    "markup_rows",
    """SELECT CAST(o_custkey % 999 + 1 AS INTEGER) AS n, CAST(max_by(year(o_orderdate), o_orderkey) AS INTEGER) AS year FROM orders
       WHERE o_orderpriority <> '5-LOW' GROUP BY 1""",
)
def markup_rows(t: Tables) -> DataFrame:
    from ..functions.numbers import ordinal_suffix

    n = F.col("o_custkey") % 999 + 1
    date = F.when(F.col("o_orderpriority") == "5-LOW", "not dated").otherwise(F.date_format("o_orderdate", "d MMMM yyyy"))
    line = F.concat(
        F.lit("| [[Forty-second Amendment of the Code|"), ordinal_suffix(n), F.lit("]] || <ref name=a>2 June 1911</ref><ref name=b/> || "), date
    )
    # Lines of other shapes stay in and must be passed over.
    lines = t.orders.select(
        "o_orderkey", F.explode(F.array(line, F.lit("|-"), F.lit("! 1st || 1 May 1950"))).alias("line")
    )
    return manifest.dated_rows(lines, "line", "o_orderkey", "Amendment of the Code")


@query(
    "variant_walk",
    """SELECT p_partkey, id, max_by(txt, o) AS text FROM (
         SELECT p_partkey, CAST(p_size AS VARCHAR) AS id, p_name AS txt, 0 AS o FROM part
         UNION ALL SELECT p_partkey, CAST(p_partkey % 60 AS VARCHAR) || 'A', p_type, 1 FROM part
         UNION ALL SELECT p_partkey, CAST(p_partkey % 60 AS VARCHAR), p_brand, 2 FROM part
         UNION ALL SELECT p_partkey, CAST(p_partkey % 7 AS VARCHAR), p_type || ' ' || p_name, 3 FROM part) GROUP BY p_partkey, id""",
)
def variant_walk(t: Tables) -> DataFrame:
    """Fields in no order, one repeated in its object, one object repeated as a field: the last one read wins."""
    as_text = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r"^\{\"x\":(.*)\}$", 1)
    cast = lambda c: c.cast("string")
    name, kind, brand = (as_text(F.col(f"p_{c}")) for c in ("name", "type", "brand"))
    box = as_text(F.concat("p_type", F.lit(" "), "p_name"))
    key, size = F.col("p_partkey"), F.col("p_size")
    source = t.part.select(
        "p_partkey",
        F.format_string(
            '{"Parts": [{"ArtNo": " %s", "ArtDesc": "dropped", "Sub": {"List": [{"ArtDesc": %s, "ArtNo": "%sA"}]}, "ArtDesc": %s,'
            ' "Tail": {"ArtNo": "%s", "ArtDesc": "never read"}, "Ahead": {"ArtNo": 5, "ArtDesc": "no text"}, "Tail": {"Deep": {"ArtNo": "%s", "ArtDesc": %s}}}],'
            ' "ArtNo": 1, "A": [[], {}, {"ArtDesc": %s, "ArtNo": "%s "}]}',
            cast(size), kind, cast(key % 60), name, cast(size), cast(key % 60), brand, box, cast(key % 7),
        ).alias("json"),
    )
    return json_walk.keyed_texts(source, "p_partkey", "json", "ArtNo", "ArtDesc", r"\d{1,3}[A-Z]?")


@query("resume_pending", "SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_pending(t: Tables) -> DataFrame:
    return manifest.pending(t.documents.select("doc_id", "n_chars"), t.labels, "doc_id")


@query(
    "source_fingerprint",
    """SELECT page_id, strlen(html)::BIGINT AS size FROM pages
       WHERE contains(html, 'lang="fr"') OR contains(url, '.org') OR page_id % 7 = 3""",
)
def source_fingerprint(t: Tables) -> DataFrame:
    """Pages as sources against an older manifest: French ones were not there, .org ones were shorter, some are newer now."""
    key = F.col("page_id")
    current = t.pages.select(
        "page_id",
        "url",
        key.cast("string").alias("path"),
        F.octet_length("html").cast("long").alias("size"),
        F.timestamp_seconds(key).alias("modified"),
        F.contains("html", F.lit('lang="fr"')).alias("fresh"),
    )
    recorded = current.filter(~F.col("fresh")).select(
        "path",
        (F.col("size") - F.contains("url", F.lit(".org")).cast("int")).alias("size"),
        F.when(key % 7 == 3, F.timestamp_seconds(key - 1)).otherwise(F.col("modified")).alias("modified"),
    )
    return manifest.stale_sources(current, recorded).select("page_id", "size")


@query("range_scan", "SELECT page_id, url FROM pages WHERE page_id BETWEEN 63 AND 574 AND page_id % 2 = 1")
def range_scan(t: Tables) -> DataFrame:
    # The page range and the odd pages are what this operator selects by.
    return page_subset(t.pages.select("page_id", "url"), "page_id", 63, 574)


@query(
    "item_metadata_json",
    """SELECT p_partkey, '{"@type":"Legislation","name":"' || p_name || '","legislationIdentifier":"Article ' || CAST(p_partkey AS VARCHAR)
         || '","isPartOf":{"@type":"Legislation","name":"' || p_brand || '"},"position":' || CAST(p_size AS VARCHAR) || '}' AS metadata FROM part""",
)
def item_metadata_json(t: Tables) -> DataFrame:
    kind = F.lit("Legislation").alias("@type")
    identifier = F.concat(F.lit("Article "), F.col("p_partkey").cast("string"))
    record = F.struct(
        kind,
        F.col("p_name").alias("name"),
        identifier.alias("legislationIdentifier"),
        F.struct(kind, F.col("p_brand").alias("name")).alias("isPartOf"),
        F.col("p_size").alias("position"),
    )
    return t.part.select("p_partkey", F.to_json(record).alias("metadata"))


@query(
    "content_hash",
    """SELECT count(*) AS n, sum(('0x' || substr(md5(to_json({'doc_id': doc_id, 'lang': lang, 'n_chars': n_chars, 'source': source, 'text': text})), 1, 15))::BIGINT) AS digest
       FROM documents""",
)
def content_hash(t: Tables) -> DataFrame:
    """The digest an idempotent rewrite is checked with, over whole texts."""
    return sinks.content_hash(spread(t.documents))


# --- schemas and datasets -----------------------------------------------------


@query(
    "schema_errors",
    """SELECT o_orderkey, unnest(fields) AS field, unnest(messages) AS message FROM (
         SELECT o_orderkey, list_filter([CASE WHEN NOT o_orderstatus IN ('O', 'F') THEN 'o_orderstatus' END,
             CASE WHEN NOT regexp_matches(o_orderpriority, '^[1-4]-[A-Z ]+$') THEN 'o_orderpriority' END,
             CASE WHEN NOT coalesce(o_totalprice BETWEEN 1000 AND 400000, false) THEN 'o_totalprice' END], lambda x: x IS NOT NULL) AS fields,
           list_filter([CASE WHEN NOT o_orderstatus IN ('O', 'F') THEN 'must be one of O, F' END,
             CASE WHEN NOT regexp_matches(o_orderpriority, '^[1-4]-[A-Z ]+$') THEN 'must look like 1-URGENT' END,
             CASE WHEN NOT coalesce(o_totalprice BETWEEN 1000 AND 400000, false) THEN 'must be 1000 to 400000' END], lambda x: x IS NOT NULL) AS messages
         FROM orders)""",
)
def schema_errors(t: Tables) -> DataFrame:
    rules = [
        quality.one_of("o_orderstatus", ["O", "F"]),
        quality.matches("o_orderpriority", r"^[1-4]-[A-Z ]+$", "must look like 1-URGENT"),
        quality.between("o_totalprice", 1000, 400000),
    ]
    return quality.schema_errors(t.orders, ["o_orderkey"], rules)


@query(
    "dataset_rules",
    f"""WITH d AS (SELECT n_nationkey AS doc_id, CASE WHEN n_regionkey = 0 THEN ' ' ELSE n_name END AS preamble FROM nation),
        i AS (SELECT c_nationkey AS doc_id, CAST(c_custkey % 400 AS VARCHAR) AS number, CAST(c_custkey % 30 AS VARCHAR) AS part,
          CASE WHEN c_custkey % 17 = 0 THEN '' ELSE c_name END AS title, c_custkey % 13 AS n_clauses FROM customer),
        p AS (SELECT s_nationkey AS doc_id, CAST(s_suppkey % 30 AS VARCHAR) AS number, CASE WHEN s_suppkey % 5 = 0 THEN ' ' ELSE s_name END AS name FROM supplier),
        s AS (SELECT n_nationkey AS doc_id, n_nationkey AS number, n_name AS title, CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE n_name END AS text FROM nation)
        SELECT doc_id, 'error' AS severity, 'preamble' AS rule, '' AS detail FROM d WHERE trim(preamble) = ''
        UNION ALL SELECT doc_id, 'error', 'parts', CAST(n AS VARCHAR) FROM (SELECT d.doc_id, count(p.doc_id) AS n FROM d LEFT JOIN p USING (doc_id) GROUP BY 1) WHERE n < {fv.MIN_PARTS}
        UNION ALL SELECT doc_id, 'error', 'schedules', CAST(n AS VARCHAR) FROM (SELECT d.doc_id, count(s.doc_id) AS n FROM d LEFT JOIN s USING (doc_id) GROUP BY 1) WHERE n < {fv.MIN_SCHEDULES}
        UNION ALL SELECT doc_id, 'error', 'duplicate', number FROM i GROUP BY doc_id, number HAVING count(*) > 1
        UNION ALL SELECT doc_id, 'error', 'unknown part', number FROM i WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.doc_id = i.doc_id AND p.number = i.part)
        UNION ALL SELECT doc_id, 'error', 'no clauses', number FROM i WHERE n_clauses = 0
        UNION ALL SELECT doc_id, 'error', 'empty title', number FROM i WHERE title = ''
        UNION ALL SELECT doc_id, 'error', 'landmark', l FROM (SELECT doc_id, unnest({fv.LANDMARK_ITEMS!r}) AS l FROM d) x
          WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.doc_id = x.doc_id AND i.number = x.l)
        UNION ALL SELECT doc_id, 'warning', 'part name', number FROM p WHERE trim(name) = ''
        UNION ALL SELECT doc_id, 'warning', 'schedule text', CAST(number AS VARCHAR) FROM s WHERE text = ''""",
)
def dataset_rules(t: Tables) -> DataFrame:
    docs = t.nation.select(
        F.col("n_nationkey").alias("doc_id"), F.when(F.col("n_regionkey") == 0, " ").otherwise(F.col("n_name")).alias("preamble")
    )
    key = F.col("c_custkey")
    items = t.customer.select(
        F.col("c_nationkey").alias("doc_id"),
        (key % 400).cast("string").alias("number"),
        (key % 30).cast("string").alias("part"),
        F.when(key % 17 == 0, "").otherwise(F.col("c_name")).alias("title"),
        (key % 13).alias("n_clauses"),
    )
    supplier = F.col("s_suppkey")
    parts = t.supplier.select(
        F.col("s_nationkey").alias("doc_id"),
        (supplier % 30).cast("string").alias("number"),
        F.when(supplier % 5 == 0, " ").otherwise(F.col("s_name")).alias("name"),
    )
    schedules = t.nation.select(
        F.col("n_nationkey").alias("doc_id"),
        F.col("n_nationkey").alias("number"),
        F.col("n_name").alias("title"),
        F.when(F.col("n_nationkey") % 2 == 0, "").otherwise(F.col("n_name")).alias("text"),
    )
    return quality.dataset_rules(docs, items, parts, schedules)


# --- prose --------------------------------------------------------------------

_SAID = "CASE WHEN turn % 3 = 0 THEN text || ' Moreover, we delve — on.' ELSE text END"


@query(
    "prose_lint",
    rf"""WITH c AS (SELECT conv_id, turn, {_TRIM.format("(" + _SAID + ")")} AS x FROM conversations),
         w AS (SELECT conv_id, turn, regexp_replace(lower(unnest(regexp_extract_all(x, '\S+'))), '[^a-z]', '', 'g') AS clean FROM c),
         s AS (SELECT conv_id, turn, count(*) AS words, sum(CASE WHEN length(clean) <= 3 THEN 1 ELSE greatest(1, len(regexp_extract_all(
             regexp_replace(regexp_replace(clean, '(?:[^laeiouy]es|ed|[^laeiouy]e)$', ''), '^y', ''), '[aeiouy]{{1,2}}'))) END) AS syl FROM w GROUP BY ALL),
         n AS (SELECT c.*, coalesce(words, 0) AS words, coalesce(syl, 0) AS syl,
           greatest(1, len(list_filter(regexp_split_to_array(x, '[.!?]+'), lambda q: regexp_matches(q, '\S')))) AS sents FROM c LEFT JOIN s USING (conv_id, turn)),
         g AS (SELECT *, 0.39::DOUBLE * words / sents + 11.8::DOUBLE * syl / greatest(words, 1) - 15.59::DOUBLE AS grade FROM n)
         SELECT conv_id, turn, 'length' AS rule, 'explainer is ' || CAST(words AS VARCHAR) || ' words; wanted are 40 to 140' AS message FROM g WHERE words NOT BETWEEN 40 AND 140
         UNION ALL SELECT conv_id, turn, 'banned-phrase', 'uses the worn phrase "' || p || '"' FROM (SELECT conv_id, turn, x, unnest([{", ".join("'" + p.replace("'", "''") + "'" for p in fv.BANNED_PHRASES)}]) AS p FROM g) WHERE contains(lower(x), p)
         UNION ALL SELECT conv_id, turn, 'dash', 'has a long dash' FROM g WHERE regexp_matches(x, '[–—]')
         UNION ALL SELECT conv_id, turn, 'reading-level', 'reading grade ' || printf('%.1f', grade) || ' lies outside 5 to 11' FROM g WHERE words >= 20 AND grade NOT BETWEEN 5 AND 11""",
)
def prose_lint(t: Tables) -> DataFrame:
    said = F.when(F.col("turn") % 3 == 0, F.concat("text", F.lit(" Moreover, we delve — on."))).otherwise(F.col("text"))
    return spread(t.conversations).select("conv_id", "turn", F.inline(prose.lint(said)))


@query(
    "prose_lint_lang",
    rf"""WITH c AS (SELECT conv_id, turn, {_TRIM.format("translate(lower(text), '" + LATIN + ".', '" + SOUNDS + "।')")} || CASE WHEN turn % 4 = 0 THEN ' आइए -- ' ELSE '' END AS y FROM conversations),
         b AS (SELECT conv_id, turn, {_TRIM.format("y")} AS x FROM c),
         n AS (SELECT *, len(regexp_extract_all(x, '\S+')) AS words, len(list_filter(regexp_split_to_array(x, '[।!?]'), lambda q: regexp_matches(q, '\S'))) AS sents FROM b),
         hi AS (SELECT (conv_id, turn) AS doc_id, x AS text FROM n), {JUDGED},
         bad AS (SELECT doc_id, count(*) AS k, arg_min(rule, i) AS first_rule FROM judged WHERE rule IS NOT NULL GROUP BY doc_id)
         SELECT conv_id, turn, 'length' AS rule, 'explainer is ' || CAST(words AS VARCHAR) || ' words; wanted are 30 to 110' AS message FROM n WHERE words NOT BETWEEN 30 AND 110
         UNION ALL SELECT conv_id, turn, 'banned-phrase', 'filler: ' || p FROM (SELECT conv_id, turn, x, unnest([{", ".join("'" + p + "'" for p in fv.BANNED_PHRASES_HI)}]) AS p FROM n) WHERE contains(x, p)
         UNION ALL SELECT conv_id, turn, 'dash', 'a long or double dash stands where a comma would do' FROM n WHERE regexp_matches(x, '[—–]|--')
         UNION ALL SELECT conv_id, turn, 'plainness', CAST(sents AS VARCHAR) || ' sentences, more than 7' FROM n WHERE sents > 7
         UNION ALL SELECT conv_id, turn, 'plainness', 'sentences average ' || printf('%.1f', words / sents) || ' words, more than 22' FROM n WHERE sents > 0 AND words / sents > 22
         UNION ALL SELECT doc_id[1], doc_id[2], 'devanagari', CAST(k AS VARCHAR) || ' faults of script, first ' || first_rule FROM bad
         UNION ALL SELECT conv_id, turn, 'language', 'less than half is Devanagari' FROM n
           WHERE len(regexp_extract_all(x, '[\x{{0900}}-\x{{097F}}]')) / greatest(length(x), 1) < 0.5""",
)
def prose_lint_lang(t: Tables) -> DataFrame:
    spoken = text.strip(F.translate(F.lower("text"), LATIN + ".", SOUNDS + "।"))
    spoken = F.concat(spoken, F.when(F.col("turn") % 4 == 0, " आइए -- ").otherwise(""))
    return spread(t.conversations).select("conv_id", "turn", F.inline(prose.lint_hindi(spoken)))


# --- changes ------------------------------------------------------------------

# The second snapshot is derived from the first by what a page says of itself:
# mobile hosts are unreachable now, .org pages were different, French pages are new.
_SNAPSHOT = rf"""shown AS (SELECT url, html, {_VISIBLE} AS body, regexp_extract(html, '(?i)<title>([^<]*)</title>', 1) AS title FROM pages),
    cur AS (SELECT url, title, CASE WHEN NOT regexp_matches(url, '//m\.') THEN body END AS body, CASE WHEN NOT regexp_matches(url, '//m\.') THEN html END AS html FROM shown),
    prev AS (SELECT url, sha256(CASE WHEN contains(url, '.org') THEN body || ' old' ELSE body END) AS hash FROM shown WHERE NOT contains(html, 'lang="fr"')
      UNION ALL SELECT 'https://gone.example/', sha256('gone'))"""
_STATES = (
    _SNAPSHOT
    + """,
    states AS (SELECT url, CASE WHEN c.url IS NULL THEN 'dropped' WHEN body IS NULL THEN 'unreachable' WHEN hash IS NULL THEN 'new'
        WHEN hash <> sha256(body) THEN 'changed' ELSE 'same' END AS state, coalesce(sha256(body), hash) AS hash
      FROM cur c FULL OUTER JOIN prev p USING (url))"""
)


def _snapshots(t: Tables) -> DataFrame:
    """(url, title, hash, links, lang, before) per page, hash and links null where it is unreachable now.

    Pages are read once: what the two snapshots say of them is narrow, and written before it is compared.
    """
    body, html = text.visible_text(F.col("html")), F.col("html")
    reachable = ~F.col("url").rlike(r"//m\.")
    old = F.when(F.contains("url", F.lit(".org")), F.concat("body", F.lit(" old"))).otherwise(F.col("body"))
    lang = F.when(F.contains(html, F.lit('lang="en"')), "en").when(F.contains(html, F.lit('lang="de"')), "de")
    shown = spread(t.pages).withColumn("body", body)
    return checkpointed(
        shown.select(
            "url",
            text.html_title(html).alias("title"),
            F.when(reachable, F.sha2("body", 256)).alias("hash"),
            F.when(reachable, text.page_links(html, None)).alias("links"),
            lang.alias("lang"),
            F.when(~F.contains(html, F.lit('lang="fr"')), F.sha2(old, 256)).alias("before"),
        )
    )


def _previous(t: Tables, pages: DataFrame) -> DataFrame:
    gone = t.spark.createDataFrame([("https://gone.example/",)], "url string").select("url", F.sha2(F.lit("gone"), 256).alias("hash"))
    return pages.where("before is not null").select("url", F.col("before").alias("hash")).unionByName(gone)


@query("page_changes", f"WITH {_STATES} SELECT url, state, hash FROM states")
def page_changes(t: Tables) -> DataFrame:
    pages = _snapshots(t)
    return changes.page_states(pages, _previous(t, pages))


_LINKS = """links AS (SELECT url, unnest(regexp_extract_all(html, '(?i)href="([^"]+)"', 1)) AS link, html FROM cur WHERE html IS NOT NULL),
    known AS (SELECT DISTINCT link FROM links WHERE contains(html, 'lang="en"') UNION SELECT DISTINCT link FROM links WHERE contains(html, 'lang="de"')),
    fresh AS (SELECT DISTINCT link FROM links WHERE link NOT IN (SELECT link FROM known))"""


def _known_links(pages: DataFrame, lang: str) -> DataFrame:
    return pages.where(F.col("lang") == lang).select(F.explode("links").alias("link"))


@query("new_links", f"WITH {_SNAPSHOT}, {_LINKS} SELECT link FROM fresh")
def new_links(t: Tables) -> DataFrame:
    pages = _snapshots(t)
    found = pages.select(F.explode("links").alias("link"))
    return changes.unseen_links(found, _known_links(pages, "en"), _known_links(pages, "de"))


_FLAGS = rf"""{_STATES}, {_LINKS},
    leads AS (SELECT p_partkey, CASE WHEN p_type <> 'ECONOMY' THEN p_size END AS n FROM part),
    flags AS (
      SELECT 'index-page-unreachable' AS kind, url AS key, 'index page could not be fetched; review manually' AS detail FROM cur WHERE html IS NULL
      UNION ALL SELECT 'new-edition', link, link FROM fresh
      UNION ALL SELECT 'count-moved', CAST(p_partkey AS VARCHAR), 'lead now says ' || CAST(n AS VARCHAR) || ' amendments; expected 25' FROM leads WHERE n > 25
      UNION ALL SELECT 'count-unknown', CAST(p_partkey AS VARCHAR), 'could not read the count; review manually' FROM leads WHERE n IS NULL
      UNION ALL SELECT 'page-unreachable', url, title || ' (' || url || ') could not be fetched' FROM states JOIN cur USING (url) WHERE state = 'unreachable'
      UNION ALL SELECT 'page-changed', url, title || ' page changed since the last check (' || url || ')' FROM states JOIN cur USING (url) WHERE state = 'changed')"""


def _flags(t: Tables) -> DataFrame:
    pages = _snapshots(t)
    lead = F.when(F.col("p_type") == "ECONOMY", "no number here").otherwise(
        F.concat(F.lit("there have been "), F.col("p_size").cast("string"), F.lit(" amendments to "), "p_name")
    )
    leads = t.part.select("p_partkey", lead.alias("lead"))
    found = changes.index_flags(pages, _known_links(pages, "en"), _known_links(pages, "de"))
    found = found.unionByName(changes.count_flags(leads, "p_partkey", "lead", F.lit(25)))
    return found.unionByName(changes.page_flags(changes.page_states(pages, _previous(t, pages)), pages))


@query("change_flags", f"WITH {_FLAGS} SELECT kind, key, detail FROM flags")
def change_flags(t: Tables) -> DataFrame:
    return _flags(t)


@query(
    "flag_report",
    f"""WITH {_FLAGS}, head AS (
          SELECT CAST(i AS INTEGER) AS section, l AS line FROM (SELECT unnest(['# Source check report', '', 'Checked: 2025-06-30', '', '{changes.REPORT_NOTE}', '',
            '{changes.REPORT_FIRST}', '']) AS l, unnest(range(8)) AS i))
        SELECT * FROM head
        UNION ALL SELECT list_position({changes.FLAG_KINDS!r}, kind) + {changes.FIRST_FLAG}, '- **' || kind || '**: ' || detail FROM flags
        UNION ALL SELECT s, l FROM (SELECT unnest([8, 9, 98, 99]) AS s, unnest(['## Changes detected', '', '', '{changes.REPORT_ASKS}']) AS l) WHERE EXISTS (FROM flags)
        UNION ALL SELECT 99, '{changes.REPORT_SOUND}' WHERE NOT EXISTS (FROM flags)""",
)
def flag_report(t: Tables) -> DataFrame:
    return changes.report_lines(_flags(t), "2025-06-30", first_run=True).orderBy("section", "line")


@query(
    "staleness",
    "SELECT event_type, CAST(CAST(max(ts) AS DATE) AS VARCHAR) AS latest, DATE '2025-06-30' - CAST(max(ts) AS DATE) AS days FROM events GROUP BY event_type",
)
def staleness(t: Tables) -> DataFrame:
    return changes.staleness(t.events, "event_type", "ts", F.lit("2025-06-30").cast("date"))


@query(
    "snapshot_states",
    """WITH h AS (SELECT CAST(user_id AS VARCHAR) AS url, ts, event_id, CASE WHEN event_type <> 'error' THEN sha256(event_type) END AS hash FROM events),
       p AS (SELECT *, last_value(hash IGNORE NULLS) OVER (PARTITION BY url ORDER BY ts, coalesce(hash, '~') ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM h)
       SELECT url, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS at, CASE WHEN hash IS NULL THEN 'unreachable' WHEN before IS NULL THEN 'new' WHEN before = hash THEN 'same' ELSE 'changed' END AS state,
         coalesce(hash, before) AS hash FROM p""",
)
def snapshot_states(t: Tables) -> DataFrame:
    """The stream's judgement of a series of snapshots per url, as one batch."""
    from ..streaming.detector import judge

    body = F.when(F.col("event_type") != "error", F.col("event_type"))
    snapshots = t.events.select(F.col("user_id").cast("string").alias("url"), F.col("ts").cast("timestamp").alias("ts"), body.alias("body"))
    none = t.spark.createDataFrame([], "url string, hash string, ts timestamp")
    return judge(snapshots, none).select("url", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"), "state", "hash")
