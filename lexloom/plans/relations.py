"""Queries with joins, grouped picks and ordered views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import text
from ..functions.let import constant_array
from ..operators import aggregate, edition, scan, views
from ..sources.tables import spread
from .registry import Tables, query


@query(
    "item_parent",
    "SELECT s_suppkey, s_nationkey, coalesce(n_name, '') AS parent_name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey",
)
def item_parent(t: Tables) -> DataFrame:
    return edition.with_parent(t.supplier.select("s_suppkey", "s_nationkey"), "s_nationkey", t.nation, "n_nationkey", "n_name")


@query(
    "siblings",
    """SELECT c_nationkey, c_custkey, row_number() OVER w AS position, count(*) OVER (PARTITION BY c_nationkey) AS n_siblings,
         lag(c_custkey) OVER w AS prev_c_custkey, lead(c_custkey) OVER w AS next_c_custkey
       FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey)""",
)
def siblings(t: Tables) -> DataFrame:
    return views.siblings(t.customer.select("c_nationkey", "c_custkey"), "c_nationkey", "c_custkey")


def _amended_parts(t: Tables) -> DataFrame:
    lists = F.array(F.col("p_size").cast("long"), F.col("p_partkey") % 50 + 1)
    return t.part.select(F.col("p_partkey").alias("item"), lists.alias("amended_by"))


_AFFECTED = """a AS (SELECT DISTINCT p_partkey AS item, unnest([CAST(p_size AS BIGINT), p_partkey % 50 + 1]) AS event FROM part)"""


@query(
    "affected_items",
    f"""WITH {_AFFECTED} SELECT event, count(*) AS n_items, min(item) AS first_item, max(item) AS last_item,
          CASE WHEN bool_or(item BETWEEN 352 AND 360) THEN 'emergency' WHEN bool_or(item BETWEEN 12 AND 35) THEN 'rights'
            WHEN bool_or(item = 243 OR item BETWEEN 330 AND 342) THEN 'social'
            WHEN bool_or(item BETWEEN 52 AND 151 OR item BETWEEN 245 AND 312 OR item BETWEEN 214 AND 231) THEN 'federal'
            ELSE 'general' END AS theme,
          'Amends ' || CAST(count(*) AS VARCHAR) || CASE WHEN count(*) = 1 THEN ' item' ELSE ' items' END
            || ' of the text in force.' AS summary
        FROM a GROUP BY event""",
)
def affected_items(t: Tables) -> DataFrame:
    return views.event_summary(views.affected_items(_amended_parts(t), "item", "amended_by"))


@query(
    "affected_list",
    f"WITH {_AFFECTED} SELECT event, item, row_number() OVER (PARTITION BY event ORDER BY item) AS position FROM a",
)
def affected_list(t: Tables) -> DataFrame:
    return scan.number_rows(views.affected_items(_amended_parts(t), "item", "amended_by"), ["event"], "item", "position")


@query(
    "edition_merge",
    """SELECT doc_id, lang, coalesce(quality, -1) AS quality, coalesce(toxic, 0) AS toxic FROM documents LEFT JOIN labels USING (doc_id)""",
)
def edition_merge(t: Tables) -> DataFrame:
    return edition.merge_editions(
        t.documents.select("doc_id", "lang"), t.labels, "doc_id", {"quality": F.lit(-1), "toxic": F.lit(0)}
    )


@query(
    "missing_keys",
    """SELECT doc_id, 'left' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
       UNION ALL SELECT doc_id, 'right' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""",
)
def missing_keys(t: Tables) -> DataFrame:
    return edition.key_differences(t.documents.select("doc_id"), t.labels.select("doc_id"), "doc_id")


@query(
    "synthesize_missing",
    f"""SELECT doc_id, quality, 'printed' AS origin FROM labels
        UNION ALL SELECT doc_id, 0, 'omitted' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
          AND (SELECT count(*) FROM nation) >= {fv.SYNTHETIC_MIN_PARTS}""",
)
def synthesize_missing(t: Tables) -> DataFrame:
    printed = t.labels.select("doc_id", "quality").withColumn("origin", F.lit("printed"))
    enough = t.nation.agg(F.count(F.lit(1)) >= fv.SYNTHETIC_MIN_PARTS).scalar()
    fill = {"quality": F.lit(0), "origin": F.lit("omitted")}
    return edition.synthesize_missing(printed, t.documents.select("doc_id"), "doc_id", fill, enough)


@query("orphans", "SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT s_suppkey FROM supplier)")
def orphans(t: Tables) -> DataFrame:
    return edition.orphans(t.events.select("event_id", "user_id"), "user_id", t.supplier, "s_suppkey")


@query(
    "attach_side_text",
    """SELECT doc_id, CASE WHEN toxic = 0 THEN 'quality ' || CAST(quality AS VARCHAR) END AS explainer,
         coalesce(toxic = 0, false) AS covered FROM documents LEFT JOIN labels USING (doc_id)""",
)
def attach_side_text(t: Tables) -> DataFrame:
    note = F.when(F.col("toxic") == 1, "  ").otherwise(F.concat(F.lit("quality "), F.col("quality").cast("string")))
    return edition.attach_side_text(t.documents.select("doc_id"), t.labels.select("doc_id", note.alias("explainer")), "doc_id", "explainer")


_WORDS = r"""list_distinct(list_filter(regexp_extract_all(regexp_replace(regexp_replace(lower(text), '\d{1,2}\[', ' ', 'g'),
    '[\]\[()“”".,;:—⎯–-]', ' ', 'g'), '\S+'), lambda w: length(w) > 1))"""


@query(
    "crosscheck_jaccard",
    f"""WITH d AS (SELECT doc_id AS item_id, {_WORDS} AS a FROM documents), b AS (SELECT item_id, {_WORDS} AS b FROM benchmark),
        j AS (SELECT item_id, a, b, len(list_intersect(a, b)) AS n FROM d FULL OUTER JOIN b USING (item_id)),
        s AS (SELECT item_id, CASE WHEN b IS NULL THEN 'left only' WHEN a IS NULL THEN 'right only' ELSE 'common' END AS presence,
          CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0
            ELSE CAST(n AS DOUBLE) / (len(a) + len(b) - n) END END AS s FROM j)
        SELECT item_id, presence, round(s, 3) AS similarity, coalesce(s < 0.8, false) AS flagged FROM s""",
)
def crosscheck_jaccard(t: Tables) -> DataFrame:
    docs = spread(t.documents.select(F.col("doc_id").alias("item_id"), "text"))
    outside = t.benchmark.select("item_id", F.col("text").alias("other"))
    return edition.crosscheck(docs, outside, "item_id", "text", "other", fv.SIMILARITY_THRESHOLD)


@query(
    "positional_zip",
    """WITH l AS (SELECT c_custkey AS "left", row_number() OVER (ORDER BY c_custkey) AS position FROM customer),
            r AS (SELECT k AS "right", row_number() OVER (ORDER BY k) AS position FROM (SELECT DISTINCT o_custkey AS k FROM orders))
       SELECT position, "left", "right", "left" IS DISTINCT FROM "right" AS changed FROM l FULL OUTER JOIN r USING (position)""",
)
def positional_zip(t: Tables) -> DataFrame:
    zipped = edition.positional_zip(t.customer, "c_custkey", t.orders.select("o_custkey").distinct(), "o_custkey")
    return zipped.withColumn("changed", ~F.col("left").eqNullSafe(F.col("right")))


@query(
    "coalesce_sources",
    """SELECT c_custkey AS key, coalesce(f.y, CASE c_custkey WHEN 2 THEN 1952 WHEN 6 THEN 1956 END, a.y) AS year
       FROM customer LEFT JOIN (SELECT o_custkey AS k, max(year(o_orderdate)) AS y FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) f ON f.k = c_custkey
       LEFT JOIN (SELECT o_custkey AS k, min(year(o_orderdate)) AS y FROM orders GROUP BY 1) a ON a.k = c_custkey""",
)
def coalesce_sources(t: Tables) -> DataFrame:
    year = F.year("o_orderdate")
    by_key = t.orders.groupBy(F.col("o_custkey").alias("key"))
    # One pass over orders serves both the computed and the fallback source.
    both = by_key.agg(F.max(F.when(F.col("o_orderstatus") == "F", year)).alias("computed"), F.min(year).alias("fallback"))
    override = t.spark.createDataFrame([(2, 1952), (6, 1956)], "key long, override int")
    keys = t.customer.select(F.col("c_custkey").alias("key"))
    return edition.first_available(keys, "key", [(both, "computed"), (override, "override"), (both, "fallback")], "year")


@query(
    "resolve_refs",
    """WITH r AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'article' WHEN 'click' THEN 'part' WHEN 'purchase' THEN 'amendment' ELSE 'page' END AS type,
         CASE event_type WHEN 'view' THEN CAST(user_id AS VARCHAR) WHEN 'click' THEN CAST(user_id * 3 AS VARCHAR)
           WHEN 'purchase' THEN CAST(event_id AS VARCHAR) ELSE '/' || event_type || '/' END AS value FROM events),
       k AS (SELECT 'article' AS type, CAST(s_suppkey AS VARCHAR) AS value FROM supplier UNION ALL SELECT 'part', CAST(p_partkey AS VARCHAR) FROM part
         UNION ALL SELECT 'amendment', CAST(c_custkey AS VARCHAR) FROM customer UNION ALL SELECT 'page', '/error/')
       SELECT event_id, type, value FROM r WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.type = r.type AND k.value = r.value)""",
)
def resolve_refs(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    pages = t.spark.createDataFrame([("/error/",)], "path string")
    refs = t.events.select(
        "event_id",
        F.when(kind == "view", "article").when(kind == "click", "part").when(kind == "purchase", "amendment").otherwise("page").alias("type"),
        F.when(kind == "view", F.col("user_id").cast("string"))
        .when(kind == "click", (F.col("user_id") * 3).cast("string"))
        .when(kind == "purchase", F.col("event_id").cast("string"))
        .otherwise(F.concat(F.lit("/"), kind, F.lit("/")))
        .alias("value"),
    )
    targets = [("article", t.supplier, "s_suppkey"), ("part", t.part, "p_partkey"), ("amendment", t.customer, "c_custkey"), ("page", pages, "path")]
    return edition.broken_references(refs, targets)


@query(
    "reference_links",
    """SELECT p_partkey, CASE k WHEN 0 THEN '/articles/' || CAST(p_partkey AS VARCHAR) || 'a/' WHEN 1 THEN '/parts/' || CAST(p_partkey % 39 + 1 AS VARCHAR) || '/'
           WHEN 2 THEN '/amendments/' || CAST(p_partkey AS VARCHAR) || '/' ELSE '/preamble/' END AS href,
         CASE k WHEN 0 THEN 'Article ' || CAST(p_partkey AS VARCHAR) || 'A'
           WHEN 1 THEN 'Part ' || repeat('X', CAST(floor((p_partkey % 39 + 1) / 10) AS INTEGER)) || (['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'])[(p_partkey % 39 + 1) % 10 + 1]
           WHEN 2 THEN CAST(p_partkey AS VARCHAR) || CASE WHEN p_partkey % 100 BETWEEN 11 AND 13 THEN 'th' WHEN p_partkey % 10 = 1 THEN 'st'
             WHEN p_partkey % 10 = 2 THEN 'nd' WHEN p_partkey % 10 = 3 THEN 'rd' ELSE 'th' END || ' Amendment' ELSE p_name END AS label
       FROM (SELECT *, p_partkey % 4 AS k FROM part)""",
)
def reference_links(t: Tables) -> DataFrame:
    k = F.col("p_partkey") % 4
    kind = F.element_at(constant_array(fv.REF_TYPES), (k + 1).cast("int"))
    value = (
        F.when(k == 0, F.concat(F.col("p_partkey").cast("string"), F.lit("A")))
        .when(k == 1, (F.col("p_partkey") % 39 + 1).cast("string"))
        .when(k == 2, F.col("p_partkey").cast("string"))
        .otherwise(F.lit("/preamble/"))
    )
    link = edition.item_link(kind, value, F.when(k == 3, F.col("p_name")))
    return t.part.select("p_partkey", link.alias("_l")).select("p_partkey", "_l.*")


@query(
    "set_equality",
    """SELECT DISTINCT user_id AS key, 'left' AS side FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer)
       UNION ALL SELECT c_custkey, 'right' FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)""",
)
def set_equality(t: Tables) -> DataFrame:
    left = t.events.select(F.col("user_id").alias("key")).distinct()
    return edition.key_differences(left, t.customer.select(F.col("c_custkey").alias("key")), "key")


@query(
    "directory",
    """SELECT n_nationkey, n_name, s_suppkey, position FROM nation LEFT JOIN (SELECT s_nationkey, s_suppkey,
         row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS position FROM supplier) ON s_nationkey = n_nationkey""",
)
def directory(t: Tables) -> DataFrame:
    return views.directory(t.nation.select("n_nationkey", "n_name"), "n_nationkey", t.supplier, "s_nationkey", "s_suppkey")


@query(
    "group_counts",
    "SELECT n_nationkey, n_name, count(c_custkey) AS n_items FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL",
)
def group_counts(t: Tables) -> DataFrame:
    return aggregate.group_counts(t.nation.select("n_nationkey", "n_name"), "n_nationkey", t.customer, "c_nationkey")


@query("duplicate_keys", "SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(t: Tables) -> DataFrame:
    return aggregate.duplicate_keys(t.lineitem, ["l_partkey", "l_suppkey"])


@query(
    "longest_per_key",
    """SELECT source, doc_id, length(text) AS n_chars, sha256(text) AS digest FROM (
         SELECT *, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) AS rn FROM documents) WHERE rn = 1""",
)
def longest_per_key(t: Tables) -> DataFrame:
    longest = aggregate.longest_per_key(t.documents.select("source", "doc_id", "text"), ["source"], "text", "doc_id")
    return longest.select("source", "doc_id", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("digest"))


@query(
    "latest_date",
    "SELECT o_orderstatus, CAST(CAST(max(o_orderdate) AS DATE) AS VARCHAR) AS latest, max(o_orderkey) AS max_key FROM orders GROUP BY ROLLUP (o_orderstatus)",
)
def latest_date(t: Tables) -> DataFrame:
    return t.orders.rollup("o_orderstatus").agg(
        F.to_date(F.max("o_orderdate")).cast("string").alias("latest"), F.max("o_orderkey").alias("max_key")
    )


@query(
    "coverage",
    """SELECT lang, count(*) AS n_docs, count(*) FILTER (quality IS NOT NULL) AS n_labelled,
         count(*) FILTER (len(string_split(text, chr(10))) > 1) AS n_multiline,
         count(*) FILTER (regexp_matches(text, '\\d')) AS n_numbered, round(count(quality) / count(*), 4) AS labelled_share
       FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang""",
)
def coverage(t: Tables) -> DataFrame:
    # Only three booleans per document travel to the join, never the text.
    facts = spread(t.documents).select(
        "doc_id", "lang", F.contains("text", F.lit("\n")).alias("multiline"), F.col("text").rlike(r"\d").alias("numbered")
    )
    joined = facts.join(t.labels, "doc_id", "left")
    return joined.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.count_if(F.col("quality").isNotNull()).alias("n_labelled"),
        F.count_if("multiline").alias("n_multiline"),
        F.count_if("numbered").alias("n_numbered"),
        F.round(F.count("quality") / F.count(F.lit(1)), 4).alias("labelled_share"),
    )


@query(
    "title_audit",
    """SELECT page_id, n_chars, n_same, n_chars > 60 AS too_long, n_same > 1 AS duplicated FROM (
         SELECT page_id, title, length(title) AS n_chars FROM (SELECT page_id, regexp_extract(html, '(?i)<title>([^<]*)</title>', 1) AS title FROM pages))
       JOIN (SELECT regexp_extract(html, '(?i)<title>([^<]*)</title>', 1) AS title, count(*) AS n_same FROM pages GROUP BY 1) USING (title)""",
)
def title_audit(t: Tables) -> DataFrame:
    titled = spread(t.pages).select("page_id", text.html_title(F.col("html")).alias("title"))
    repeated = titled.groupBy("title").agg(F.count(F.lit(1)).alias("n_same")).filter("n_same > 1")
    joined = titled.join(repeated, "title", "left").withColumn("n_same", F.coalesce("n_same", F.lit(1)))
    return joined.select(
        "page_id",
        F.length("title").alias("n_chars"),
        "n_same",
        (F.length("title") > 60).alias("too_long"),
        (F.col("n_same") > 1).alias("duplicated"),
    )


@query(
    "size_budget",
    f"""SELECT lang, count(*) AS n_docs, sum(octet_length(encode(text))) AS bytes, max(octet_length(encode(text))) AS largest,
          count(*) FILTER (octet_length(encode(text)) > {fv.PAGE_BUDGET}) AS over_page_budget,
          sum(octet_length(encode(text))) <= {fv.ARTIFACT_BUDGET} AS within_artifact_budget FROM documents GROUP BY lang""",
)
def size_budget(t: Tables) -> DataFrame:
    sized = spread(t.documents).select("lang", F.octet_length("text").alias("b"))
    return sized.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum("b").alias("bytes"),
        F.max("b").alias("largest"),
        F.count_if(F.col("b") > fv.PAGE_BUDGET).alias("over_page_budget"),
        (F.sum("b") <= fv.ARTIFACT_BUDGET).alias("within_artifact_budget"),
    )


@query(
    "prev_next",
    """WITH i AS (SELECT conv_id, first(text ORDER BY turn) AS opening FROM conversations GROUP BY conv_id)
       SELECT conv_id, row_number() OVER w AS item_no, count(*) OVER () AS n_items, lag(conv_id) OVER w AS prev_conv_id, lead(conv_id) OVER w AS next_conv_id,
         lag(title) OVER w AS prev_title, lead(title) OVER w AS next_title
       FROM (SELECT conv_id, opening AS title FROM i) WINDOW w AS (ORDER BY conv_id)""",
)
def prev_next(t: Tables) -> DataFrame:
    items = t.conversations.groupBy("conv_id").agg(F.min_by("text", "turn").alias("title"))
    # ids alone are ranged; titles meet their neighbours by id
    placed = scan.placed(items.select("conv_id"), [], "conv_id", "item_no", "n_items", ["conv_id"])
    titled = lambda side: items.select(F.col("conv_id").alias(f"{side}_conv_id"), F.col("title").alias(f"{side}_title"))
    return placed.join(titled("prev"), "prev_conv_id", "left").join(titled("next"), "next_conv_id", "left")


@query(
    "timeline",
    """WITH o AS (SELECT o_orderkey AS number, year(o_orderdate) AS year FROM orders),
         s AS (SELECT min(year) AS a, greatest(max(year) - min(year), 1) AS n FROM o)
       SELECT number, year, round(24 + (year - a) / n * 952, 1) AS x,
         292 - ((row_number() OVER (PARTITION BY year ORDER BY number) - 1) % 20) * 14 AS y FROM o, s""",
)
def timeline(t: Tables) -> DataFrame:
    rows = t.orders.select(F.col("o_orderkey").alias("number"), F.year("o_orderdate").alias("year"))
    return views.timeline(rows, "number", "year")


@query(
    "timeline_ticks",
    """WITH s AS (SELECT min(y) AS a, max(y) AS b, greatest(max(y) - min(y), 1) AS n FROM (SELECT year(o_orderdate) * 4 - 6000 AS y FROM orders)),
         t AS (SELECT *, CASE WHEN n <= 20 THEN 1 WHEN n <= 45 THEN 5 ELSE 10 END AS step FROM s)
       SELECT y AS year, round(24 + (y - a) / n * 952, 1) AS x FROM (
         SELECT a, n, unnest(range(CAST(ceil(a / step) * step AS BIGINT), b + 1, step)) AS y FROM t)""",
)
def timeline_ticks(t: Tables) -> DataFrame:
    return views.timeline_ticks(t.orders.select((F.year("o_orderdate") * 4 - 6000).alias("year")), "year")


@query(
    "doc_order",
    """SELECT label, row_number() OVER (ORDER BY n, s) AS position FROM (
         SELECT p_partkey // 3 AS n, (['', 'A', 'AA'])[p_partkey % 3 + 1] AS s,
           CAST(p_partkey // 3 AS VARCHAR) || (['', 'A', 'AA'])[p_partkey % 3 + 1] AS label FROM part)""",
)
def doc_order(t: Tables) -> DataFrame:
    from ..functions.numbers import order_number, order_suffix

    suffix = F.element_at(constant_array(["", "A", "AA"]), (F.col("p_partkey") % 3 + 1).cast("int"))
    labels = t.part.select(F.concat(F.floor(F.col("p_partkey") / 3).cast("string"), suffix).alias("label"))
    keyed = labels.select("label", order_number(F.col("label")).alias("n"), order_suffix(F.col("label")).alias("s"))
    return scan.number_rows(keyed, [], "n", "position", ties=["s"]).select("label", "position").orderBy("position")


@query(
    "dedupe_first",
    """SELECT l_partkey, l_orderkey, l_linenumber, l_extendedprice FROM (
         SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rn FROM lineitem) WHERE rn = 1""",
)
def dedupe_first(t: Tables) -> DataFrame:
    hits = t.lineitem.select("l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    ranked = [-F.col("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")]
    return aggregate.first_per_key(hits, ["l_partkey"], ranked)
