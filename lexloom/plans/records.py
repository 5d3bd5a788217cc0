"""Queries on records held to their rule sets, side texts, page heads, short prose and pooled vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import prose, script, text
from ..functions.let import constant_array
from ..operators import edition, embed, phrases, quality, search
from ..operators.quality import Rule
from ..sources.tables import spread
from .registry import Tables, query


def _pick(key: Column, values: list[str]) -> Column:
    return F.element_at(constant_array(values), (key % len(values) + 1).cast("int"))


def _records(t: Tables) -> dict[str, tuple[DataFrame, list[Rule]]]:
    """A table of records per rule set, with values that break each rule, and the rules."""
    k = F.col("key")
    word = lambda c: c.cast("string")
    blank = lambda every, c: F.when(k % every == 0, "").otherwise(c)
    part = t.part.withColumn("key", F.col("p_partkey").cast("long"))
    clause = lambda t_, kind: F.struct(t_.alias("text"), kind.alias("kind"))
    clauses = F.array(clause(F.col("p_name"), F.lit("clause")), clause(blank(11, F.col("p_type")), _pick(k, ["clause", "explanation", "note"])))
    items = part.select(
        "key",
        F.concat(word(k % 1500), _pick(k, ["", "A", "AB", "abc"])).alias("number"),
        F.concat(word(F.col("p_size")), _pick(k, ["", "A", "a"])).alias("part"),
        blank(17, F.col("p_name")).alias("title"),
        F.when(k % 13 == 0, F.slice(clauses, 1, 0)).otherwise(clauses).alias("clauses"),
        _pick(k, ["in-force", "amended", "gone"]).alias("status"),
        blank(7, F.lit("१")).alias("number_hi"),
        (k % 9 - 1).alias("page"),
    )
    parts = t.supplier.withColumn("key", F.col("s_suppkey").cast("long")).select(
        "key",
        F.concat(word(k % 120), _pick(k, ["", "A", "C"])).alias("number"),
        blank(9, F.col("s_name")).alias("name"),
        blank(4, F.lit("१")).alias("number_hi"),
    )
    schedules = t.nation.withColumn("key", F.col("n_nationkey").cast("long")).select("key", k.alias("number"), blank(5, F.col("n_name")).alias("title"))
    day = F.when(k % 3 == 0, F.lit(None)).when(k % 5 == 0, "1 March").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    acts = t.orders.withColumn("key", F.col("o_orderkey").cast("long")).select(
        "key",
        (k % 50).alias("number"),
        (k % 100 + 1940).alias("year"),
        blank(19, F.col("o_orderstatus")).alias("title"),
        day.alias("introduced_in"),
        *(F.lit(None).cast("string").alias(c) for c in ("passed_lok_sabha", "passed_rajya_sabha", "assent")),
        day.alias("in_force"),
        _pick(k, ["rights", "general", "other"]).alias("theme"),
    )
    bills = t.customer.withColumn("key", F.col("c_custkey").cast("long")).select(
        "key",
        blank(23, F.col("c_name")).alias("title"),
        _pick(k, ["lok-sabha", "both", "senate"]).alias("house"),
        _pick(k, ["pending", "lapsed", "won", "rejected"]).alias("status"),
        F.when(k % 4 > 0, "2031-01-02").alias("introduced_on"),
        F.when(k % 6 > 0, "2031-02-03").otherwise("soon").alias("last_verified"),
        blank(8, F.concat(F.lit("https://bills.example/"), word(k))).alias("source_url"),
    )
    ref = lambda kind, value: F.struct(kind.alias("type"), value.alias("value"))
    refs = F.array(ref(_pick(k, ["article", "page", "act"]), word(k)), ref(F.lit("part"), blank(10, F.lit("3"))))
    essentials = part.select(
        "key",
        F.concat(_pick(k, ["fact-", "Fact "]), word(k)).alias("id"),
        blank(17, F.col("p_name")).alias("title"),
        blank(14, F.col("p_type")).alias("summary"),
        F.when(k % 12 == 0, F.slice(refs, 1, 0)).otherwise(refs).alias("refs"),
    )
    return {
        "item": (items, quality.item_rules()),
        "translated item": (items, quality.translated_item_rules()),
        "part": (parts, quality.part_rules()),
        "translated part": (parts, quality.translated_part_rules()),
        "schedule": (schedules, quality.schedule_rules()),
        "act": (acts, quality.amendment_rules(2030)),
        "bill": (bills, quality.bill_rules()),
        "essential": (essentials, quality.essential_rules()),
    }


_EMPTY = "must not be empty"
_ITEM_BROKEN = [
    ("number", "is no item number such as 7, 30C or 112BD", "NOT regexp_matches(number, '^\\d{1,3}[A-Z]{0,2}$')"),
    ("part", "is no part number such as 2 or 6B", "NOT regexp_matches(part, '^\\d{1,2}[A-Z]?$')"),
    ("title", _EMPTY, "title = ''"),
    ("clauses", "must have at least one entry", "k % 13 = 0"),
    ("clauses.text", _EMPTY, "k % 13 > 0 AND (k % 11 = 0)"),
    ("clauses.kind", "must be one of clause, explanation, illustration, proviso", "k % 13 > 0 AND k % 3 = 2"),
    ("status", "must be one of in-force, amended, omitted, repealed", "k % 3 = 2"),
]
_PART_BROKEN = [("number", "is no part number such as 2 or 6B", "NOT regexp_matches(number, '^\\d{1,2}[A-B]?$')"), ("name", _EMPTY, "k % 9 = 0")]
_DATE = "is no date such as 2031-02-28"
_ITEMS = """(SELECT p_partkey::BIGINT AS k, (p_partkey % 1500) || (['', 'A', 'AB', 'abc'])[p_partkey % 4 + 1] AS number,
    p_size || (['', 'A', 'a'])[p_partkey % 3 + 1] AS part, CASE WHEN p_partkey % 17 = 0 THEN '' ELSE p_name END AS title FROM part)"""
_PARTS = "(SELECT s_suppkey::BIGINT AS k, (s_suppkey % 120) || (['', 'A', 'C'])[s_suppkey % 3 + 1] AS number FROM supplier)"
_SETS = [
    ("item", _ITEMS, _ITEM_BROKEN),
    ("translated item", _ITEMS, [*_ITEM_BROKEN, ("number_hi", _EMPTY, "k % 7 = 0"), ("page", "must be at least 0", "k % 9 = 0")]),
    ("part", _PARTS, _PART_BROKEN),
    ("translated part", _PARTS, [*_PART_BROKEN, ("number_hi", _EMPTY, "k % 4 = 0")]),
    (
        "schedule",
        "(SELECT n_nationkey::BIGINT AS k FROM nation)",
        [("number", "must be 1 to 12", "NOT k BETWEEN 1 AND 12"), ("title", _EMPTY, "k % 5 = 0")],
    ),
    (
        "act",
        "(SELECT o_orderkey::BIGINT AS k FROM orders)",
        [
            ("number", "must be at least 1", "k % 50 = 0"),
            ("year", "must be 1950 to 2030", "NOT k % 100 + 1940 BETWEEN 1950 AND 2030"),
            ("title", _EMPTY, "k % 19 = 0"),
            ("introduced_in", _DATE, "k % 3 > 0 AND k % 5 = 0"),
            ("in_force", _DATE, "k % 3 > 0 AND k % 5 = 0"),
            ("theme", "must be one of rights, federal, emergency, social, general", "k % 3 = 2"),
        ],
    ),
    (
        "bill",
        "(SELECT c_custkey::BIGINT AS k FROM customer)",
        [
            ("title", _EMPTY, "k % 23 = 0"),
            ("house", "must be one of lok-sabha, rajya-sabha, both", "k % 3 = 2"),
            ("status", "must be one of pending, passed-one-house, rejected, lapsed", "k % 4 = 2"),
            ("last_verified", _DATE, "k % 6 = 0"),
            ("source_url", "must be a URL", "k % 8 = 0"),
        ],
    ),
    (
        "essential",
        "(SELECT p_partkey::BIGINT AS k FROM part)",
        [
            ("id", "may hold small letters, digits and hyphens only", "k % 2 = 1"),
            ("title", _EMPTY, "k % 17 = 0"),
            ("summary", _EMPTY, "k % 14 = 0"),
            ("refs", "must have at least one entry", "k % 12 = 0"),
            ("refs.type", "must be one of article, part, amendment, page", "k % 12 > 0 AND k % 3 = 2"),
            ("refs.value", _EMPTY, "k % 12 > 0 AND k % 10 = 0"),
        ],
    ),
]


@query(
    "rule_sets",
    " UNION ALL ".join(
        f"SELECT '{name}' AS rule_set, k AS key, '{field}' AS field, '{message}' AS message FROM {source} WHERE {broken}"
        for name, source, rules in _SETS
        for field, message, broken in rules
    ),
)
def rule_sets(t: Tables) -> DataFrame:
    """Every broken rule of every set, over records of all tables."""
    out = None
    for name, (records, rules) in _records(t).items():
        found = quality.schema_errors(records, ["key"], rules).select(F.lit(name).alias("rule_set"), "key", "field", "message")
        out = found if out is None else out.unionByName(found)
    return out


@query(
    "side_text_findings",
    """WITH s AS (SELECT CASE WHEN doc_id % 11 = 3 THEN -doc_id ELSE doc_id END AS doc_id, CASE WHEN toxic = 0 THEN 'note' ELSE ' ' END AS note FROM labels)
       SELECT DISTINCT doc_id, 'unknown' AS finding FROM s WHERE doc_id NOT IN (SELECT doc_id FROM documents)
       UNION ALL SELECT doc_id, 'uncovered' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM s WHERE note = 'note')""",
)
def side_text_findings(t: Tables) -> DataFrame:
    key = F.when(F.col("doc_id") % 11 == 3, -F.col("doc_id")).otherwise(F.col("doc_id"))
    side = t.labels.select(key.alias("doc_id"), F.when(F.col("toxic") == 0, "note").otherwise(" ").alias("note"))
    return edition.side_text_findings(t.documents.select("doc_id"), side, "doc_id", "note")


_SEEN = "length(regexp_replace({}, '&(?:#\\d+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);', '_', 'g'))"
_META = '(?i)<meta\\s+name="description"\\s+content="([^"]*)"'


@query(
    "head_audit",
    f"""WITH h AS (SELECT page_id, regexp_extract(html, '(?i)<title>([^<]*)</title>', 1) || (['', ' | Site', ' &amp; &#39;x&#39;'])[page_id % 3 + 1] AS title,
          CASE WHEN regexp_matches(html, '{_META}') THEN regexp_extract(html, '{_META}', 1)
            WHEN page_id % 4 > 0 THEN left(regexp_extract(html, '<p>([^<]*)', 1), 100 + (page_id % 9 * 10)::INTEGER) END AS description FROM pages),
        m AS (SELECT *, {_SEEN.format("title")} AS n, {_SEEN.format("description")} AS d, count(*) OVER (PARTITION BY title) AS same FROM h)
        SELECT page_id, n AS title_chars, d AS description_chars, list_aggregate(list_filter([CASE WHEN n > 60 THEN 'title too long' END,
          CASE WHEN NOT (contains(title, '| Site') OR starts_with(title, 'Site:')) THEN 'no site name' END, CASE WHEN same > 1 THEN 'title repeated' END,
          CASE WHEN description IS NULL THEN 'no description' END, CASE WHEN d >= 160 THEN 'description too long' END,
          CASE WHEN d <= 20 THEN 'description too short' END], lambda x: x IS NOT NULL), 'string_agg', ', ') AS faults FROM m""",
)
def head_audit(t: Tables) -> DataFrame:
    """Titles and descriptions of pages as a reader sees them: length, site name, repeats."""
    key = F.col("page_id")
    title = F.concat(text.html_title(F.col("html")), _pick(key, ["", " | Site", " &amp; &#39;x&#39;"]))
    opening = F.regexp_extract("html", r"<p>([^<]*)", 1)
    told = F.when(key % 4 > 0, F.substring(opening, F.lit(1), (100 + key % 9 * 10).cast("int")))
    heads = spread(t.pages).select("page_id", title.alias("title"), F.coalesce(text.meta_description(F.col("html")), told).alias("description"))
    return edition.head_faults(heads, "page_id", "| Site", "Site:")


@query(
    "file_links",
    """SELECT page_id, list_distinct_in_order AS links FROM (
         SELECT page_id, list_filter(us, lambda u, i: list_position(us, u) = i) AS list_distinct_in_order
         FROM (SELECT page_id, list_transform(regexp_extract_all(replace(html, 'href="/', 'href="/files' || page_id % 5 || '.PDF?q=/'), '(?i)href="([^"]+\\.pdf[^"]*)"', 1), lambda u: trim(u)) AS us FROM pages)) WHERE len(links) > 0""",
)
def file_links(t: Tables) -> DataFrame:
    """Links of one file type per page, in order; every other link is left out."""
    html = F.replace("html", F.lit('href="/'), F.concat(F.lit('href="/files'), (F.col("page_id") % 5).cast("string"), F.lit(".PDF?q=/")))
    found = spread(t.pages).select("page_id", text.page_links(html, "pdf").alias("links"))
    return found.where(F.size("links") > 0)


@query(
    "short_prose_lint",
    """SELECT conv_id, turn, 'summary is ' || n || ' words; wanted are 15 to 60' AS message
       FROM (SELECT conv_id, turn, len(regexp_extract_all(text, '\\S+')) AS n FROM conversations) WHERE NOT n BETWEEN 15 AND 60""",
)
def short_prose_lint(t: Tables) -> DataFrame:
    """The length band of short texts."""
    found = spread(t.conversations).select("conv_id", "turn", F.inline(prose.lint_short(F.col("text"))))
    return found.where("rule = 'length'").select("conv_id", "turn", "message")


_KINDS = r"""CASE WHEN regexp_matches(l, '^भारत का संविधान\s*\d*$') OR l = 'THE CONSTITUTION OF INDIA' OR regexp_matches(l, '^\d{1,3}$')
      OR (regexp_matches(l, '^\(भाग\s') AND regexp_matches(l, '\)\s*\d*$')) THEN 'furniture'
    WHEN regexp_matches(l, '^\d[.।]\s') AND regexp_matches(l, '""" + "|".join(fv.FOOTNOTE_SIGNALS_HI) + """') THEN 'footnote' ELSE 'body' END"""


@query(
    "line_kinds",
    f"""WITH l AS (SELECT l_orderkey, l_linenumber, (['भारत का संविधान ', '(भाग ', '3. अधिनियम ', '3. ', '', 'THE CONSTITUTION OF INDIA', '12. राजपत्र '])[(l_orderkey + l_linenumber) % 7 + 1]
          || CASE WHEN (l_orderkey + l_linenumber) % 7 = 5 THEN '' ELSE CAST(l_quantity AS INTEGER)::VARCHAR END || CASE (l_orderkey + l_linenumber) % 7 WHEN 1 THEN ') ' || l_linenumber WHEN 3 THEN ' words' ELSE '' END AS l FROM lineitem)
        SELECT l_orderkey, l_linenumber, {_KINDS} AS kind FROM l""",
)
def line_kinds(t: Tables) -> DataFrame:
    """Body, footnote and furniture of a second edition's page lines."""
    place = F.col("l_orderkey") + F.col("l_linenumber")
    head = _pick(place, ["भारत का संविधान ", "(भाग ", "3. अधिनियम ", "3. ", "", "THE CONSTITUTION OF INDIA", "12. राजपत्र "])
    body = F.when(place % 7 == 5, "").otherwise(F.col("l_quantity").cast("int").cast("string"))
    tail = F.when(place % 7 == 1, F.concat(F.lit(") "), F.col("l_linenumber").cast("string"))).when(place % 7 == 3, " words").otherwise("")
    return t.lineitem.select("l_orderkey", "l_linenumber", script.line_kind(F.concat(head, body, tail)).alias("kind"))


@query(
    "restored_vectors",
    """WITH m AS (SELECT max(list_max(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE))))) AS m FROM embeddings),
         l AS (SELECT vec_id, m, list_max(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE) - CAST(floor(CAST(x AS DOUBLE) / m * 127 + 0.5) * (m / 127) AS FLOAT)))) AS lost FROM embeddings, m)
       SELECT vec_id, round(lost, 6) AS worst, lost <= m / 127 * 0.501 AS within FROM l""",
)
def restored_vectors(t: Tables) -> DataFrame:
    """Codes of one byte and back: what a vector loses on the way."""
    coded = search.quantize(spread(t.embeddings), "embedding")
    back = search.dequantize(F.col("codes"), F.col("scale"))
    lost = F.array_max(F.zip_with("embedding", back, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))
    return coded.select("vec_id", F.round(lost, 6).alias("worst"), (lost <= F.col("scale") * 0.501).alias("within"))


@query(
    "mean_pooled",
    """WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM documents),
         k AS (SELECT doc_id, (length(w) * 31 + ascii(w)) % 97 AS vec_id, count(*) AS n FROM w GROUP BY ALL),
         e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS d FROM embeddings WHERE vec_id < 97),
         s AS (SELECT doc_id, d, sum(n * x) AS x FROM k JOIN e USING (vec_id) GROUP BY ALL),
         u AS (SELECT doc_id, d, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS x FROM s)
       SELECT doc_id, round(sum(x * x), 6) AS norm, round(sum(x * (d + 1)), 5) AS digest FROM u GROUP BY doc_id""",
)
def mean_pooled(t: Tables) -> DataFrame:
    """Documents as the mean of their tokens' rows of a vector table, of length one."""
    words = F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))
    tokens = F.transform(words, lambda w: ((F.length(w) * 31 + F.ascii(w)) % 97).cast("long"))
    docs = spread(t.documents).select("doc_id", tokens.alias("tokens"))
    pooled = embed.mean_pooled(docs, "doc_id", "tokens", t.embeddings.where("vec_id < 97"), "vec_id", "embedding").where("vector is not null")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return pooled.select(
        "doc_id",
        F.round(total(F.transform("vector", lambda x: x * x)), 6).alias("norm"),
        F.round(total(F.transform("vector", lambda x, i: x * (i + 1))), 5).alias("digest"),
    )


_WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{M}}\p{{N}}]+(?:[''’][\p{{L}}\p{{M}}\p{{N}}]+)*')"


@query(
    "phrase_hits",
    f"""WITH b AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark),
         p AS (SELECT item_id, 2 + item_id % 3 AS n, array_to_string(w[item_id % 4 + 1:item_id % 4 + 2 + item_id % 3], ' ') AS gram FROM b WHERE len(w) >= item_id % 4 + 2 + item_id % 3),
         d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
         g AS (SELECT doc_id, n, i AS pos, array_to_string(w[i + 1:i + n], ' ') AS gram FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS i FROM d, (SELECT unnest([2, 3, 4]) AS n)))
       SELECT doc_id, item_id, count(*) AS n, min(pos) AS first_at FROM g JOIN p USING (gram) GROUP BY doc_id, item_id""",
)
def phrase_hits(t: Tables) -> DataFrame:
    """Phrases cut from the benchmark's items, found in whole documents."""
    n, skip = (F.col("item_id") % 3 + 2).cast("int"), (F.col("item_id") % 4).cast("int")
    words = phrases.phrase_words(F.col("text"))
    cut = t.benchmark.where(F.size(words) >= skip + n).select("item_id", F.array_join(F.slice(words, skip + 1, n), " ").alias("phrase"))
    return phrases.phrase_hits(spread(t.documents), "doc_id", "text", cut, "item_id", "phrase")
