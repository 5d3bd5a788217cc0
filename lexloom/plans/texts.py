"""Queries with text and number functions over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import numbers, prose, script, text, urls
from ..functions.let import constant_array, constant_map
from ..operators import segment
from ..sources.tables import spread
from .derive import ORDINALS_CTE, statute_sql, statutes
from .registry import Tables, query

SITE = "Codex"


def _docs(t: Tables) -> DataFrame:
    return spread(t.documents.select("doc_id", "text"))


_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def _clean_sql(c: str) -> str:
    steps = [
        (r"\d{1,2}\s*\[", " ["),
        (r"\[\s*", " "),
        (r"\s*\]", " "),
        (r"\s+([.,;:)])", r"\1"),
        (r"([(\[])\s+", r"\1"),
        (r"\s+", " "),
    ]
    for pattern, replacement in steps:
        c = f"regexp_replace({c}, '{pattern}', '{replacement}', 'g')"
    return _TRIM.format(c)


@query(
    "clean_text",
    statute_sql(
        1,
        f"""SELECT doc_id, line_no, {_clean_sql("line")} AS cleaned,
              {_TRIM.format("regexp_replace(line, '\\s+', ' ', 'g')")} AS normalized FROM lines""",
    ),
)
def clean_text(t: Tables) -> DataFrame:
    line = F.col("line")
    return segment.numbered_lines(statutes(t)).select(
        "doc_id",
        "line_no",
        text.clean_legal_text(line).alias("cleaned"),
        text.normalize_space(line).alias("normalized"),
    )


_VISIBLE = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
    '(?is)<script.*?</script>', '', 'g'), '(?is)<style.*?</style>', '', 'g'), '(?s)<!--.*?-->', '', 'g'),
    '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"""


@query("page_text", f"SELECT page_id, length(v) AS n_chars, sha256(v) AS digest FROM (SELECT page_id, {_VISIBLE} AS v FROM pages)")
def page_text(t: Tables) -> DataFrame:
    shown = spread(t.pages).select("page_id", text.visible_text(F.col("html")).alias("v"))
    return shown.select("page_id", F.length("v").alias("n_chars"), F.sha2("v", 256).alias("digest"))


@query(
    "page_links",
    """SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY first_pos) - 1 AS pos, url FROM (
         SELECT page_id, url, min(p) AS first_pos FROM (
           SELECT page_id, unnest(list_transform(us, lambda u: regexp_replace(u, '^\\s+|\\s+$', '', 'g'))) AS url,
             unnest(range(len(us))) AS p
           FROM (SELECT page_id, regexp_extract_all(html, '(?i)href="([^"]+)"', 1) AS us FROM pages))
         GROUP BY page_id, url)""",
)
def page_links(t: Tables) -> DataFrame:
    links = text.page_links(F.col("html"), extension=None)
    return spread(t.pages).select("page_id", F.posexplode(links).alias("pos", "url"))


@query(
    "phrase_number",
    r"""SELECT p_partkey, TRY_CAST(nullif(regexp_extract(lead, '(?i)(\d{1,3})\s+amendments?\b', 1), '') AS INTEGER) AS n FROM (
          SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN 'No number for ' || p_name
            ELSE 'As of now there have been ' || CAST(p_size AS VARCHAR)
              || CASE WHEN p_size = 1 THEN ' amendment' ELSE ' Amendments' END || ' to ' || p_name END AS lead FROM part)""",
)
def phrase_number(t: Tables) -> DataFrame:
    lead = F.when(F.col("p_type") == "ECONOMY", F.concat(F.lit("No number for "), "p_name")).otherwise(
        F.concat(
            F.lit("As of now there have been "),
            F.col("p_size").cast("string"),
            F.when(F.col("p_size") == 1, " amendment").otherwise(" Amendments"),
            F.lit(" to "),
            "p_name",
        )
    )
    return t.part.select("p_partkey", text.phrase_number(lead).alias("n"))


@query(
    "unsafe_urls",
    r"""WITH v AS (
          SELECT page_id, unnest([url, 'http://172.' || CAST(page_id % 40 AS VARCHAR) || '.3.4/x', 'ftp://files.example.com/a',
            'https://localhost:8080/', 'http://[fe80::' || CAST(page_id % 10 AS VARCHAR) || ']/',
            'http://user@100.' || CAST(page_id % 130 AS VARCHAR) || '.1.1:81/', 'not a url', 'http://[::ffff:7f00:1]/',
            'https://[2606:4700::6810:85e5]/f', 'http://8.8.' || CAST(page_id % 300 AS VARCHAR) || '.8/',
            'http://' || CAST(page_id * 16777259 % 4294967296 AS VARCHAR) || '/', 'http://0x7f.1/', 'http://0300.0250.9/',
            'http://10.' || CAST(page_id * 70000 AS VARCHAR) || '/', 'http://[0:0:0:0:0:0:0:1]/', 'http://[1::2::3]/',
            'http://127.0.0.1\@example.com/', 'http:\\example.com/', 'http://[::ffff:10.1.2.' || CAST(page_id % 300 AS VARCHAR) || ']/',
            'http://%31%30.0.0.1/', 'http://1.2.3.4.5/', 'http://a.localhost./', 'http://08.1/', ' http://192.168.1.1 ']) AS url FROM pages),
        p AS (SELECT page_id, url, regexp_replace(regexp_replace(url, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g'), '[\t\n\r]', '', 'g') AS plain FROM v),
        a AS (SELECT page_id, url, lower(regexp_extract(plain, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1)) AS scheme,
          regexp_replace(regexp_replace(regexp_extract(plain, '^[A-Za-z][A-Za-z0-9+.\-]*:[/\\]*([^/?#\\]*)', 1), '^.*@', ''), ':\d*$', '') AS bare FROM p),
        h AS (SELECT *, regexp_replace(regexp_replace(lower(url_decode(bare)), '^\[|\]$', '', 'g'), '\.$', '') AS host FROM a),
        n AS (SELECT *, regexp_matches(string_split(host, '.')[-1], '^(0x[0-9a-f]*|[0-9]+)$') AS numeric_end,
          [CASE WHEN x = '0x' THEN 0
            WHEN regexp_matches(x, '^0x[0-9a-f]{1,12}$') THEN list_reduce([strpos('0123456789abcdef', c) - 1 FOR c IN string_split(x[3:], '')], lambda m, k: m * 16 + k)
            WHEN regexp_matches(x, '^0[0-7]{1,16}$') THEN list_reduce([CAST(c AS BIGINT) FOR c IN string_split(x, '')], lambda m, k: m * 8 + k)
            WHEN regexp_matches(x, '^(0|[1-9]\d{0,14})$') THEN CAST(x AS BIGINT) END FOR x IN string_split(host, '.')] AS nums,
          CASE WHEN regexp_matches(host, '^.*:\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$') THEN [TRY_CAST(x AS BIGINT) FOR x IN string_split(regexp_extract(host, '([\d.]+)$', 1), '.')] END AS tail FROM h),
        w AS (SELECT *, CASE WHEN NOT numeric_end THEN -1
            WHEN len(nums) <= 4 AND nums[-1] < 256.0 ** (5 - len(nums)) AND len(list_filter(nums[1:len(nums) - 1], lambda m: m <= 255)) = len(nums) - 1
            THEN list_reduce(list_concat([0::BIGINT], nums[1:len(nums) - 1]), lambda m, k: m * 256 + k) * CAST(256 ** (5 - len(nums)) AS BIGINT) + nums[-1] END AS v4,
          string_split(CASE WHEN len(list_filter(tail, lambda m: m <= 255)) = 4
            THEN regexp_replace(host, '[\d.]+$', '') || printf('%x', tail[1] * 256 + tail[2]) || ':' || printf('%x', tail[3] * 256 + tail[4]) ELSE host END, '::') AS halves FROM n),
        x AS (SELECT *, CASE WHEN halves[1] = '' THEN [] ELSE string_split(halves[1], ':') END AS l,
          CASE WHEN coalesce(halves[2], '') = '' THEN [] ELSE string_split(halves[2], ':') END AS r FROM w),
        y AS (SELECT *, list_concat(list_concat(l, ['0' FOR i IN range(greatest(8 - len(l) - len(r), 0))]), r) AS g,
          CASE WHEN len(halves) = 1 THEN len(l) = 8 ELSE len(halves) = 2 AND len(l) + len(r) <= 7 END AS fits FROM x),
        z AS (SELECT *, CASE WHEN fits AND len(list_filter(g, lambda m: regexp_matches(m, '^[0-9a-f]{1,4}$'))) = len(g)
          THEN [list_reduce([strpos('0123456789abcdef', c) - 1 FOR c IN string_split(m, '')], lambda d, k: d * 16 + k) FOR m IN g] END AS v6 FROM y),
        q AS (SELECT *, CASE WHEN contains(host, ':') THEN
            CASE WHEN v6[1:5] = [0, 0, 0, 0, 0] AND v6[6] = 65535 THEN v6[7] * 65536 + v6[8] ELSE -1 END ELSE v4 END AS quad FROM z),
        b AS (SELECT *, quad // 16777216 AS a1, quad // 65536 % 256 AS a2 FROM q)
        SELECT page_id, url, reason FROM (
          SELECT page_id, url, CASE WHEN scheme = '' THEN 'not a valid URL'
            WHEN scheme NOT IN ('http', 'https') THEN 'scheme not allowed: ' || scheme
            WHEN host = '' THEN 'not a valid URL'
            WHEN host = 'localhost' OR host LIKE '%.localhost' THEN 'refused: ' || host || ' is a local, private or reserved host'
            WHEN contains(host, ':') AND v6 IS NULL OR NOT contains(host, ':') AND v4 IS NULL THEN 'not a valid URL'
            WHEN (quad >= 0 AND (a1 IN (0, 10, 127) OR (a1 = 100 AND a2 BETWEEN 64 AND 127) OR (a1 = 169 AND a2 = 254)
                OR (a1 = 172 AND a2 BETWEEN 16 AND 31) OR (a1 = 192 AND a2 = 168)))
              OR (contains(host, ':') AND (v6[1:7] = [0, 0, 0, 0, 0, 0, 0] AND v6[8] IN (0, 1)
                OR v6[1] BETWEEN 65152 AND 65215 OR v6[1] BETWEEN 64512 AND 65023))
            THEN 'refused: ' || host || ' is a local, private or reserved host' END AS reason FROM b)
        WHERE reason IS NOT NULL""",
)
def unsafe_urls(t: Tables) -> DataFrame:
    pid = F.col("page_id")

    def made(*parts: str | Column) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

    variants = F.array(
        F.col("url"),
        made("http://172.", pid % 40, ".3.4/x"),
        F.lit("ftp://files.example.com/a"),
        F.lit("https://localhost:8080/"),
        made("http://[fe80::", pid % 10, "]/"),
        made("http://user@100.", pid % 130, ".1.1:81/"),
        F.lit("not a url"),
        F.lit("http://[::ffff:7f00:1]/"),
        F.lit("https://[2606:4700::6810:85e5]/f"),
        made("http://8.8.", pid % 300, ".8/"),
        made("http://", pid * 16777259 % 4294967296, "/"),
        F.lit("http://0x7f.1/"),
        F.lit("http://0300.0250.9/"),
        made("http://10.", pid * 70000, "/"),
        F.lit("http://[0:0:0:0:0:0:0:1]/"),
        F.lit("http://[1::2::3]/"),
        F.lit("http://127.0.0.1\\@example.com/"),
        F.lit("http:\\\\example.com/"),
        made("http://[::ffff:10.1.2.", pid % 300, "]/"),
        F.lit("http://%31%30.0.0.1/"),
        F.lit("http://1.2.3.4.5/"),
        F.lit("http://a.localhost./"),
        F.lit("http://08.1/"),
        F.lit(" http://192.168.1.1 "),
    )
    audited = t.pages.select("page_id", F.explode(variants).alias("url"))
    return audited.select("page_id", "url", urls.refusal(F.col("url")).alias("reason")).filter("reason IS NOT NULL")


@query(
    "lede",
    rf"""WITH b AS (
           SELECT doc_id, regexp_extract_all(regexp_replace(split_part(text, chr(10), 1), '\.$', '') || '. ' || {_clean_sql("text")}, '\S+') AS ws
           FROM documents),
         c AS (SELECT doc_id, ws, array_to_string(ws[1:60], ' ') AS head FROM b),
         d AS (SELECT *, instr(reverse(head), ' .') AS back FROM c),
         e AS (SELECT *, CASE WHEN back > 0 THEN length(head) - back - 1 ELSE -1 END AS stop FROM d),
         f AS (SELECT *, CASE WHEN stop > 200 THEN substr(head, 1, stop + 1) ELSE head || '.' END AS cut FROM e)
         SELECT doc_id, CASE WHEN len(ws) <= 60 THEN array_to_string(ws, ' ')
           WHEN len(regexp_extract_all(cut, '\S+')) >= 40 THEN cut
           ELSE array_to_string(ws[1:55], ' ') || '.' END AS lede FROM f""",
)
def lede(t: Tables) -> DataFrame:
    first_line = F.split_part("text", F.lit("\n"), F.lit(1))
    return _docs(t).select("doc_id", text.lede(first_line, F.col("text")).alias("lede"))


@query(
    "clamp_title",
    rf"""WITH p AS (SELECT page_id, regexp_extract(html, '(?i)<title>([^<]*)</title>', 1) AS bare,
             {_VISIBLE} AS v FROM pages),
         q AS (SELECT page_id, bare, v, bare || ' | {SITE}' AS whole FROM p)
         SELECT page_id, CASE WHEN length(whole) <= 60 THEN whole
             ELSE regexp_replace(substr(whole, 1, {60 - len(" | " + SITE) - 1}), '\s+$', '') || '…' || ' | {SITE}' END AS title,
           CASE WHEN length(bare) <= 60 THEN bare ELSE regexp_replace(substr(bare, 1, 57), '\s+$', '') || '…' END AS plain_title,
           substr(v, 1, 155) AS description, substr(v, 1, 160) || '…' AS snippet,
           regexp_replace(whole, '\s*\|\s*{SITE}\s*$', '') AS stripped FROM q""",
)
def clamp_title(t: Tables) -> DataFrame:
    suffix = f" | {SITE}"
    titled = spread(t.pages).select(
        "page_id", text.html_title(F.col("html")).alias("bare"), text.visible_text(F.col("html")).alias("v")
    )
    full = F.concat("bare", F.lit(suffix))
    return titled.select(
        "page_id",
        text.clamp_title(full, suffix).alias("title"),
        text.clamp_title(F.col("bare"), suffix).alias("plain_title"),
        text.clamp_description(F.col("v")).alias("description"),
        text.snippet(F.col("v")).alias("snippet"),
        text.strip_site_suffix(full, SITE).alias("stripped"),
    )


@query(
    "canonical_url",
    r"""SELECT page_id, CASE WHEN bare = '' THEN 'https://codex.example/' ELSE 'https://codex.example/' || bare || '/' END AS canonical
        FROM (SELECT page_id, regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1),
                '^/+|/+$', '', 'g') AS bare FROM pages)""",
)
def canonical_url(t: Tables) -> DataFrame:
    path = text.pick_url_path(F.col("url"))
    return t.pages.select("page_id", text.canonical_url("https://codex.example", path).alias("canonical"))


ORDER_LABELS = {"O": "Pending", "F": "Passed", "P": "Passed by one house"}


@query(
    "code_labels",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'Pending' WHEN 'F' THEN 'Passed' WHEN 'P' THEN 'Passed by one house'
         ELSE o_orderstatus END AS status_label,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'Urgent' WHEN '2-HIGH' THEN 'High' ELSE o_orderpriority END AS priority_label FROM orders""",
)
def code_labels(t: Tables) -> DataFrame:
    def label(code: str, names: dict[str, str]) -> Column:
        return F.coalesce(constant_map(names)[F.col(code)], F.col(code))

    return t.orders.select(
        "o_orderkey",
        label("o_orderstatus", ORDER_LABELS).alias("status_label"),
        label("o_orderpriority", {"1-URGENT": "Urgent", "2-HIGH": "High"}).alias("priority_label"),
    )


@query(
    "unpivot_dates",
    """SELECT o_orderkey, label, CAST(d AS VARCHAR) AS day FROM (
         SELECT o_orderkey, unnest(['Introduced', 'Passed', 'In force']) AS label, unnest([CAST(o_orderdate AS DATE),
           CASE WHEN o_orderstatus IN ('P', 'F') THEN CAST(o_orderdate AS DATE) + 30 END,
           CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) + 60 END]) AS d FROM orders)
       WHERE d IS NOT NULL""",
)
def unpivot_dates(t: Tables) -> DataFrame:
    day = F.to_date("o_orderdate")
    status = F.col("o_orderstatus")
    wide = t.orders.select(
        "o_orderkey",
        day.alias("Introduced"),
        F.when(status.isin("P", "F"), F.date_add(day, 30)).alias("Passed"),
        F.when(status == "F", F.date_add(day, 60)).alias("In force"),
    )
    tall = wide.unpivot("o_orderkey", ["Introduced", "Passed", "In force"], "label", "d").filter("d IS NOT NULL")
    return tall.select("o_orderkey", "label", F.col("d").cast("string").alias("day"))


@query(
    "text_stats",
    r"""SELECT doc_id, words, sentences, round(words / greatest(sentences, 1), 4) AS words_per_sentence FROM (
          SELECT doc_id, len(regexp_extract_all(text, '\S+')) AS words,
            len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda s: regexp_matches(s, '\S'))) AS sentences FROM documents)""",
)
def text_stats(t: Tables) -> DataFrame:
    counted = _docs(t).select(
        "doc_id", text.word_count(F.col("text")).alias("words"), prose.sentence_count(F.col("text")).alias("sentences")
    )
    per = F.round(F.col("words") / F.greatest("sentences", F.lit(1)), 4)
    return counted.withColumn("words_per_sentence", per)


@query(
    "script_share",
    "SELECT doc_id, round(len(regexp_extract_all(text, '[À-ÿ]')) / greatest(length(text), 1), 6) AS share FROM documents",
)
def script_share(t: Tables) -> DataFrame:
    return _docs(t).select("doc_id", F.round(script.script_share(F.col("text"), "[À-ÿ]"), 6).alias("share"))


@query(
    "readability",
    r"""WITH w AS (
          SELECT conv_id, turn, text, unnest(regexp_extract_all(text, '\S+')) AS word FROM conversations),
        c AS (SELECT conv_id, turn, regexp_replace(lower(word), '[^a-z]', '', 'g') AS clean FROM w),
        s AS (SELECT conv_id, turn, count(*) AS words, sum(CASE WHEN length(clean) <= 3 THEN 1 ELSE greatest(1, len(
            regexp_extract_all(regexp_replace(regexp_replace(clean, '(?:[^laeiouy]es|ed|[^laeiouy]e)$', ''), '^y', ''),
              '[aeiouy]{1,2}'))) END) AS syllables FROM c GROUP BY conv_id, turn),
        n AS (SELECT conv_id, turn, greatest(1, len(list_filter(regexp_split_to_array(text, '[.!?]+'),
            lambda x: regexp_matches(x, '\S')))) AS sentences FROM conversations)
        SELECT conv_id, turn, syllables, round(0.39::DOUBLE * words / sentences + 11.8::DOUBLE * syllables / words - 15.59::DOUBLE, 4) AS grade
        FROM s JOIN n USING (conv_id, turn)""",
)
def readability(t: Tables) -> DataFrame:
    said = spread(t.conversations).filter(F.col("text").rlike(r"\S"))
    return said.select(
        "conv_id",
        "turn",
        prose.syllable_total(F.col("text")).alias("syllables"),
        F.round(prose.reading_grade(F.col("text")), 4).alias("grade"),
    )


@query(
    "tokens",
    r"""WITH l AS (
          SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents),
        w AS (SELECT doc_id, line_no, unnest(ws) AS word, unnest(range(len(ws))) AS k FROM (
          SELECT doc_id, line_no, regexp_extract_all(line, '\S+') AS ws FROM l)),
        h AS (SELECT *, CASE WHEN row_number() OVER o = 1 OR NOT regexp_matches(word, '^[\s|.,;:()\[\]''"–—]+$') THEN 1 ELSE 0 END AS head
          FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY line_no, k)),
        g AS (SELECT *, sum(head) OVER (PARTITION BY doc_id ORDER BY line_no, k ROWS UNBOUNDED PRECEDING) AS pos FROM h)
        SELECT doc_id, CAST(pos - 1 AS INTEGER) AS pos, CAST(min(line_no) AS INTEGER) AS line, string_agg(word, '' ORDER BY line_no, k) AS word
        FROM g GROUP BY doc_id, pos""",
)
def tokens(t: Tables) -> DataFrame:
    found = _docs(t).select("doc_id", F.posexplode(text.page_tokens(F.col("text"))).alias("pos", "_t"))
    return found.select("doc_id", "pos", "_t.line", "_t.word")


@query(
    "fuzzy_pairs",
    """SELECT p_partkey, a, b, levenshtein(a, b) AS distance,
         levenshtein(a, b) <= greatest(2, CAST(floor(least(length(a), length(b)) / 3.0) AS INTEGER)) AS alike
       FROM (SELECT p_partkey, split_part(p_name, ' ', 1) || split_part(p_name, ' ', 2) AS a,
               split_part(p_name, ' ', 2) || split_part(p_name, ' ', 1) AS b FROM part)""",
)
def fuzzy_pairs(t: Tables) -> DataFrame:
    one, two = (F.split_part("p_name", F.lit(" "), F.lit(i)) for i in (1, 2))
    paired = t.part.select("p_partkey", F.concat(one, two).alias("a"), F.concat(two, one).alias("b"))
    return paired.select(
        "p_partkey", "a", "b", F.levenshtein("a", "b").alias("distance"), script.similar(F.col("a"), F.col("b")).alias("alike")
    )


@query(
    "ordinal_words",
    f"WITH {ORDINALS_CTE} SELECT o_orderkey, o.word AS words, o.n AS back FROM orders JOIN ordinals o ON o.n = o_orderkey % 999 + 1",
)
def ordinal_words(t: Tables) -> DataFrame:
    worded = t.orders.select("o_orderkey", numbers.ordinal_words(F.col("o_orderkey") % 999 + 1).alias("words"))
    return worded.withColumn("back", numbers.ordinal_number(F.col("words")))


@query(
    "ordinal_suffix",
    """SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) || CASE WHEN o_orderkey % 100 BETWEEN 11 AND 13 THEN 'th'
         WHEN o_orderkey % 10 = 1 THEN 'st' WHEN o_orderkey % 10 = 2 THEN 'nd' WHEN o_orderkey % 10 = 3 THEN 'rd' ELSE 'th' END
         || '-amendment' AS amendment_id FROM orders""",
)
def ordinal_suffix(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", numbers.amendment_id(F.col("o_orderkey")).alias("amendment_id"))


@query(
    "roman_numbers",
    """SELECT p_partkey, label, repeat('M', n // 1000) || (['', 'C', 'CC', 'CCC', 'CD', 'D', 'DC', 'DCC', 'DCCC', 'CM'])[n // 100 % 10 + 1]
         || (['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'])[n // 10 % 10 + 1]
         || (['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'])[n % 10 + 1] || sfx AS roman, label AS back
       FROM (SELECT p_partkey, n, sfx, CAST(n AS VARCHAR) || sfx AS label FROM (
         SELECT p_partkey, CAST(p_partkey * 7 % 3999 + 1 AS INTEGER) AS n, (['', 'A', 'B'])[p_partkey % 3 + 1] AS sfx FROM part))""",
)
def roman_numbers(t: Tables) -> DataFrame:
    suffix = F.element_at(constant_array(["", "A", "B"]), (F.col("p_partkey") % 3 + 1).cast("int"))
    labelled = t.part.select("p_partkey", F.concat((F.col("p_partkey") * 7 % 3999 + 1).cast("string"), suffix).alias("label"))
    out = labelled.withColumn("roman", numbers.roman_label(F.col("label")))
    return out.withColumn("back", numbers.roman_number(F.col("roman")))


@query(
    "suffix_translate",
    f"""SELECT p_partkey, num, CAST(p_size AS VARCHAR) || chr(CAST(65 + p_partkey % 26 AS INTEGER)) || chr(CAST(65 + p_size % 26 AS INTEGER)) AS latin
        FROM (SELECT *, CAST(p_size AS VARCHAR) || substr('{fv.SUFFIX_CONSONANTS}', p_partkey % 26 + 1, 1)
          || substr('{fv.SUFFIX_CONSONANTS}', p_size % 26 + 1, 1) AS num FROM part)""",
)
def suffix_translate(t: Tables) -> DataFrame:
    def letter(c: str) -> Column:
        return F.substring(F.lit(fv.SUFFIX_CONSONANTS), (F.col(c) % 26 + 1).cast("int"), F.lit(1))

    number = F.concat(F.col("p_size").cast("string"), letter("p_partkey"), letter("p_size"))
    return t.part.select("p_partkey", number.alias("num")).withColumn("latin", script.latin_number(F.col("num")))


@query(
    "theme_class",
    """SELECT p_partkey, CASE WHEN p_size = 50 THEN 'rights' WHEN a BETWEEN 352 AND 360 OR b BETWEEN 352 AND 360 THEN 'emergency'
         WHEN a BETWEEN 12 AND 35 OR b BETWEEN 12 AND 35 THEN 'rights'
         WHEN a = 243 OR b = 243 OR a BETWEEN 330 AND 342 OR b BETWEEN 330 AND 342 THEN 'social'
         WHEN a BETWEEN 52 AND 151 OR a BETWEEN 245 AND 312 OR a BETWEEN 214 AND 231
           OR b BETWEEN 52 AND 151 OR b BETWEEN 245 AND 312 OR b BETWEEN 214 AND 231 THEN 'federal' ELSE 'general' END AS theme
       FROM (SELECT p_partkey, p_size, p_partkey % 395 + 1 AS a, p_size * 7 AS b FROM part)""",
)
def theme_class(t: Tables) -> DataFrame:
    items = F.array(
        F.concat((F.col("p_partkey") % 395 + 1).cast("string"), F.lit("A")), (F.col("p_size") * 7).cast("string"), F.lit("x")
    )
    given = F.when(F.col("p_size") == 50, "rights")
    return t.part.select("p_partkey", numbers.theme(items, given).alias("theme"))


@query(
    "date_display",
    """SELECT o_orderkey, strftime(o_orderdate, '%-d %B %Y') AS shown,
         upper(substr(o_orderpriority, 1, 1)) || lower(substr(o_orderpriority, 2)) AS sentence FROM orders""",
)
def date_display(t: Tables) -> DataFrame:
    return t.orders.select(
        "o_orderkey",
        text.display_date(F.to_date("o_orderdate")).alias("shown"),
        text.sentence_case(F.col("o_orderpriority")).alias("sentence"),
    )


# --- Devanagari text derived from the given prose -----------------------------

LATIN = "abcdefghijklmnopqrstuvwxyz37"
SOUNDS = "ाबकदिफगहीजखलमनोप्रसतुवथ|य�\u200c\ue000"


def devanagari(c: Column) -> Column:
    """Letters of a text as Devanagari letters and signs, well formed or not."""
    return F.translate(F.lower(c), LATIN, SOUNDS)


DEVANAGARI_SQL = f"SELECT doc_id, translate(lower(text), '{LATIN}', '{SOUNDS}') AS text FROM documents"


def devanagari_docs(t: Tables) -> DataFrame:
    return _docs(t).select("doc_id", devanagari(F.col("text")).alias("text"))


_S = fv.VOWEL_SIGNS
_AUDIT = rf"""hi AS ({DEVANAGARI_SQL}),
counts AS (
  SELECT doc_id, len(regexp_extract_all(text, '\x{{FFFD}}')) AS replacement,
    len(regexp_extract_all(text, '[\x{{E000}}-\x{{F8FF}}]')) AS private_use,
    len(regexp_extract_all(text, '\x{{200C}}')) AS zwnj,
    len(regexp_extract_all(text, '(?:^|\s)[^\s\x{{0900}}-\x{{097F}}\x{{1CD0}}-\x{{1CFF}}.,;:()\[\]"''\d]*[{_S}]')) AS sign_at_start,
    list_sum(list_transform(regexp_extract_all(text, '[{_S}{fv.VIRAMA}]+'), lambda r:
      length(replace(r, '{fv.VIRAMA}', '')) - CASE WHEN starts_with(r, '{fv.VIRAMA}') THEN 0 ELSE 1 END))
      + len(regexp_extract_all(text, '[{_S}]{fv.NUKTA}')) AS sign_after_sign,
    len(list_filter(range(1, len(string_split(text, '|'))), lambda i:
      regexp_matches(string_split(text, '|')[i], '[\x{{0900}}-\x{{097F}}]\s{{0,2}}$')
      OR regexp_matches(string_split(text, '|')[i + 1], '^\s{{0,2}}[\x{{0900}}-\x{{097F}}]'))) AS pipe_danda
  FROM hi
)"""


@query("script_audit", f"WITH {_AUDIT} SELECT * FROM counts")
def script_audit(t: Tables) -> DataFrame:
    c = F.col("text")
    names = ["replacement", "private-use", "zwnj", "sign-at-start", "sign-after-sign", "pipe-danda"]
    return devanagari_docs(t).select(
        "doc_id", *[script.rule_count(c, n).alias(n.replace("-", "_")) for n in names]
    )


@query(
    "lint_histogram",
    f"""WITH {_AUDIT}, sums AS (
          SELECT unnest(['replacement', 'private-use', 'zwnj', 'sign-at-start', 'sign-after-sign', 'pipe-danda']) AS rule,
            unnest([sum(replacement), sum(private_use), sum(zwnj), sum(sign_at_start), sum(sign_after_sign), sum(pipe_danda)]) AS n FROM counts)
        SELECT rule, CAST(n AS BIGINT) AS n, n <= 30 AS within_bound FROM sums WHERE n > 0""",
)
def lint_histogram(t: Tables) -> DataFrame:
    # Counted per document in place: no issue row is ever exploded or shuffled.
    c = F.col("text")
    per_doc = F.explode(
        F.array(*[F.struct(F.lit(rule).alias("rule"), script.rule_count(c, rule).alias("n")) for rule in script.RULES])
    )
    found = devanagari_docs(t).select(per_doc.alias("_r")).select("_r.*").filter("n > 0")
    return found.groupBy("rule").agg(F.sum("n").alias("n")).withColumn("within_bound", F.col("n") <= 30).orderBy(F.desc("n"))


# Every character with its neighbours; the kind of the last telling character
# before it decides whether a sign opens a word.
JUDGED = rf"""chars AS (SELECT doc_id, unnest(string_split(text, '')) AS c, unnest(range(length(text))) AS i FROM hi),
near AS (
  SELECT *, lag(c) OVER w AS p1, coalesce(lag(c, 3) OVER w, '') || coalesce(lag(c, 2) OVER w, '') || coalesce(lag(c) OVER w, '') AS before,
    coalesce(lead(c) OVER w, '') || coalesce(lead(c, 2) OVER w, '') || coalesce(lead(c, 3) OVER w, '') AS after,
    coalesce(lag(c, 4) OVER w, '') AS p4, coalesce(lead(c, 4) OVER w, '') AS n4,
    last_value(CASE WHEN regexp_matches(c, '\s') THEN 'space' WHEN regexp_matches(c, '[\x{{0900}}-\x{{097F}}\x{{1CD0}}-\x{{1CFF}}.,;:()\[\]"''\d]') THEN 'stop' END IGNORE NULLS)
      OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS told
  FROM chars WINDOW w AS (PARTITION BY doc_id ORDER BY i)
),
judged AS (
  SELECT doc_id, i, p4 || before || c || after || n4 AS excerpt, CASE
      WHEN c = chr(65533) THEN 'replacement'
      WHEN regexp_matches(c, '[\x{{E000}}-\x{{F8FF}}]') THEN 'private-use'
      WHEN c = chr(8204) THEN 'zwnj'
      WHEN c = '|' AND (regexp_matches(before, '[\x{{0900}}-\x{{097F}}]\s*$') OR regexp_matches(after, '^\s*[\x{{0900}}-\x{{097F}}]')) THEN 'pipe-danda'
      WHEN contains('{_S}', c) AND coalesce(told, 'space') = 'space' THEN 'sign-at-start'
      WHEN contains('{_S}', c) AND contains('{_S}{fv.VIRAMA}', p1) THEN 'sign-after-sign'
      WHEN c = '{fv.NUKTA}' AND contains('{_S}', p1) THEN 'sign-after-sign' END AS rule
  FROM near
)"""


@query(
    "script_issues",
    f"""WITH hi AS ({DEVANAGARI_SQL}), {JUDGED} SELECT doc_id, CAST(i AS INTEGER) AS "index", rule, excerpt FROM judged WHERE rule IS NOT NULL""",
)
def script_issues(t: Tables) -> DataFrame:
    """Every script issue of every document with its offset."""
    return devanagari_docs(t).select("doc_id", F.inline(script.issues(F.col("text"))))


@query("script_repair")
def script_repair(t: Tables) -> DataFrame:
    c = F.col("text")
    fixed = devanagari_docs(t).select("doc_id", "text", script.repair(c).alias("repaired"))
    return fixed.select(
        "doc_id",
        "repaired",
        script.issue_count(c).alias("issues_before"),
        script.issue_count(F.col("repaired")).alias("issues_after"),
    )


@query("inline_clauses")
def inline_clauses(t: Tables) -> DataFrame:
    """Flowing Devanagari text with an enumeration mark after every sentence, cut to clauses."""
    marked = F.array_join(
        F.transform(
            F.split("text", r"\.\s+"), lambda s, i: F.concat(F.lit("("), (i % 99 + 1).cast("string"), F.lit(") "), s)
        ),
        "। ",
    )
    docs = devanagari_docs(t).select("doc_id", marked.alias("text"))
    return docs.select("doc_id", F.posexplode(script.inline_clauses(F.col("text"))).alias("clause_no", "_c")).select(
        "doc_id", "clause_no", "_c.*"
    )


_HEAD = r"^(\d{1,4})([क-ह]{1,2})?[.।]\s+(.+)$"


@query(
    "heading_candidates",
    rf"""WITH l AS (
           SELECT p_partkey, (['', 'और ', '[', ''])[p_partkey % 4 + 1] || CAST(p_partkey % 1500 + 1 AS VARCHAR)
             || (['', 'क', 'यज', 'झ', ''])[p_partkey % 5 + 1] || '. ' || (['अधिनियम ', 'नाम '])[p_partkey % 2 + 1] || p_name AS line FROM part),
         s AS (SELECT p_partkey, line, regexp_replace(line, '^[\[(।\]\s]+', '') AS t FROM l),
         m AS (SELECT *, regexp_matches(t, '^((?:\S+\s+){{0,4}})\[?(\d{{1,4}}[क-ह]{{0,2}}[.।]\s+\S.*)$') AS hit,
           regexp_extract(t, '^((?:\S+\s+){{0,4}})\[?(\d{{1,4}}[क-ह]{{0,2}}[.।]\s+\S.*)$', 2) AS body,
           regexp_extract(t, '^((?:\S+\s+){{0,4}})\[?(\d{{1,4}}[क-ह]{{0,2}}[.।]\s+\S.*)$', 1) AS prefix FROM s),
         h AS (SELECT p_partkey, prefix, regexp_extract(body, '{_HEAD}', 1) AS digits, regexp_extract(body, '{_HEAD}', 2) AS sfx,
           regexp_extract(body, '{_HEAD}', 3) AS rest FROM m WHERE hit)
         SELECT p_partkey, digits || sfx AS number_hi, digits || translate(sfx, '{fv.SUFFIX_CONSONANTS}', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS latin,
           rest, prefix, array_to_string(list_distinct_ordered, ' ') AS candidates
         FROM (SELECT *, list_filter([digits || sfx,
             CASE WHEN length(digits) > 3 THEN right(digits, 3) || sfx END,
             CASE WHEN length(digits) > 2 THEN right(digits, 2) || sfx END,
             CASE WHEN substr(sfx, 1, 1) = 'झ' THEN digits || 'ज' || substr(sfx, 2) END,
             CASE WHEN substr(sfx, 2, 1) = 'ज' THEN digits || substr(sfx, 1, 1) || 'ञ' END],
             lambda x: x IS NOT NULL) AS list_distinct_ordered FROM h)
         WHERE length(rest) >= 3 AND NOT (length(digits) = 1 AND regexp_matches(rest, '{"|".join(fv.FOOTNOTE_SIGNALS_HI)}'))
           AND least(CAST(digits AS INTEGER), CAST(right(digits, 3) AS INTEGER), CAST(right(digits, 2) AS INTEGER)) <= {fv.MAX_ITEM_NUMBER}""",
)
def heading_candidates(t: Tables) -> DataFrame:
    key = F.col("p_partkey")

    def pick(values: list[str]) -> Column:
        return F.element_at(constant_array(values), (key % len(values) + 1).cast("int"))

    line = F.concat(
        pick(["", "और ", "[", ""]),
        (key % 1500 + 1).cast("string"),
        pick(["", "क", "यज", "झ", ""]),
        F.lit(". "),
        pick(["अधिनियम ", "नाम "]),
        "p_name",
    )
    read = spread(t.part.select("p_partkey", "p_name")).select("p_partkey", script.heading(line).alias("_h")).filter("_h IS NOT NULL").select("p_partkey", "_h.*")
    return read.withColumn("candidates", F.array_join(script.number_candidates(F.col("number_hi")), " "))
