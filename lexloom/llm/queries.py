"""Registered queries of the operators, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder
from ..sources.tables import table
from . import (
    ann,
    byte_bpe,
    conversation_trie,
    html_text,
    maxscore,
    packing,
    quality,
    sentencepiece,
    simhash,
    spelling,
    token_counts,
    toxicity,
    warc,
)
from .common import held_out

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    documents = table(spark, folder, "documents")
    model = toxicity.train(documents, table(spark, folder, "labels"))
    fold = held_out(F.col("doc_id"), toxicity.FOLDS, toxicity.HELD_OUT).alias("held_out")
    return toxicity.score(documents, model).select("doc_id", fold, "score", "predicted")


def op2_warc(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to."""
    archives = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    return warc.round_trip(table(spark, folder, "pages"), archives)


def op3_vantage_tree(spark: SparkSession, folder: str) -> DataFrame:
    """query_id, rank, vec_id, score."""
    vectors = table(spark, folder, "embeddings")
    return ann.nearest_neighbours(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, fingerprint, component_id."""
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return found.select("doc_id", digits, "component_id")


def op5_html_text(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, url, text, n_chars."""
    return html_text.extract(table(spark, folder, "pages"))


def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, n_tokens, n_pretokens, n_distinct."""
    return token_counts.token_counts(table(spark, folder, "documents"), PIECE_MODEL)


def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    documents = table(spark, folder, "documents")
    model = quality.train(documents, table(spark, folder, "labels"))
    fold = held_out(F.col("doc_id"), quality.FOLDS, quality.HELD_OUT).alias("held_out")
    return quality.score(documents, model).select("doc_id", fold, "score", "predicted")


def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return packing.pack(table(spark, folder, "documents"), WORD_TOKENIZER)


def op9_maxscore(spark: SparkSession, folder: str) -> DataFrame:
    """query_id, rank, vec_id, score."""
    vectors = table(spark, folder, "embeddings")
    return maxscore.top_inner_products(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op10_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32, round_trip."""
    return sentencepiece.digests(table(spark, folder, "documents"), PIECE_MODEL)


def op11_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return byte_bpe.digests(table(spark, folder, "documents"), BYTE_RANKS, public_tokenizers.PATTERN)


def op12_spelling(spark: SparkSession, folder: str) -> DataFrame:
    """word, form, root, n, n_near, form_n."""
    return spelling.spelling_variants(table(spark, folder, "documents"))


def op13_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    return conversation_trie.prefix_trie(table(spark, folder, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_warc,
        op3_vantage_tree,
        op4_simhash,
        op5_html_text,
        op6_token_counts,
        op7_quality,
        op8_packing,
        op9_maxscore,
        op10_sentencepiece,
        op11_byte_bpe,
        op12_spelling,
        op13_conversation_trie,
    )
}

#: The bytewise table of CRC-32 as a one-row relation, and the checksum of a list of bytes (``t`` is that relation).
CRC_TABLE = """crc AS (
            SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
                lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
        )"""


def crc_sql(data: str) -> str:
    return f"""xor(list_reduce(list_prepend(4294967295, {data}),
                lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"""


ORACLES: dict[str, str] = {
    "op2_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS payload FROM pages
        ), d AS (
            SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest FROM p
        ), f AS (
            SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d
        )
        SELECT page_id, payload_bytes, payload_digest,
            CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN first_id END AS refers_to
        FROM f
    """,
    "op9_maxscore": """
        WITH v AS (
            SELECT vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0
                AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding])
        ), s AS (
            SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score
            FROM v AS q JOIN v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id AND len(q.e) = len(v.e)
        ), r AS (
            SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
                vec_id, score
            FROM s
        )
        SELECT * FROM r WHERE rank <= 20
    """,
    "op12_spelling": rf"""
        WITH RECURSIVE {CRC_TABLE}, r AS (
            SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
            FROM documents
        ), g AS (
            SELECT doc_id, run, count(*) AS n FROM r WHERE length(run) >= 7 GROUP BY ALL
        ), h AS (
            SELECT run, n, {crc_sql("""flatten(list_transform(
                string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
                lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195, unicode(x)::BIGINT - 64] END))""")} AS h
            FROM g, crc
        ), d AS (
            SELECT n, CASE WHEN h % 31 = 0
                THEN left(run, (h % length(run))::INTEGER) || substr(run, (h % length(run))::INTEGER + 2)
                ELSE run END AS word
            FROM h
        ), w AS (
            SELECT word, sum(n)::BIGINT AS n FROM d WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
        ), e AS (
            SELECT DISTINCT word, n, i, left(word, i::INTEGER) || substr(word, i::INTEGER + 2) AS less
            FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)
        ), near AS (
            SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS other_n
            FROM e AS a JOIN e AS b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
            UNION
            SELECT e.word, e.n, w.word, w.n FROM e JOIN w ON e.less = w.word
            UNION
            SELECT w.word, w.n, e.word, e.n FROM e JOIN w ON e.less = w.word
        ), best AS (
            SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, encode(other)) AS other,
                max(other_n) AS other_n
            FROM near GROUP BY word
        ), f AS (
            SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * w.n THEN other END AS form,
                CASE WHEN other_n >= 10 * w.n THEN other_n END AS form_n
            FROM w LEFT JOIN best USING (word)
        ), chain AS (
            SELECT word, word AS root FROM f
            UNION ALL
            SELECT chain.word, f.form FROM chain JOIN f ON chain.root = f.word WHERE f.form IS NOT NULL
        ), ended AS (
            SELECT chain.word, root FROM chain JOIN f ON root = f.word WHERE f.form IS NULL
        )
        SELECT word, form, root, n, n_near, form_n FROM f JOIN ended USING (word)
    """,
    "op13_conversation_trie": f"""
        WITH {CRC_TABLE}, o AS (
            SELECT conv_id::BIGINT AS c, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS m,
                length(coalesce(text, ''))::BIGINT AS size, turn
            FROM conversations WHERE conv_id IS NOT NULL
        ), own AS (
            SELECT c, list({{'m': m, 'size': size}} ORDER BY turn NULLS FIRST, m) AS turns FROM o GROUP BY c
        ), h AS (
            SELECT c, turns, {crc_sql("list_transform(string_split(c::VARCHAR, ''), lambda x: unicode(x)::BIGINT)")} % 6 AS h
            FROM own, crc
        ), rebuilt AS (
            SELECT h.c, coalesce(b.turns, [])[1:h.h] || h.turns[h.h + 1:] AS turns
            FROM h LEFT JOIN own AS b ON b.c = h.c - h.c % 100
        ), members AS (
            SELECT c, d, turns[1:d] AS node, turns[1:d - 1] AS parent, coalesce(turns[d].size, 0) AS size,
                d = len(turns) AS ends
            FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM rebuilt)
        ), nodes AS (
            SELECT d AS depth, node, any_value(parent) AS parent, min(c) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
                sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256
            FROM members GROUP BY d, node
        ), kids AS (
            SELECT depth - 1 AS depth, parent AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL
        ), n AS (
            SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (depth, node)
        ), above AS (
            SELECT node AS below, n_children, (n_convs - 1) * size AS saved, unnest(range(depth + 1)) AS depth FROM n
        ), sums AS (
            SELECT depth, below[1:depth] AS node, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens
            FROM above GROUP BY ALL
        )
        SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, sums.n_leaves,
            sums.saved_tokens, n.ends_sha256
        FROM n JOIN sums USING (depth, node) LEFT JOIN n AS p ON n.depth = p.depth + 1 AND n.parent = p.node
    """,
}
