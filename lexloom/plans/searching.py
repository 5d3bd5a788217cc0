"""Queries on chunks, ranks, vectors and reconciled texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import text
from ..operators import chunk, embed, reconcile, search
from ..session import checkpointed
from ..sources.tables import spread
from .registry import Tables, query
from .texts import devanagari

TYPED = {1: "thing erble", 2: "Ering the Oning", 3: "what is the thble can", 4: "ertion attion nowhere", 5: "antion"}


def _bm25(queries: dict[int, str]) -> str:
    """CTEs toks, stats, df, hits(qid, doc_id, lang, score) for AND queries ranked by BM25."""
    terms = ", ".join(
        f"({qid}, '{t}')" for qid, q in queries.items() for t in search._terms(q)
    )
    return f"""
    q(qid, term) AS (VALUES {terms}),
    toks AS (SELECT doc_id, lang, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM documents),
    stats AS (SELECT count(*) AS n, avg(len(ws)) AS avgdl FROM toks),
    occ AS (SELECT doc_id, lang, len(ws) AS dl, unnest(ws) AS w, len(ws) FROM toks),
    tf AS (SELECT doc_id, lang, dl, w, count(*) AS tf FROM occ WHERE w IN (SELECT term FROM q) GROUP BY ALL),
    df AS (SELECT w, count(*) AS df FROM tf GROUP BY w),
    need AS (SELECT qid, count(*) AS m FROM q GROUP BY qid),
    hits AS (
      SELECT q.qid, tf.doc_id, tf.lang, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * {search.K1 + 1}::DOUBLE
        / (tf + {search.K1}::DOUBLE * (1 - {search.B}::DOUBLE + {search.B}::DOUBLE * dl / avgdl))), 6) AS score
      FROM q JOIN tf ON tf.w = q.term JOIN df ON df.w = q.term JOIN need USING (qid), stats
      GROUP BY q.qid, tf.doc_id, tf.lang, m HAVING count(*) = m
    )"""


@query(
    "keyword_search",
    f"""WITH {_bm25(TYPED)} SELECT * FROM (
          SELECT qid, doc_id, score, count(*) OVER (PARTITION BY qid) AS total_hits,
            row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM hits) WHERE rank <= {fv.KEYWORD_LIMIT}""",
)
def keyword_search(t: Tables) -> DataFrame:
    return search.keyword_search(spread(t.documents), "doc_id", "text", TYPED).drop("refined")


_ASKED = {**TYPED, **{100 + k: search.refine(q) for k, q in TYPED.items() if search.refine(q) != q}}


@query(
    "keyword_retry",
    f"""WITH {_bm25(_ASKED)}, answered AS (
          SELECT qid % 100 AS qid, doc_id, score, qid > 100 AS refined FROM hits
          WHERE qid < 100 OR qid % 100 NOT IN (SELECT qid FROM hits WHERE qid < 100))
        SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY qid) AS total_hits,
          row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM answered) WHERE rank <= {fv.KEYWORD_LIMIT}""",
)
def keyword_retry(t: Tables) -> DataFrame:
    return search.keyword_search(spread(t.documents), "doc_id", "text", TYPED, retry=True)


@query(
    "facet_results",
    f"""WITH {_bm25(TYPED)} SELECT qid, doc_id, lang, rank, CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE 3 END AS facet_no
        FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM hits) WHERE rank <= {fv.KEYWORD_LIMIT}""",
)
def facet_results(t: Tables) -> DataFrame:
    hits = search.keyword_search(spread(t.documents), "doc_id", "text", TYPED, keep=["lang"])
    return search.facet_groups(hits, "lang", ["en", "fr", "de"]).select("qid", "doc_id", "lang", "rank", "facet_no")


#: Vectors that a query vector is the sum of: it is about as near to each of them, and to each above the cutoff.
SUMMED = 4


def _label_queries(t: Tables) -> DataFrame:
    """One query vector per label: the sum of the label's first vectors."""
    order = W.partitionBy("label").orderBy("vec_id")
    firsts = t.embeddings.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= SUMMED)
    vectors = F.transform(F.array_sort(F.collect_list(F.struct("_n", "embedding"))), lambda s: s["embedding"].cast("array<double>"))
    held = firsts.groupBy(F.col("label").alias("qid")).agg(vectors.alias("v"))
    total = F.aggregate(F.slice("v", 2, SUMMED), F.get("v", F.lit(0)), lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
    return held.select("qid", total.alias("qv"))


_COSINE = """
    qv AS (SELECT qid, list(x ORDER BY d) AS v FROM (
        SELECT label AS qid, d, sum(x) AS x FROM (
          SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS d FROM (
            SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings) WHERE n <= 4)
        GROUP BY ALL) GROUP BY qid),
    sims AS (
      SELECT qid, vec_id, label, list_dot_product(CAST(q.v AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))
        / (sqrt(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(q.v AS DOUBLE[]))) * sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])))) AS score
      FROM embeddings e, qv q)"""


@query(
    "vector_search",
    f"""WITH {_COSINE} SELECT qid, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank
          FROM (SELECT qid, vec_id, round(score, 6) AS score FROM sims WHERE score >= {fv.VECTOR_CUTOFF})) WHERE rank <= {fv.VECTOR_LIMIT}""",
)
def vector_search(t: Tables) -> DataFrame:
    return search.vector_search(spread(t.embeddings), "vec_id", "embedding", _label_queries(t), "qid", "qv")


@query(
    "vector_neighbours",
    f"""WITH {_COSINE} SELECT qid, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank
          FROM (SELECT qid, vec_id, round(score, 6) AS score FROM sims WHERE score >= 0.1)) WHERE rank <= {fv.VECTOR_LIMIT}""",
)
def vector_neighbours(t: Tables) -> DataFrame:
    """A lower cutoff, so that the limit decides what is kept."""
    return search.vector_search(spread(t.embeddings), "vec_id", "embedding", _label_queries(t), "qid", "qv", cutoff=0.1)


@query(
    "hybrid_search",
    f"""WITH {_bm25(TYPED)}, {_COSINE},
        vec AS (SELECT qid, vec_id AS doc_id, label::BIGINT AS label, score FROM sims WHERE score >= {fv.VECTOR_CUTOFF}),
        txt AS (SELECT qid, doc_id, coalesce(label, -1 - doc_id)::BIGINT AS label, score FROM hits LEFT JOIN embeddings ON vec_id = doc_id),
        tn AS (SELECT qid, doc_id, label, CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1.0 END AS s FROM txt
          JOIN (SELECT qid, min(score) AS lo, max(score) AS hi FROM txt GROUP BY qid) USING (qid)),
        vn AS (SELECT qid, doc_id, label, CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1.0 END AS s FROM vec
          JOIN (SELECT qid, min(score) AS lo, max(score) AS hi FROM vec GROUP BY qid) USING (qid)),
        merged AS (SELECT qid, doc_id, label, round(coalesce(tn.s, 0) * 0.5 + coalesce(vn.s, 0) * 0.5, 6) AS score
          FROM tn FULL OUTER JOIN vn USING (qid, doc_id, label)),
        best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, label ORDER BY score DESC, doc_id) AS rn FROM merged) WHERE rn = 1)
        SELECT qid, label, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, label) AS rank FROM best)
        WHERE rank <= {fv.VECTOR_LIMIT}""",
)
def hybrid_search(t: Tables) -> DataFrame:
    vectors = spread(t.embeddings).withColumnRenamed("vec_id", "doc_id").withColumn("label", F.col("label").cast("long"))
    by_meaning = search.vector_scores(vectors, "doc_id", "embedding", _label_queries(t), "qid", "qv", keep=["label"])
    by_word = search.keyword_scores(spread(t.documents), "doc_id", "text", TYPED)
    # Rounded like the keyword ranks; only hits meet the vector side, on their key. A document without a vector is an
    # item of its own.
    by_word = by_word.select("qid", "doc_id", F.round("score", 6).alias("score"))
    by_word = by_word.join(vectors.select("doc_id", "label"), "doc_id", "left")
    by_word = by_word.withColumn("label", F.coalesce("label", -1 - F.col("doc_id")))
    return search.hybrid_search(by_word, by_meaning, "doc_id", "label").select("qid", "label", "doc_id", "score", "rank")


@query("concept_search")
def concept_search(t: Tables) -> DataFrame:
    """The chain of a search by meaning: chunks, vectors, codes and back, the embedded query text, hybrid ranks."""
    prefix = F.concat(F.lit("Document "), F.col("doc_id").cast("string"), F.lit(" in "), F.col("lang"))
    pieces = chunk.pack(chunk.units_of(prefix, F.split("text", "\n")))
    cut = spread(t.documents).select("doc_id", F.posexplode(pieces).alias("chunk_no", "t"))
    cut = cut.select(F.concat_ws("-", "doc_id", "chunk_no").alias("chunk_id"), "doc_id", "t")
    # Both the largest component and the codes come from the vectors, so they are written once.
    stored = checkpointed(cut.withColumn("vector", embed.hashed_embedding(F.col("t"))))
    coded = search.quantize(stored, "vector").withColumn("vector", search.dequantize(F.col("codes"), F.col("scale")))
    typed = t.spark.createDataFrame(list(TYPED.items()), "qid int, q string")
    asked = typed.select("qid", embed.hashed_embedding(F.col("q")).alias("qv"))
    by_meaning = search.vector_scores(coded, "chunk_id", "vector", asked, "qid", "qv", cutoff=0.15, keep=["doc_id"])
    by_word = search.keyword_scores(stored, "chunk_id", "t", TYPED, keep=["doc_id"])
    return search.hybrid_search(by_word, by_meaning, "chunk_id", "doc_id").select("qid", "doc_id", "chunk_id", "score", "rank")


@query(
    "quantize",
    """WITH m AS (SELECT max(list_max(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE))))) AS m FROM embeddings)
       SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CAST(CAST(floor(CAST(x AS DOUBLE) / m * 127 + 0.5) AS BIGINT) AS VARCHAR)), ',') AS codes,
         round(m / 127, 9) AS scale FROM embeddings, m""",
)
def quantize(t: Tables) -> DataFrame:
    coded = search.quantize(spread(t.embeddings), "embedding")
    shown = F.array_join(F.transform("codes", lambda c: c.cast("string")), ",")
    return coded.select("vec_id", shown.alias("codes"), F.round("scale", 9).alias("scale"))


def _wc(c: str) -> str:
    return f"len(regexp_extract_all({c}, '\\S+'))"


def _trim(c: str) -> str:
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


_NONE = "CAST([] AS VARCHAR[])"


def _finish(state: str) -> str:
    return f"list_transform([{state}], lambda f: CASE WHEN {_trim('f.cur')} <> '' THEN list_append(f.res, {_trim('f.cur')}) ELSE f.res END)[1]"


def _pieces_sql(c: str, limit: str, v: str) -> str:
    """Sentence pieces of a text up to a word limit; ``v`` keeps nested names apart."""
    found = f"regexp_extract_all({c}, '[^.!?]+[.!?]*')"
    sentences = f"CASE WHEN len({found}) > 0 THEN {found} ELSE [{c}] END"
    items = f"list_transform({sentences}, lambda s{v}: {{'cur': s{v}, 'res': {_NONE}}})"
    step = (
        f"CASE WHEN a{v}.cur <> '' AND {_wc(f'a{v}.cur')} + {_wc(f'x{v}.cur')} > {limit} "
        f"THEN {{'cur': ' ' || x{v}.cur, 'res': list_append(a{v}.res, {_trim(f'a{v}.cur')})}} "
        f"ELSE {{'cur': a{v}.cur || ' ' || x{v}.cur, 'res': a{v}.res}} END"
    )
    return _finish(f"list_reduce({items}, lambda a{v}, x{v}: {step}, {{'cur': '', 'res': {_NONE}}})")


_MAX, _MIN = fv.CHUNK_MAX_WORDS, fv.CHUNK_MIN_WORDS


def _append_sql(cur: str, res: str, unit: str) -> str:
    b = f"({cur} || ' ' || {unit})"
    return (
        f"CASE WHEN {_wc(b)} >= {_MIN} THEN {{'cur': '', 'res': list_append({res}, {_trim(b)})}} "
        f"ELSE {{'cur': {b}, 'res': {res}}} END"
    )


_ABSORBED = f"""list_transform([{_pieces_sql("x.cur", f"({_MAX} - {_wc('a.cur')})", "p")}], lambda ps: {{
  'cur': coalesce(ps[len(ps)], ''), 'res': list_append(a.res, {_trim("(a.cur || CASE WHEN len(ps) > 1 THEN ' ' || array_to_string(ps[1:len(ps) - 1], ' ') ELSE '' END)")})}})[1]"""
_PACK_STEP = f"""CASE WHEN a.cur <> '' AND {_wc("a.cur")} + {_wc("x.cur")} > {_MAX} THEN
    CASE WHEN {_wc("a.cur")} >= {_MIN // 2} THEN {_append_sql("''", f"list_append(a.res, {_trim('a.cur')})", "x.cur")} ELSE {_ABSORBED} END
  ELSE {_append_sql("a.cur", "a.res", "x.cur")} END"""


@query(
    "chunks",
    f"""WITH u AS (
          SELECT doc_id, flatten(list_concat([['Document ' || CAST(doc_id AS VARCHAR) || ' in ' || lang]], list_transform(string_split(text, chr(10)),
            lambda c: CASE WHEN {_wc("c")} > {_MAX} THEN {_pieces_sql("c", str(_MAX), "u")} ELSE [{_trim("c")}] END))) AS units
          FROM documents),
        p AS (SELECT doc_id, {_finish(f"list_reduce(list_transform(units, lambda x0: {{'cur': x0, 'res': {_NONE}}}), lambda a, x: {_PACK_STEP}, {{'cur': '', 'res': {_NONE}}})")} AS packed FROM u)
        SELECT doc_id, CAST(chunk_no AS INTEGER) AS chunk_no, {_wc("t")} AS n_words, {_wc("t")} > {_MAX} AS over_cap, sha256(t) AS digest FROM (
          SELECT doc_id, unnest(packed) AS t, unnest(range(len(packed))) AS chunk_no FROM p)""",
)
def chunks(t: Tables) -> DataFrame:
    prefix = F.concat(F.lit("Document "), F.col("doc_id").cast("string"), F.lit(" in "), F.col("lang"))
    packed = chunk.pack(chunk.units_of(prefix, F.split("text", "\n")))
    out = spread(t.documents).select("doc_id", F.posexplode(packed).alias("chunk_no", "t"))
    n = text.word_count(F.col("t"))
    return out.select(
        "doc_id", "chunk_no", n.alias("n_words"), (n > fv.CHUNK_MAX_WORDS).alias("over_cap"), F.sha2("t", 256).alias("digest")
    )


@query("embed_hash")
def embed_hash(t: Tables) -> DataFrame:
    vectors = spread(t.documents).select("doc_id", embed.hashed_embedding(F.col("text")).alias("vector"))
    return vectors.withColumn("norm", F.round(search.norm(F.col("vector")), 4))


def _noisy_pair(t: Tables) -> DataFrame:
    """Two damaged versions of each whole Devanagari text: words lost in one, letters swapped in the other."""
    docs = spread(t.documents).select("doc_id", devanagari(F.col("text")).alias("text"))

    def spoil(keep, change):
        def per_line(line, i):
            ws = F.filter(F.split(line, " "), lambda w, k: keep(k + i))
            return F.array_join(F.transform(ws, lambda w, k: change(w, k + i)), " ")

        return F.array_join(F.transform(F.split("text", "\n"), per_line), "\n")

    swapped = lambda w: F.concat(F.substring(w, 2, 1), F.substring(w, 1, 1), F.substring(w, F.lit(3), F.length(w)))
    ocr = spoil(lambda k: k % 11 != 3, lambda w, k: w)
    layer = spoil(lambda k: k % 17 != 5, lambda w, k: F.when(k % 7 == 2, swapped(w)).when(k % 13 == 4, F.concat(F.lit("1["), w)).otherwise(w))
    return docs.select("doc_id", ocr.alias("ocr"), layer.alias("layer"))


@query("fuse_align")
def fuse_align(t: Tables) -> DataFrame:
    fused = reconcile.fuse(_noisy_pair(t), "ocr", "layer")
    return fused.select("doc_id", "text", F.size("flags").alias("n_flags"))


@query("fuse_quality")
def fuse_quality(t: Tables) -> DataFrame:
    return reconcile.fusion_quality(reconcile.fuse(_noisy_pair(t), "ocr", "layer"))
