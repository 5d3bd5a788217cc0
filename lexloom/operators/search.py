"""Keyword, vector and hybrid top-k search.

Typed queries travel as literals. The corpus is tokenized once into narrow
counts, from which both the statistics and the scores come. Vectors and query
vectors meet in blocks, as matrix products; each block keeps the best k per query.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.text import search_tokens
from ..session import checkpointed

# Workers need not have this package installed: its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

K1, B = 1.2, 0.75
# Rows of one block of vectors and of one block of queries: what a task multiplies at once.
VECTOR_ROWS, QUERY_ROWS = 2048, 1024


def refine(query: str) -> str:
    """Lower case without stop words; the query itself when nothing is left."""
    kept = [w for w in query.lower().split() if w not in fv.STOP_WORDS]
    return " ".join(kept) if kept else query


def _terms(query: str) -> list[str]:
    import re

    return list(dict.fromkeys(re.findall(r"[a-z0-9]+", query.lower())))


def _counted(docs: DataFrame, key: str, text: str, terms: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """(key, kept columns, dl, tf): length and one count per term, null without a hit; tokens end here."""
    tokens = docs.select(key, *keep, search_tokens(F.col(text)).alias("_tokens"))
    hits = F.filter("_tokens", lambda w: w.isin(*terms))
    counted = tokens.select(key, *keep, F.size("_tokens").alias("_dl"), hits.alias("_hits"))

    def times(term: str) -> Column:
        return F.size(F.filter("_hits", lambda w: w == term))

    tf = F.when(F.size("_hits") > 0, F.array(*[times(t) for t in terms]))
    return counted.select(key, *keep, "_dl", tf.alias("_tf"))


def keyword_scores(
    docs: DataFrame, key: str, text: str, queries: Mapping[int, str], retry: bool = False, keep: Sequence[str] = ()
) -> DataFrame:
    """All hits: (qid, key, kept columns, score, total_hits, refined).

    A hit holds every word of the query and is ranked by BM25. With ``retry`` a
    query without hits is asked again without stop words.
    """
    asked = [(qid, q, False) for qid, q in queries.items()]
    if retry:
        asked += [(qid, refine(q), True) for qid, q in queries.items() if refine(q) != q]
    terms = list(dict.fromkeys(t for _, q, _ in asked for t in _terms(q)))
    at = {t: i for i, t in enumerate(terms)}
    counted = checkpointed(_counted(docs, key, text, terms, keep))

    def tf(t: str) -> Column:
        return F.coalesce(F.get("_tf", F.lit(at[t])), F.lit(0))

    def holds(q: str) -> Column:
        every = F.lit(bool(_terms(q)))
        for t in _terms(q):
            every = every & (tf(t) > 0)
        return every

    stats = counted.agg(
        F.struct(
            F.count(F.lit(1)).cast("double").alias("n"),
            F.avg("_dl").alias("avgdl"),
            F.array(*[F.count_if(tf(t) > 0).cast("double") for t in terms]).alias("df"),
            F.array(*[F.count_if(holds(q)) for _, q, _ in asked]).alias("hits"),
        ).alias("s")
    ).scalar()
    known = counted.withColumn("_s", stats)

    def weight(t: str) -> Column:
        df = F.get(F.col("_s.df"), F.lit(at[t]))
        idf = F.log(1 + (F.col("_s.n") - df + 0.5) / (df + 0.5))
        norm = 1 - B + B * F.col("_dl") / F.col("_s.avgdl")
        return idf * tf(t) * (K1 + 1) / (tf(t) + K1 * norm)

    place = {(qid, refined): i for i, (qid, _, refined) in enumerate(asked)}
    scored = []
    for qid, q, refined in asked:
        total = F.get(F.col("_s.hits"), F.lit(place[qid, refined]))
        allowed = holds(q)
        if refined:
            allowed = allowed & (F.get(F.col("_s.hits"), F.lit(place[qid, False])) == 0)
        score = F.lit(0.0)
        for t in _terms(q):
            score = score + weight(t)
        scored.append(
            F.when(
                allowed,
                F.struct(
                    F.lit(qid).alias("qid"), score.alias("score"), total.alias("total_hits"), F.lit(refined).alias("refined")
                ),
            )
        )
    found = F.filter(F.array(*scored), lambda s: s.isNotNull())
    return known.filter(F.col("_tf").isNotNull()).select(key, *keep, F.inline(found))


def top_k(scored: DataFrame, group: str, score: str, tie: str, k: int) -> DataFrame:
    """Best k per group with their rank; each task keeps k per group before the shuffle."""
    ranked = W.partitionBy(group).orderBy(F.desc(score), F.asc(tie))
    return scored.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)


def keyword_search(
    docs: DataFrame,
    key: str,
    text: str,
    queries: Mapping[int, str],
    k: int = fv.KEYWORD_LIMIT,
    retry: bool = False,
    keep: Sequence[str] = (),
) -> DataFrame:
    scored = keyword_scores(docs, key, text, queries, retry, keep)
    # Rounded before ranking so equal scores tie on the key everywhere.
    return top_k(scored.withColumn("score", F.round("score", 6)), "qid", "score", key, k)


def facet_groups(hits: DataFrame, facet: str, order: Sequence[str]) -> DataFrame:
    """Hits under their facet in the given facet order; unknown facets come last."""
    from ..functions.let import constant_map

    place = F.coalesce(constant_map({f: i for i, f in enumerate(order)})[F.col(facet)], F.lit(len(order)))
    return hits.withColumn("facet_no", place).orderBy("qid", "facet_no", "rank")


# --- vectors ------------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def _blocks(df: DataFrame, rows: int, slots: int) -> DataFrame:
    """(slot, blob): the rows in Arrow blocks of bounded height, dealt to slots; nothing is shuffled."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = TaskContext.get().partitionId()
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                out = pa.BufferOutputStream()
                with pa.ipc.new_stream(out, batch.schema) as writer:
                    writer.write_batch(batch.slice(start, rows))
                blob = pa.array([out.getvalue().to_pybytes()], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([slot % slots], pa.int32()), blob], names=["slot", "blob"])
                slot += 1

    return df.mapInArrow(pack, "slot int, blob binary")


def _opened(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all().combine_chunks()


def _by_length(table: pa.Table, vector: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Row numbers and unit vectors by vector length; vectors that are null, zero or not finite are left out."""
    lists = table.column(vector).combine_chunks()
    sizes = np.asarray(lists.value_lengths().fill_null(0))
    found = {}
    for size in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == size)
        flat = lists.take(pa.array(rows)).flatten().cast(pa.float64())
        matrix = np.asarray(flat.to_numpy(zero_copy_only=False)).reshape(-1, size)
        norms = np.linalg.norm(matrix, axis=1)
        usable = np.isfinite(norms) & (norms > 0)
        found[size] = rows[usable], matrix[usable] / norms[usable, None]
    return found


def vector_scores(
    chunks: DataFrame,
    key: str,
    vector: str,
    queries: DataFrame,
    qid: str,
    query_vector: str,
    cutoff: float = fv.VECTOR_CUTOFF,
    keep: Sequence[str] = (),
    best: int | None = None,
) -> DataFrame:
    """Cosine of every chunk with every query at or above the cutoff: (qid, key, kept, score).

    Both sides travel as blocks of bounded height. A block of vectors lies in one
    slot and every block of queries goes to every slot, so the two meet in an
    equi-join and as one matrix product, however many there are of either. With
    ``best`` a block returns only that many rows per query, ranked by the score
    rounded to six digits and then the key. Vectors that are null, zero or hold
    components that are null or not finite match nothing, nor do vectors of
    another length than the query's.
    """
    slots = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = queries.select(F.col(qid).alias("_qid"), F.col(query_vector).alias("_qv"))
    rows = chunks.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_kept_{c}") for c in keep], F.col(vector).alias("_vector"))
    sent = _blocks(asked, QUERY_ROWS, slots).select(
        F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"), F.col("blob").alias("asked")
    )
    pairs = _blocks(rows, VECTOR_ROWS, slots).join(sent, "slot").select("blob", "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, asked_blob in zip(batch.column("blob"), batch.column("asked")):
                table, wanted = _opened(blob.as_py()), _opened(asked_blob.as_py())
                theirs = _by_length(table, "_vector")
                for size, (who, units) in _by_length(wanted, "_qv").items():
                    at, others = theirs.get(size, (None, None))
                    if at is None:
                        continue
                    scores = units @ others.T
                    q, v = np.nonzero(scores >= cutoff)
                    found = scores[q, v]
                    if best is not None:
                        ties = np.unique(table.column("_key").to_numpy()[at], return_inverse=True)[1]
                        order = np.lexsort((ties[v], -np.round(found, 6), q))
                        place = np.arange(len(order)) - np.searchsorted(q[order], q[order])
                        order = order[place < best]
                        q, v, found = q[order], v[order], found[order]
                    hits = table.drop_columns(["_vector"]).take(pa.array(at[v]))
                    hits = hits.add_column(0, "_qid", wanted.column("_qid").take(pa.array(who[q])))
                    yield from hits.append_column("score", pa.array(found, pa.float64())).to_batches()

    kinds = [("_qid", asked.schema["_qid"])] + [(f.name, f) for f in rows.schema.fields if f.name != "_vector"]
    schema = ", ".join(f"`{name}` {f.dataType.simpleString()}" for name, f in kinds)
    scored = pairs.mapInArrow(run, f"{schema}, score double")
    kept = [F.col(f"_kept_{c}").alias(c) for c in keep]
    return scored.select(F.col("_key").alias(key), *kept, F.col("_qid").alias("qid"), "score")


def vector_search(
    chunks: DataFrame,
    key: str,
    vector: str,
    queries: DataFrame,
    qid: str,
    query_vector: str,
    cutoff: float = fv.VECTOR_CUTOFF,
    k: int = fv.VECTOR_LIMIT,
) -> DataFrame:
    scored = vector_scores(chunks, key, vector, queries, qid, query_vector, cutoff, best=k)
    return top_k(scored.withColumn("score", F.round("score", 6)), "qid", "score", key, k)


def _scaled(scored: DataFrame, name: str) -> DataFrame:
    """Scores of each query stretched to 0..1; a single value counts as 1."""
    span = scored.groupBy("qid").agg(F.min("score").alias("_low"), F.max("score").alias("_high"))
    width = F.col("_high") - F.col("_low")
    scaled = F.when(width > 0, (F.col("score") - F.col("_low")) / width).otherwise(F.lit(1.0))
    return scored.join(span, "qid").withColumn(name, scaled).drop("_low", "_high", "score")


def hybrid_search(
    text_scored: DataFrame, vector_scored: DataFrame, key: str, item: str, k: int = fv.VECTOR_LIMIT
) -> DataFrame:
    """Half text, half meaning; every item shows once, by its best chunk.

    Scaling needs the hits twice, so the narrow hit tables are checkpointed
    once instead of scoring the corpus a second time.
    """
    from .aggregate import first_per_key

    a = _scaled(checkpointed(text_scored.select("qid", key, item, "score")), "text_score")
    b = _scaled(checkpointed(vector_scored.select("qid", key, item, "score")), "vector_score")
    both = a.join(b, ["qid", key, item], "full_outer")
    half = F.coalesce("text_score", F.lit(0.0)) * 0.5 + F.coalesce("vector_score", F.lit(0.0)) * 0.5
    scored = both.select("qid", key, item, F.round(half, 6).alias("score"))
    best = first_per_key(scored, ["qid", item], [-F.col("score"), F.col(key)])
    return top_k(best, "qid", "score", item, k)


# --- quantization -------------------------------------------------------------


def quantize(vectors: DataFrame, vector: str) -> DataFrame:
    """int8 components on one global scale: ``codes`` and ``scale`` (value = code * scale)."""
    largest = vectors.agg(F.max(F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double")))))).scalar()
    with_max = vectors.withColumn("_max", largest)
    # floor(x + 0.5) sends halves up on both sides of zero.
    codes = F.transform(vector, lambda x: F.floor(x.cast("double") / F.col("_max") * 127 + 0.5).cast("tinyint"))
    return with_max.withColumns({"codes": codes, "scale": F.col("_max") / 127}).drop("_max")


def dequantize(codes: Column, scale: Column) -> Column:
    return F.transform(codes, lambda c: (c * scale).cast("float"))
