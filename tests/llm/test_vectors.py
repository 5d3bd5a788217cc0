"""Vantage-point trees and MaxScore against brute force."""

import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.llm import ann, common, maxscore
from lexloom.llm.common import from_blob, to_blob


def frame(spark, rows, extra=""):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>" + extra)


def brute(ids, matrix, queries, k, score):
    """The k best (id, score) per query row, ties to the smaller id."""
    out = {}
    for q in queries:
        found = [(-score(matrix[q], matrix[i]), int(ids[i])) for i in range(len(ids)) if ids[i] != ids[q]]
        out[int(ids[q])] = [(i, -s) for s, i in sorted(found)[:k]]
    return out


def cosine(a, b):
    return float(a @ b / np.sqrt((a @ a) * (b @ b)))


def inner(a, b):
    return int(np.floor(64 * a) @ np.floor(64 * b))


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    matrix = rng.normal(size=(1200, 24)).astype(np.float32).astype(np.float64)
    matrix[100:140] = matrix[7]  # a group of equal rows
    return np.arange(1200) * 3, matrix


@pytest.mark.parametrize("shard", [90, 400, 5000])
def test_factor_one_is_exact(vectors, shard):
    ids, matrix = vectors
    queries = np.arange(0, 1200, 50)
    merged = {}
    for start in range(0, len(ids), shard):
        blob = ann.build_tree(ids[start : start + shard], matrix[start : start + shard])
        for q, v, s in zip(*ann.search_tree(blob, ids[queries], matrix[queries], 5, 1.0)):
            merged.setdefault(int(q), []).append((-round(float(s), 12), int(v)))
    wanted = brute(ids, matrix, queries, 5, cosine)
    for q, best in wanted.items():
        assert [v for _, v in sorted(merged[q])[:5]] == [v for v, _ in best]


def test_registered_factor_reaches_recall(vectors):
    ids, matrix = vectors
    queries = np.arange(0, 1200, 10)
    blob = ann.build_tree(ids, matrix)
    found = {}
    for q, v, s in zip(*ann.search_tree(blob, ids[queries], matrix[queries], 5, ann.FACTOR)):
        found.setdefault(int(q), []).append((-s, int(v)))
    wanted = brute(ids, matrix, queries, 5, cosine)
    hits = [len({v for _, v in sorted(found[q])[:5]} & {v for v, _ in best}) / 5 for q, best in wanted.items()]
    assert np.mean(hits) >= 0.9


def test_larger_factor_visits_no_more(vectors):
    ids, matrix = vectors
    blob = ann.build_tree(ids, matrix)
    seen = [len(ann.search_tree(blob, ids[:40], matrix[:40], 5, f)[0]) for f in (1.0, 50.0)]
    assert seen[1] <= seen[0]


def test_neighbours_in_spark(spark, vectors):
    ids, matrix = vectors
    df = frame(spark, [(int(i), m.tolist()) for i, m in zip(ids, matrix)])
    rows = ann.nearest_neighbours(df, df.where("vec_id % 50 = 0"), k=5, factor=1.0, shard_rows=300, block_rows=7).collect()
    wanted = brute(ids, matrix, np.flatnonzero(ids % 50 == 0), 5, cosine)
    assert len(rows) == 5 * len(wanted)
    for r in rows:
        assert r["score"] == pytest.approx(wanted[r["query_id"]][r["rank"] - 1][1], abs=1e-12)


@pytest.mark.parametrize("shard", [64, 1200])
def test_maxscore_is_exact(vectors, shard):
    ids, matrix = vectors
    queries = np.arange(0, 1200, 20)
    merged = {}
    for start in range(0, len(ids), shard):
        blob = to_blob(ids[start : start + shard], maxscore.quantized(matrix[start : start + shard]))
        for q, v, s in zip(*maxscore.search_shard(blob, ids[queries], matrix[queries], 20)):
            merged.setdefault(int(q), []).append((-int(s), int(v)))
    for q, best in brute(ids, matrix, queries, 20, inner).items():
        assert [(v, -s) for s, v in sorted(merged[q])[:20]] == best


def test_maxscore_beyond_doubles_and_longs():
    ids = np.arange(3)
    matrix = np.array([[2.0**40, 1.0], [2.0**40, -1.0], [1e308, 1e308]])
    blob = to_blob(ids, maxscore.quantized(matrix))
    found = {(int(q), int(v)): int(s) for q, v, s in zip(*maxscore.search_shard(blob, ids, matrix, 5))}
    assert found[0, 1] == 2**63 - 1 and found[0, 2] == 2**63 - 1 and (0, 0) not in found


def test_odd_vectors_take_no_part(spark):
    rows = [
        (0, [1.0, 0.0]),
        (1, [1.0, 0.1]),
        (2, None),
        (3, [None, 1.0]),
        (4, [float("nan"), 1.0]),
        (5, [float("inf"), 1.0]),
        (6, []),
        (7, [0.0, 0.0]),
        (None, [1.0, 1.0]),
        (8, [1.0, 2.0, 3.0]),
        (9, [1.0, 0.1]),
    ]
    df = frame(spark, [(*r, 1, "x") for r in rows], ", score int, rank string")
    near = ann.nearest_neighbours(df, df, k=5).orderBy("query_id", "rank").collect()
    assert {r["query_id"] for r in near} == {0, 1, 9}
    assert [r["vec_id"] for r in near if r["query_id"] == 0] == [1, 9]  # a tie goes to the smaller id
    top = maxscore.top_inner_products(df, df, k=20).collect()
    assert {r["query_id"] for r in top} == {0, 1, 7, 9}
    assert {r["vec_id"] for r in top} == {0, 1, 7, 9}


def test_empty_table(spark):
    df = frame(spark, [])
    assert ann.nearest_neighbours(df, df).count() == 0
    assert maxscore.top_inner_products(df, df).count() == 0


def test_equal_rows_everywhere(spark):
    df = spark.range(500).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0)).cast("array<float>").alias("embedding"))
    near = ann.nearest_neighbours(df, df.where("vec_id % 50 = 0"), shard_rows=100).collect()
    for r in near:
        assert r["vec_id"] == [v for v in range(7) if v != r["query_id"]][r["rank"] - 1]


@pytest.mark.parametrize("repeats", [2, 25])
def test_rows_of_the_own_id_raise_no_floor(repeats):
    """Rows that share the query's id and score highest leave the k best others in place."""
    rng = np.random.default_rng(6)
    matrix = rng.normal(size=(200, 8)) / 8
    matrix[:repeats] = 4 + rng.random((repeats, 8))
    ids = np.array([7] * repeats + list(range(100, 300 - repeats)))
    blob = to_blob(ids, maxscore.quantized(matrix))
    query = np.full((1, 8), 1.0)
    scores = (maxscore.quantized(matrix) @ maxscore.quantized(query).T)[:, 0]
    others = sorted((-int(s), int(i)) for i, s in zip(ids, scores) if i != 7)[:20]
    found = zip(*maxscore.search_shard(blob, np.array([7]), query, 20)[1:])
    assert sorted((-int(s), int(v)) for v, s in found) == others


SMALL_HEAP = """
from pyspark.sql import functions as F

from lexloom.llm import ann
from lexloom.session import local_session

spark = local_session(2, **{"spark.driver.memory": "512m"})
vector = F.array(*[F.sin((F.col("id") + 1) * i) for i in range(1, 65)]).cast("array<float>")
vectors = spark.range(12000).select(F.col("id").alias("vec_id"), vector.alias("embedding"))
print("rows", ann.nearest_neighbours(vectors, vectors.where("vec_id < 500"), shard_rows=4).count())
"""


def test_many_shards_in_a_small_heap():
    """one block of queries for each of 3,000 shards is 768 MB, more than the heap; no task may hold them at once."""
    env = os.environ | {"PYTHONPATH": os.pathsep.join(sys.path)}
    run = subprocess.run([sys.executable, "-c", SMALL_HEAP], env=env, capture_output=True, text=True, timeout=600)
    assert "rows 2500" in run.stdout, run.stderr[-2000:]


def test_one_shard_and_many_blocks_of_queries(spark, vectors):
    """Fewer shards than cores: blocks are dealt to lanes, and each query is answered once."""
    ids, matrix = vectors
    df = frame(spark, [(int(i), m.tolist()) for i, m in zip(ids, matrix)])
    rows = ann.nearest_neighbours(df, df, k=2, factor=1.0, shard_rows=5000, block_rows=100).collect()
    wanted = brute(ids, matrix, np.arange(0, 1200, 40), 2, cosine)
    found = {(r["query_id"], r["rank"]): r["score"] for r in rows}
    assert len(rows) == len(found) == 2400
    for q, best in wanted.items():
        assert [found[q, 1], found[q, 2]] == pytest.approx([s for _, s in best], abs=1e-12)


def test_merged_in_steps(monkeypatch):
    rng = np.random.default_rng(8)
    parts = [tuple(rng.integers(0, 9, 40) for _ in range(3)) for _ in range(12)]
    parts.append((np.arange(9), np.arange(9), np.full(9, np.iinfo(np.int64).min)))  # the lowest long comes last
    monkeypatch.setattr(common, "MERGED_ROWS", 50)
    rows = sorted(zip(*(np.concatenate(x).tolist() for x in zip(*parts))), key=lambda r: (r[0], -r[2], r[1]))
    wanted = [r for q in range(9) for r in [x for x in rows if x[0] == q][:4]]
    assert list(zip(*(x.tolist() for x in common.merged(iter(parts), 4)))) == wanted


def test_blobs_keep_every_double():
    floats = np.array([[0.5, -0.0], [np.inf, 2.0**-149]])
    doubles = np.array([0.1, 1e308, 5e-324])
    ids = np.arange(3)
    assert len(to_blob(floats)) < len(to_blob(floats + 0.1))
    for a, b in zip((ids, floats, doubles), from_blob(to_blob(ids, floats, doubles)), strict=True):
        assert a.dtype == b.dtype and a.tobytes() == b.tobytes()
