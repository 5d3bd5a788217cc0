"""Exact top-k inner products by MaxScore over quantized vectors.

A term is a dimension; its posting list for a query holds the rows whose component has the sign of the query's, so
entries add and all other rows add nothing or less. A term's bound is the largest product an entry can reach. Ordered by
bound, the terms with the smallest bounds whose sum stays below the k-th best score so far are non-essential: a row
found in none but those lists cannot enter the result. Essential lists are traversed, and what they leave competitive is
probed term by term, largest bound first, until its bound falls below the k-th best.

Vectors are dense, so a block of rows is traversed for a block of queries as one product in which each query's
non-essential terms are masked.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from .common import Best, from_blob, k_best, searched, to_blob, usable_vectors

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCALE = 64
SHARD_ROWS = 3072
BLOCK_ROWS = 512
#: Rows traversed between two updates of the k-th best score.
STEP_ROWS = 1024
#: Terms probed between two tests of the bounds.
PROBE_TERMS = 4
#: Non-essential bounds sum to less than this share of the k-th best score. Any share up to 1 is exact; a smaller one
#: leaves fewer rows to probe, which suits dense vectors, where every row is on some essential list.
LIGHT_SHARE = 0.25
LONG = np.iinfo(np.int64)


def quantized(matrix: np.ndarray) -> np.ndarray:
    """floor(64 x) of doubles, as doubles (exact for any double)."""
    with np.errstate(over="ignore"):
        return np.floor(SCALE * matrix)


def _exact(queries: np.ndarray, rows: np.ndarray) -> bool:
    """Whether every sum of products is exact in doubles."""
    if not len(queries) or not len(rows):
        return True
    return float(np.abs(queries).max()) * float(np.abs(rows).max()) * queries.shape[1] < 2.0**53


def _whole(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Scores of all pairs as Python integers, held within a long's range."""
    limit = np.finfo(np.float64).max
    big = lambda m: np.array([[int(x) for x in np.clip(r, -limit, limit)] for r in m], dtype=object)
    scores = big(queries) @ big(rows).T
    return np.array([[min(max(int(x), LONG.min), LONG.max) for x in r] for r in scores], np.int64).reshape(
        len(queries), len(rows)
    )


def search_shard(
    blob: bytes, query_ids: np.ndarray, vectors: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of one shard for a block of queries: query ids, row ids, scores as longs."""
    ids, rows = from_blob(blob)
    queries = quantized(vectors)
    if not _exact(queries, rows):
        scores = _whole(queries, rows)
        who, at = np.nonzero(ids[None, :] != query_ids[:, None])
        kept = k_best(who, ids[at], scores[who, at], k)
        return query_ids[who[kept]], ids[at[kept]], scores[who[kept], at[kept]]
    n, dim = queries.shape
    high, low = np.maximum(rows.max(axis=0), 0), np.minimum(rows.min(axis=0), 0)
    bounds = np.maximum(queries * high, queries * low)
    by_bound = np.argsort(bounds, axis=1, kind="stable")
    sums = np.cumsum(np.take_along_axis(bounds, by_bound, 1), axis=1)
    rank = np.argsort(by_bound, axis=1, kind="stable")  # place of each term in the order of bounds
    best = Best(n, k)
    for start in range(0, len(rows), STEP_ROWS):
        block, block_ids = rows[start : start + STEP_ROWS], ids[start : start + STEP_ROWS]
        floor = best.floor()
        # the smallest bounds that together stay below a share of the floor
        light = (sums < LIGHT_SHARE * floor[:, None]).sum(axis=1)
        rest = np.where(light > 0, sums[np.arange(n), np.maximum(light - 1, 0)], 0.0)
        partial = (queries * (rank >= light[:, None])) @ block.T
        need = floor - rest
        # rows with the query's id are no candidates and raise no floor
        partial[block_ids[None, :] == query_ids[:, None]] = -np.inf
        if len(block) >= k:
            # where nothing is light, the block's own k-th best is a floor, too
            own_floor = np.partition(partial[light == 0], -k, axis=1)[:, -k]
            need[light == 0] = np.maximum(need[light == 0], own_floor)
        who, at = np.divmod(np.flatnonzero(partial >= need[:, None]), len(block))
        other = block_ids[at] != query_ids[who]
        who, at = who[other], at[other]
        score, left = partial[who, at], light[who]
        while len(who) and left.any():
            for _ in range(PROBE_TERMS):
                term = by_bound[who, np.maximum(left - 1, 0)]
                score += np.where(left > 0, queries[who, term] * block[at, term], 0.0)
                left = np.maximum(left - 1, 0)
            reach = score + np.where(left > 0, sums[who, np.maximum(left - 1, 0)], 0.0)
            alive = reach >= floor[who]
            who, at, score, left = who[alive], at[alive], score[alive], left[alive]
        if len(who):
            best.add(who, block_ids[at], score)
    owner, found, scores = best.pairs()
    return query_ids[owner], found, scores.astype(np.int64)


def top_inner_products(
    vectors: DataFrame, queries: DataFrame, k: int = 20, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` the k rows of ``vectors`` of highest integer score.

    Both hold (vec_id, embedding); components count as floor(64 x) with x as double, and the score is their inner
    product, exact. Rows with the query's own id are left out; equal scores rank by smaller vec_id; with fewer
    candidates than k all are returned. Vectors that are null, empty, or hold null or non-finite components take no
    part, nor do rows without an id; vectors of another length than the query's are no candidates. Scores beyond a
    long's range are held at its ends. Rows that share a vec_id are candidates each. Other columns are ignored; empty
    tables give no rows.
    """

    def index(ids: np.ndarray, matrix: np.ndarray) -> bytes:
        return to_blob(ids, quantized(matrix))

    def search(blob: bytes, query_ids: np.ndarray, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return search_shard(blob, query_ids, matrix, k)

    return searched(
        usable_vectors(vectors, False), usable_vectors(queries, False), index, search, k, shard_rows, block_rows, "long"
    )
