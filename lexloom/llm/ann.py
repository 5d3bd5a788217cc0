"""Approximate nearest neighbours: one vantage-point tree per shard, pruned by a relaxed triangle inequality.

Distances are chords between unit vectors, a metric that orders like the cosine. A node keeps a vantage point and the
ranges of distance to it that its near and far halves span. For a query at distance d whose k-th best so far is at t, a
half can only hold something nearer if d lies within t of its range. The factor f relaxes this: the half is visited only
if d lies within t / f of the range. f = 1 is exact; larger factors visit less and may miss.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from .common import Best, from_blob, searched, to_blob, usable_vectors

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEAF_ROWS = 128
SHARD_ROWS = 2048
BLOCK_ROWS = 512
#: Pruning factor of the registered query; its recall is measured in the tests.
FACTOR = 3.0
#: Distances differ by rounding; a bound is passed by this much before it prunes.
SLACK = 1e-7
#: Rows kept beyond k, so that rounding of distances cannot decide among equal cosines.
SPARE = 8


def unit(matrix: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by the largest component first, so that no square overflows or vanishes."""
    scaled = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


def chord(cosines: np.ndarray) -> np.ndarray:
    """Distances between unit vectors of given cosines."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cosines))


def build_tree(ids: np.ndarray, matrix: np.ndarray) -> bytes:
    """A vantage-point tree over the rows of one shard.

    Rows are ordered so that every node owns a slice. A node is (start, stop, near child, far child, near low, near
    high, far low, far high); its vantage point is the first row of its slice and of its near half. Halves are cut by
    rank, so that any number of equal rows splits evenly.
    """
    units = unit(matrix)
    order = np.arange(len(ids))
    nodes: list[list[float]] = []
    waiting = [(0, len(ids), -1, 0)]
    while waiting:
        start, stop, parent, side = waiting.pop()
        me = len(nodes)
        nodes.append([start, stop, -1, -1, 0, 0, 0, 0])
        if parent >= 0:
            nodes[parent][2 + side] = me
        if stop - start <= LEAF_ROWS:
            continue
        rows = order[start:stop]
        # the row farthest from the slice's first lies at its edge, where a vantage point tells rows apart best
        point = rows[np.argmin(units[rows] @ units[rows[0]])]
        away = chord(units[rows] @ units[point])
        ranked = np.argsort(np.where(rows == point, -1.0, away), kind="stable")
        order[start:stop], away = rows[ranked], away[ranked]
        half = len(away) // 2
        nodes[me][4:] = [away[:half].min(), away[:half].max(), away[half], away[-1]]
        waiting += [(start, start + half, me, 0), (start + half, stop, me, 1)]
    return to_blob(ids[order], matrix[order], np.array(nodes, np.float64))


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each pair of rows, each pair summed alike: equal rows get equal scores."""
    dot = np.einsum("ij,ij->i", a, b)
    size = np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b))
    with np.errstate(all="ignore"):
        plain = dot / size
    odd = ~np.isfinite(plain) | (size < 1e-150)
    if odd.any():
        plain[odd] = np.einsum("ij,ij->i", unit(a[odd]), unit(b[odd]))
    return plain


def search_tree(
    blob: bytes, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Up to k nearest rows of one tree for a block of queries: query ids, row ids, cosines."""
    ids, matrix, table = from_blob(blob)
    units, asked = unit(matrix), unit(queries)
    best = Best(len(queries), k + SPARE)  # of row numbers, by cosine

    def visit(node: int, who: np.ndarray) -> None:
        start, stop, left, right = (int(x) for x in table[node, :4])
        if left < 0:
            cosines = asked[who] @ units[start:stop].T
            cosines[ids[None, start:stop] == query_ids[who, None]] = -np.inf
            need = best.floor()[who]
            if stop - start > best.k:
                own = np.partition(cosines, -best.k, axis=1)[:, -best.k]
                need = np.maximum(need, own)
            owner, at = np.divmod(np.flatnonzero(cosines >= need[:, None]), stop - start)
            real = cosines[owner, at] > -np.inf
            owner, at = owner[real], at[real]
            if len(owner):
                best.add(who[owner], at + start, cosines[owner, at])
            return
        away = chord(asked[who] @ units[start])
        bounds = table[node, 4:]
        closer = away < (bounds[1] + bounds[2]) / 2
        for first in (True, False):  # each query's nearer half, then its other half
            for child, low, high, mine in ((left, *bounds[:2], closer), (right, *bounds[2:], ~closer)):
                reach = chord(np.maximum(best.scores[who, k - 1], -1.0)) / factor
                apart = np.maximum(np.maximum(low - away, away - high), 0.0)
                chosen = (mine == first) & ((apart <= reach + SLACK) | (best.scores[who, k - 1] == -np.inf))
                if chosen.any():
                    visit(child, who[chosen])

    visit(0, np.arange(len(queries)))
    owner, found, _ = best.pairs()
    return query_ids[owner], ids[found], _cosines(queries[owner], matrix[found])


def nearest_neighbours(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    factor: float = FACTOR,
    shard_rows: int = SHARD_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` the k nearest of ``vectors`` by cosine, in doubles.

    Both hold (vec_id, embedding). Rows with the query's own id are left out; equal scores rank by smaller vec_id. With
    fewer candidates than k all are returned. ``factor`` 1 is exact; larger ones prune more. Vectors that are null,
    empty, zero, or hold null or non-finite components take no part, nor do rows without an id; vectors of another
    length than the query's are no candidates. Rows that share a vec_id are candidates each. Other columns are ignored;
    empty tables give no rows.
    """

    def search(blob: bytes, query_ids: np.ndarray, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return search_tree(blob, query_ids, matrix, k, factor)

    return searched(
        usable_vectors(vectors, True), usable_vectors(queries, True), build_tree, search, k, shard_rows, block_rows, "double"
    )
