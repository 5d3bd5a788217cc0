"""Text to unit vectors through a pluggable model.

The default needs no model files: signed token hashes summed into ``dims``
buckets. A real model is a function from a list of texts to a 2-d array; it is
loaded once per worker by ``load`` and fed Arrow batches.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import search_tokens
from ..session import small_batches

# Workers need not have this package installed: its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DIMS = 384
#: Texts whose token rows are laid out at once.
TEXTS_AT_ONCE = 256
Model = Callable[[list[str]], np.ndarray]


def _unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return (rows / np.where(norms == 0, 1, norms)).astype(np.float32)


def hashed_embedding(text: Column, dims: int = DIMS) -> Column:
    """Deterministic vector; tokens are hashed on the JVM, only numbers reach Python, in batches of bounded size."""
    small_batches(SparkSession.active())
    hashes = F.transform(search_tokens(text), lambda w: F.xxhash64(w))

    @F.pandas_udf("array<float>")
    def bucketed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            vectors = []
            for low in range(0, len(batch), TEXTS_AT_ONCE):
                part = batch[low : low + TEXTS_AT_ONCE]
                sizes = [0 if values is None else len(values) for values in part]
                flat = [np.asarray(values, np.int64) for values, n in zip(part, sizes) if n]
                h = np.concatenate([*flat, np.zeros(0, np.int64)])
                # One count over all rows of the part: a row's buckets follow those of the row before.
                place = np.repeat(np.arange(len(part)), sizes) * dims + (h >> 1) % dims
                sums = np.bincount(place, weights=np.where(h & 1, 1.0, -1.0), minlength=len(part) * dims)
                vectors += list(_unit(sums.reshape(-1, dims)))
            yield pd.Series(vectors, dtype=object)

    return bucketed(hashes)


def embed(df: DataFrame, key: str, text: str, load: Callable[[], Model]) -> DataFrame:
    """(key, vector) by a model loaded once per worker task."""
    key_type = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            vectors = _unit(np.asarray(model(batch[text].tolist()), dtype=np.float64))
            yield pd.DataFrame({key: batch[key], "vector": list(vectors)})

    return df.select(key, text).mapInPandas(run, f"{key} {key_type}, vector array<float>")


def mean_pooled(df: DataFrame, key: str, tokens: str, table: DataFrame, token: str, vector: str) -> DataFrame:
    """(key, vector): the mean of the rows of a token table, scaled to length one; null where no token has a row.

    ``tokens`` is an array of token ids; a token counts as often as it occurs. The table (token, vector), a model's and
    so of bounded size, is sent to every task once. In a batch the counts of tokens per text are one sparse matrix, and
    its product with the table gives all sums at once.
    """
    rows = table.select(token, F.col(vector).cast("array<double>").alias("v")).where("v is not null").orderBy(token).collect()
    ids = np.array([r[0] for r in rows], np.int64)
    matrix = np.array([r[1] for r in rows], np.float64).reshape(len(rows), -1)
    told = df.sparkSession.sparkContext.broadcast((ids, matrix))
    schema = f"{key} {df.schema[key].dataType.simpleString()}, vector array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = told.value
        for batch in batches:
            lists = batch.column(tokens)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()) * lists.is_valid().to_numpy(zero_copy_only=False))
            asked = lists.flatten().to_numpy(zero_copy_only=False)
            place = np.searchsorted(ids, asked)
            known = place < len(ids)
            known[known] = ids[place[known]] == asked[known]
            # counts of (text, row), then their products with the table's rows, summed per text
            pairs, count = np.unique(owner[known] * max(len(ids), 1) + place[known], return_counts=True)
            text, row = np.divmod(pairs, max(len(ids), 1))
            sums = np.zeros((batch.num_rows, matrix.shape[1]))
            starts = np.flatnonzero(np.diff(text, prepend=-1))
            for low in range(0, len(starts), TEXTS_AT_ONCE):
                part = starts[low : low + TEXTS_AT_ONCE]
                end = starts[low + TEXTS_AT_ONCE] if low + TEXTS_AT_ONCE < len(starts) else len(text)
                weighted = matrix[row[part[0] : end]] * count[part[0] : end, None]
                sums[text[part]] = np.add.reduceat(weighted, part - part[0], axis=0)
            norms = np.linalg.norm(sums, axis=1)
            found = [v / n if n else None for v, n in zip(sums, norms)]
            vectors = pa.array(found, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(key), vectors], names=[key, "vector"])

    return df.select(key, tokens).mapInArrow(run, schema)
