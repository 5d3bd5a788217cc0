"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

A text becomes a vector of shape terms: trigrams of character classes, where a run of letters of one case is one
character, and binned shares of repeated words, of distinct words, of capitals and of marks. Terms are weighted by rarity
and projected on the leading directions of the labelled sample. Every document is compared with every labelled vector by
exact cosines, in blocks, and its nearest neighbours vote with their similarity.
"""

from __future__ import annotations

import operator
import sys
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, over_texts, sent, texts_of, with_columns

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FOLDS, HELD_OUT = 3, 1
#: Labelled rows that become neighbours, at most.
SAMPLE_ROWS = 4096
#: Trigram terms, latent dimensions, neighbours that vote, and the power their similarity counts with.
TRIGRAMS = 1024
DIMENSIONS = 48
NEIGHBOURS = 15
SHARPNESS = 8.0
#: Documents compared at once.
BLOCK_ROWS = 512
#: A vote of this weight for the sample's mean, so that documents without near neighbours score like it.
PRIOR_WEIGHT = 0.05
BINS = 16
SHARES = 5

# Character classes of bytes: 0 lower case and letters beyond ASCII, 1 upper case, 2 digit, 3 blank, 4 line end, 5 other
# control, 6 on: each ASCII mark its own.
CLASSES = np.zeros(256, np.uint8)
CLASSES[:32] = 5
CLASSES[127] = 5
CLASSES[[9, 11, 12, 32]] = 3
CLASSES[[10, 13]] = 4
CLASSES[65:91] = 1
CLASSES[48:58] = 2
_marks = [b for b in range(33, 127) if not chr(b).isalnum()]
CLASSES[_marks] = 6 + np.arange(len(_marks))
KINDS = 6 + len(_marks)


def terms(text: str) -> np.ndarray:
    """Term weights of a text: TRIGRAMS shape trigrams, then SHARES groups of BINS."""
    out = np.zeros(TRIGRAMS + SHARES * BINS, np.float32)
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if not len(data):
        return out
    kinds = CLASSES[data]
    # a run of letters of one case, digits or blanks is one
    keep = np.ones(len(kinds), bool)
    keep[1:] = (kinds[1:] != kinds[:-1]) | (kinds[1:] > 3)
    runs = kinds[keep].astype(np.int64)
    if len(runs) >= 3:
        codes = (runs[:-2] * KINDS + runs[1:-1]) * KINDS + runs[2:]
        counts = np.bincount((codes * 2654435761 % 4294967291) % TRIGRAMS, minlength=TRIGRAMS)
        out[:TRIGRAMS] = np.sqrt(counts / len(codes))
    words = text.split()
    if words:
        n = len(words)
        again = sum(map(operator.eq, words, words[1:])) / n
        # distinct words against what a text of that length shows
        variety = len(set(words)) / n * min(1.0, n / 50) ** 0.25
        marks = float((kinds > 5).mean())
        shares = (again, variety, float((kinds == 1).mean()), marks, float((kinds == 2).mean()))
        for group, share in enumerate(shares):
            place = min(share, 1.0) ** 0.5 * (BINS - 1)
            low = int(place)
            base = TRIGRAMS + group * BINS
            out[base + low] = 0.35 * (1 - (place - low))
            if low + 1 < BINS:
                out[base + low + 1] = 0.35 * (place - low)
    return out


def _rows(texts: list[str]) -> np.ndarray:
    return np.stack([terms(t) for t in texts]) if texts else np.zeros((0, TRIGRAMS + SHARES * BINS), np.float32)


@dataclass
class Model:
    """Rarity of terms, latent directions, labelled vectors of length one (or zero), their labels and the labels' mean."""

    rarity: np.ndarray
    directions: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    mean: float

    def project(self, rows: np.ndarray) -> np.ndarray:
        latent = (rows * self.rarity) @ self.directions
        size = np.linalg.norm(latent, axis=1, keepdims=True)
        return latent / np.where(size > 0, size, 1)

    def scores(self, texts: list[str]) -> np.ndarray:
        """Share of label 1 among the neighbours of each text, weighted by similarity."""
        if not len(self.labels):
            return np.full(len(texts), self.mean)
        parts = []
        for start in range(0, len(texts), BLOCK_ROWS):
            cosines = self.project(_rows(texts[start : start + BLOCK_ROWS])) @ self.vectors.T
            k = min(NEIGHBOURS, len(self.labels))
            near = np.argpartition(cosines, -k, axis=1)[:, -k:]
            weight = np.maximum(np.take_along_axis(cosines, near, 1), 0).astype(np.float64) ** SHARPNESS
            votes = (weight * self.labels[near]).sum(axis=1) + PRIOR_WEIGHT * self.mean
            parts.append(votes / (weight.sum(axis=1) + PRIOR_WEIGHT))
        return np.concatenate(parts) if parts else np.zeros(0)


def train(documents: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> Model:
    """Labelled vectors of at most ``most`` rows outside the held-out fold.

    Term weights of the sample, a fixed number of small floats per row, come to the driver. Equal texts count once.
    Without labels every text scores 0.5.
    """
    rows = labelled_sample(documents, labels, "quality", FOLDS, HELD_OUT, most)

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            vectors = [terms(t).tobytes() for t in texts_of(batch)]
            return with_columns(batch, ["y"], x=pa.array(vectors, pa.binary()))

        return work

    found = over_texts(rows, "text", make, "y int, x binary").groupBy("x").agg(F.max("y").alias("y"))
    sample = found.orderBy(F.xxhash64("x")).limit(most).collect()
    if not sample:
        width = TRIGRAMS + SHARES * BINS
        return Model(np.ones(width, np.float32), np.zeros((width, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), 0.5)
    matrix = np.stack([np.frombuffer(r["x"], np.float32) for r in sample])
    y = np.array([float(r["y"]) for r in sample])
    seen = (matrix > 0).sum(axis=0)
    rarity = np.log1p(len(matrix) / (1.0 + seen)).astype(np.float32)
    weighted = matrix * rarity
    _, directions = np.linalg.eigh(weighted.T.astype(np.float64) @ weighted)
    kept = np.ascontiguousarray(directions[:, ::-1][:, :DIMENSIONS].astype(np.float32))
    model = Model(rarity, kept, np.zeros((0, DIMENSIONS), np.float32), y, float(y.mean()))
    model.vectors = model.project(matrix)
    return model


def score(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted) per row of ``documents`` (doc_id, text); whole texts, null as empty.

    A text without terms, the empty one included, has the sample's mean label as score. Repeated rows each come back;
    doc_id may be null; other columns are ignored. The model, a bounded sample, is sent to every task.
    """
    at_task = sent(documents.sparkSession, model)

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        here = at_task()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = here.scores(texts_of(batch))
            return with_columns(
                batch, ["doc_id"], score=pa.array(found), predicted=pa.array((found >= 0.5).astype(np.int32))
            )

        return work

    kind = documents.schema["doc_id"].dataType.simpleString()
    return over_texts(documents.select("doc_id", "text"), "text", make, f"doc_id {kind}, score double, predicted int")


def without_poor(documents: DataFrame, model: Model) -> DataFrame:
    """``documents`` without the rows predicted to be of quality 0; all columns come through, whatever their names."""
    at_task = sent(documents.sparkSession, model)

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        here = at_task()
        return lambda batch: batch.filter(pa.array(here.scores(texts_of(batch)) >= 0.5, pa.bool_()))

    return over_texts(documents, "text", make, documents.schema)
