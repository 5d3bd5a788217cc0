"""JSON of unknown shape, walked in the order it is read."""

from __future__ import annotations

import json as parser
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_INDEX = re.compile(r"0|[1-9]\d{0,9}")
_LAST_INDEX = (1 << 32) - 2


class _Object(dict):
    """An object of the text; a list of the text is a list."""


def _object(entries: list[tuple[str, object]]) -> _Object:
    """Fields as a reader keeps them: a repeated key stays at its first place with its last value, index keys come first."""
    found = dict(entries)
    index = [k for k in found if _INDEX.fullmatch(k) and int(k) <= _LAST_INDEX]
    if not index:
        return _Object(found)
    index.sort(key=int)
    return _Object({k: found[k] for k in [*index, *(k for k in found if k not in set(index))]})


def texts_in(text: str, id_field: str, text_field: str, id_pattern: re.Pattern) -> dict[str, str]:
    """Id to text of every object that holds both as strings, in reading order; what is read last wins."""
    found: dict[str, str] = {}
    waiting = [parser.loads(text, object_pairs_hook=_object)]
    while waiting:
        node = waiting.pop()
        if isinstance(node, _Object):
            key, value = node.get(id_field), node.get(text_field)
            if isinstance(key, str) and isinstance(value, str) and value and id_pattern.fullmatch(key.strip()):
                found[key.strip()] = value
            node = list(node.values())
        if isinstance(node, list):
            waiting += [v for v in reversed(node) if isinstance(v, (list, _Object))]
    return found


def keyed_texts(df: DataFrame, key: str, json: str, id_field: str, text_field: str, id_pattern: str) -> DataFrame:
    """(key, id, text) wherever an object holds both fields as strings; per key the last one read wins.

    One pass over the rows, each read once, at any shape and order of fields. Objects come before what they hold, fields
    in the order they are written; a key repeated in an object counts once, with its last value. Ids are trimmed and
    must match the whole pattern, empty texts do not count. A null row gives nothing; malformed text fails. ``key`` is
    one row's: rows that share it are merged by the caller.
    """
    wanted = re.compile(id_pattern)
    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("id", T.StringType()), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, ids, texts = [], [], []
            for place, text in enumerate(batch.column(json).to_pylist()):
                for name, value in (texts_in(text, id_field, text_field, wanted) if text is not None else {}).items():
                    owner.append(place)
                    ids.append(name)
                    texts.append(value)
            keys = batch.column(key).take(pa.array(owner, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(ids, pa.string()), pa.array(texts, pa.string())], names=[key, "id", "text"])

    return df.select(key, json).mapInArrow(run, schema)
