"""WARC archives: a writer on Spark's text sink and a Python data source that reads headers before payloads.

A record is header lines, a blank line, a block and two line ends. The sink writes one record per row with those line
ends as separator, so archives go to any store Spark can write, with its commit protocol.

The source plans one partition per file. It parses the header of a record first, applies the predicates on header
columns that Spark pushed down, and seeks past the block of a record that is not wanted; the block is read and its HTTP
head split off only if the schema asks for ``payload``.
"""

from __future__ import annotations

import io
import re
import sys
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    StringContains,
    StringEndsWith,
    StringStartsWith,
)

from ..session import checkpointed

cloudpickle.register_pickle_by_value(sys.modules[__name__])

VERSION = "WARC/1.1"
END = "\r\n"
#: Equal payloads shorter than this are all stored.
REVISIT_BYTES = 100
#: Groups of equal payloads up to this many go to every task; more are joined by a shuffle.
BROADCAST_GROUPS = 50_000
#: Payload bytes in one Arrow batch; a longer payload is a batch of its own.
BATCH_BYTES = 4 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = (
    "record_id string, record_type string, target_uri string, refers_to string, date string, content_type string, "
    "payload_digest string, payload_length long, content_length long, headers map<string,string>, payload binary"
)
#: Columns read from one header field each.
FIELDS = {
    "record_id": "warc-record-id",
    "record_type": "warc-type",
    "target_uri": "warc-target-uri",
    "refers_to": "warc-refers-to",
    "date": "warc-date",
    "content_type": "content-type",
    "payload_digest": "warc-payload-digest",
}


# Writing ---------------------------------------------------------------------------------------------------------------


def _field(name: str, value: Column) -> Column:
    """A header line; none for null. Line ends inside a value are percent-encoded."""
    safe = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit(END)), F.lit(""))


def with_revisits(records: DataFrame, least_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Add payload_bytes, payload_digest, record_type, refers_to to (page_id, url, payload string).

    Among equal payloads of at least ``least_bytes`` the smallest page_id is the response and the others revisit it.
    Rows repeated under that id are responses each; a null id revisits if any row of its group has an id.
    """
    raw = F.col("payload").cast("binary")
    sized = records.select(
        "page_id", "url", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2(raw, 256).alias("payload_digest")
    )
    groups = checkpointed(
        sized.where(F.col("payload_bytes") >= least_bytes)
        .groupBy(F.col("payload_digest").alias("shared"))
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("members"))
        .where("members > 1")
        .select("shared", "first_id")
    )
    few = groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    side = F.broadcast(groups) if few else groups
    joined = sized.join(side, F.col("payload_digest") == F.col("shared"), "left")
    revisits = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select(
        *sized.columns,
        F.when(revisits, "revisit").otherwise("response").alias("record_type"),
        F.when(revisits, F.col("first_id")).alias("refers_to"),
    )


def record_text(date: str) -> Column:
    """A WARC record from the columns of ``with_revisits``; a revisit holds the HTTP head only."""
    revisit = F.col("record_type") == "revisit"
    head = F.concat(
        F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "),
        F.col("payload_bytes").cast("string"),
        F.lit(END + END),
    )
    block = F.concat(head, F.when(revisit, "").otherwise(F.col("payload")))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    return F.concat(
        F.lit(VERSION + END),
        _field("WARC-Type", F.col("record_type")),
        _field("WARC-Record-ID", name("page_id")),
        _field("WARC-Date", F.lit(date)),
        _field("WARC-Target-URI", F.col("url")),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        _field("WARC-Payload-Length", F.col("payload_bytes").cast("string")),
        F.when(revisit, F.concat(_field("WARC-Refers-To", name("refers_to")), _field("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        _field("Content-Type", F.lit("application/http; msgtype=response")),
        _field("Content-Length", F.octet_length(block).cast("string")),
        F.lit(END),
        block,
    )


def write_archives(pages: DataFrame, folder: str, date: str = "2000-01-01T00:00:00Z") -> None:
    """Write one record per row of ``pages`` (page_id, url, html) below ``folder``, replacing what is there.

    A null html is an empty payload, a null url leaves its field out, a null page_id leaves an empty name. Repeated
    rows are records each. Other columns are not stored; an empty table writes archives without records.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    with_revisits(rows).select(record_text(date).alias("value")).write.mode("overwrite").option(
        "lineSep", END + END
    ).text(folder)


# Reading ---------------------------------------------------------------------------------------------------------------


def parse_header(source: io.BufferedReader) -> dict[str, str] | None:
    """Header fields of the next record, names in lower case; None at the end. A field may go on in indented lines."""
    line = source.readline()
    while line and not line.strip():
        line = source.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"not the start of a WARC record: {line[:60]!r}")
    fields: dict[str, str] = {}
    last = None
    while (line := source.readline()) and line.strip():
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[0] in " \t" and last:
            fields[last] += " " + text.strip()
            continue
        name, _, value = text.partition(":")
        last = name.strip().lower()
        fields[last] = value.strip()
    return fields


def body_of(block: bytes, content_type: str | None) -> bytes:
    """The payload of a block: what follows the HTTP head if it has one."""
    if (content_type or "").replace(" ", "").lower().startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


class HeaderTest:
    """A pushed predicate on a header column; a missing field is null, which no comparison accepts."""

    def __init__(self, column: str, test: Filter):
        self.column, self.test = column, test

    def __call__(self, values: dict) -> bool:
        value, test = values[self.column], self.test
        if isinstance(test, IsNull):
            return value is None
        if isinstance(test, EqualNullSafe):
            return value == test.value
        if value is None:
            return False
        if isinstance(test, EqualTo):
            return value == test.value
        if isinstance(test, In):
            return value in test.value
        if isinstance(test, StringStartsWith):
            return value.startswith(test.value)
        if isinstance(test, StringEndsWith):
            return value.endswith(test.value)
        if isinstance(test, StringContains):
            return test.value in value
        return True  # IsNotNull


PUSHED = (EqualTo, EqualNullSafe, In, IsNull, IsNotNull, StringStartsWith, StringEndsWith, StringContains)


class WarcReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType):
        self.path, self.schema, self.tests = path, schema, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for test in filters:
            at = getattr(test, "attribute", ())
            if isinstance(test, PUSHED) and len(at) == 1 and at[0] in FIELDS:
                self.tests.append(HeaderTest(at[0], test))
            else:
                yield test

    def partitions(self) -> list[InputPartition]:
        store, base = fs.FileSystem.from_uri(self.path)
        found = store.get_file_info(fs.FileSelector(base, recursive=True))
        hidden = re.compile(r"(^|/)[._][^/]*(/|$)")
        names = sorted(f.path for f in found if f.is_file and f.size and not hidden.search(f.path[len(base) :]))
        # Spark reads a source without partitions as one of its own; a folder without archives is one empty partition
        return [InputPartition(name) for name in names or [""]]

    def rows(self, name: str) -> Iterator[tuple[dict, int]]:
        """Wanted records of a file as column values, with the payload bytes read; no name is no file."""
        if not name:
            return
        store, _ = fs.FileSystem.from_uri(self.path)
        wanted = set(self.schema.fieldNames())
        with io.BufferedReader(store.open_input_file(name), 1 << 20) as source:
            while (fields := parse_header(source)) is not None:
                length = int(fields.get("content-length", 0))
                values = {column: fields.get(field) for column, field in FIELDS.items()}
                if not all(test(values) for test in self.tests):
                    source.seek(length, io.SEEK_CUR)
                    continue
                size = fields.get("warc-payload-length")
                values |= {"payload_length": int(size) if size else None, "content_length": length, "headers": fields}
                if "payload" in wanted:
                    values["payload"] = body_of(source.read(length), values["content_type"])
                else:
                    source.seek(length, io.SEEK_CUR)
                yield values, len(values.get("payload") or b"")

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
        names = self.schema.fieldNames()
        types = [kinds.get(f.dataType.simpleString(), pa.map_(pa.string(), pa.string())) for f in self.schema.fields]

        def batch(rows: list[dict]) -> pa.RecordBatch:
            lists = [[list(r[n].items()) if n == "headers" else r[n] for r in rows] for n in names]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(lists, types)], names=names)

        held: list[dict] = []
        size = 0
        for values, payload in self.rows(partition.value):
            held.append(values)
            size += payload + 512
            if size >= BATCH_BYTES:
                yield batch(held)
                held, size = [], 0
        if held:
            yield batch(held)


class WarcSource(DataSource):
    """``spark.read.format("warc").schema(some of SCHEMA).load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return WarcReader(self.options["path"], schema)


def read_archives(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Records of the archives below ``folder`` with the named columns of SCHEMA (all if none are named).

    Turns on filter pushdown into Python sources for the session, which Spark has off by default.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    known = T.StructType.fromDDL(SCHEMA)
    schema = T.StructType([known[c] for c in columns]) if columns else known
    return spark.read.format("warc").schema(schema).load(folder)


def round_trip(pages: DataFrame, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of ``pages`` written to ``folder`` and read back.

    Size and digest of a response come from its payload as read; a revisit stores none, so they come from its header.
    The two reads differ in what they open: revisits are read by header alone.
    """
    spark = pages.sparkSession
    write_archives(pages, folder)
    kind = pages.schema["page_id"].dataType
    page = lambda c: F.regexp_extract(c, "^<urn:page:(.*)>$", 1).try_cast(kind)
    full = read_archives(spark, folder, "record_id", "record_type", "payload").where("record_type = 'response'")
    responses = full.select(
        page("record_id").alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"),
        "record_type",
        F.lit(None).cast(kind).alias("refers_to"),
    )
    heads = read_archives(spark, folder, "record_id", "record_type", "refers_to", "payload_digest", "payload_length")
    revisits = heads.where("record_type = 'revisit'").select(
        page("record_id").alias("page_id"),
        F.col("payload_length").alias("payload_bytes"),
        F.regexp_replace("payload_digest", "^sha256:", "").alias("payload_digest"),
        "record_type",
        page("refers_to").alias("refers_to"),
    )
    return responses.unionByName(revisits)
