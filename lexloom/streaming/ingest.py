"""Resumable ingest: only source files without output are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def file_stream(
    spark: SparkSession, path: str, schema: str | T.StructType, fmt: str = "json", files_per_batch: int = 1000
) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(path)


def ingest(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append what is new and stop; the checkpoint remembers the files read."""
    return (
        stream.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def distinct_snapshots(stream: DataFrame, moment: str, late_after: str = "1 day") -> DataFrame:
    """Repeated snapshots of a page, the same content at whatever time, dropped; state behind the watermark is let go."""
    hashed = stream.withColumn("hash", F.sha2("body", 256))
    return hashed.withWatermark(moment, late_after).dropDuplicatesWithinWatermark(["url", "hash"])
