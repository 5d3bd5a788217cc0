"""What is already done, and what changed at the source."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..session import checkpointed
from .sinks import file_system, remove, swap_in


def pending(source: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Source rows without output yet."""
    return source.join(done.select(key), key, "left_anti")


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, modified) of source files; their content is never read."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


_FILE = {"path": "file_path", "size": "file_size", "modified": "file_modification_time"}
#: What a rebuilt row's file is called in the target.
SOURCE = "source_file"


def rebuild(source: DataFrame, target: str, manifest: str, build: Callable[[DataFrame], DataFrame]) -> list[str]:
    """Rewrite the parts of ``target`` whose files are new or changed, drop those whose files are gone; the stale files.

    ``source`` reads files; the scan itself says which file a row is from, how large and how old. ``build`` maps rows of
    any files, with their file in the column SOURCE, which it keeps; the target has a partition per file. The manifest is
    written last, so that an interrupted rebuild is done again. Only file names reach the driver, which lists them anyway.
    """
    spark = source.sparkSession
    name = F.element_at(F.split("_metadata.file_path", "/"), -1)
    if not source.select("_metadata.file_path").isEmpty():
        current = source.select(*(F.col(f"_metadata.{c}").alias(n) for n, c in _FILE.items())).distinct()
    else:
        current = spark.createDataFrame([], "path string, size bigint, modified timestamp")
    current = checkpointed(current)
    files, place = file_system(spark, target)
    known = spark.read.parquet(manifest) if files.exists(place(manifest)) else current.limit(0)
    stale = [r["path"] for r in stale_sources(current, known).select("path").collect()]
    gone = [r["path"] for r in known.join(current, "path", "left_anti").select("path").collect()]
    if stale:
        rows = source.where(F.col("_metadata.file_path").isin(stale)).withColumn(SOURCE, name)
        writer = build(rows).write.partitionBy(SOURCE).mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.parquet(target)
    for path in gone:
        remove(spark, f"{target}/{SOURCE}={path.rsplit('/', 1)[-1]}")
    staging = f"{manifest.rstrip('/')}.staging-{uuid.uuid4().hex}"
    current.write.parquet(staging)
    swap_in(spark, staging, manifest)
    return sorted(stale)


def stale_sources(current: DataFrame, recorded: DataFrame) -> DataFrame:
    """Files that are new or whose size or time moved since the manifest was written."""
    old = recorded.select("path", F.col("size").alias("_size"), F.col("modified").alias("_modified"))
    joined = current.join(old, "path", "left")
    same = F.col("size").eqNullSafe(F.col("_size")) & F.col("modified").eqNullSafe(F.col("_modified"))
    return joined.filter(~same).drop("_size", "_modified")


def dated_rows(lines: DataFrame, line: str, position: str, link: str) -> DataFrame:
    """(n, year) from table markup: row key and first date, references removed, last row per key."""
    row = rf"^\|\s*\[\[[\w-]+ {link}\|(\d{{1,3}})(?:st|nd|rd|th)\]\]"
    plain: Column = F.regexp_replace(F.regexp_replace(line, r"<ref[^>]*>[\s\S]*?</ref>", ""), r"<ref[^>]*/>", "")
    date = rf"(\d{{1,2}})\s+({fv.MONTHS})\s+(\d{{4}})"
    keyed = lines.filter(F.col(line).rlike(row)).select(
        F.regexp_extract(line, row, 1).cast("int").alias("n"),
        F.nullif(F.regexp_extract(plain, date, 3), F.lit("")).cast("int").alias("year"),
        position,
    )
    return keyed.filter("year IS NOT NULL").groupBy("n").agg(F.max_by("year", position).alias("year"))
