"""Sinks: JSON and parquet tables, checked syncs, size budgets, text reports."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.quality import Rule, require_clean, schema_errors


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def content_hash(df: DataFrame) -> DataFrame:
    """One row (n, digest) that depends on the rows but not on order or partitioning: the sum of 60 bits of MD5 per row."""
    row = F.md5(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).cast("binary"))
    bits = F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(bits), F.lit(0)).cast("decimal(38,0)").alias("digest"))


def file_system(spark: SparkSession, path: str):
    """The file system of a path and a way to name places in it."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path
    return place(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def swap_in(spark: SparkSession, staging: str, path: str) -> None:
    """Put a written folder in the place of another, which stays as it was until the new one has its name."""
    files, place = file_system(spark, path)
    old = place(f"{path.rstrip('/')}.old-{uuid.uuid4().hex}")
    had = files.exists(place(path))
    if had and not files.rename(place(path), old):
        raise OSError(f"cannot set aside {path}")
    if not files.rename(place(staging), place(path)):
        if had:
            files.rename(old, place(path))
        raise OSError(f"cannot move {staging} to {path}")
    if had:
        files.delete(old, True)


def remove(spark: SparkSession, path: str) -> None:
    files, place = file_system(spark, path)
    files.delete(place(path), True)


def sync(
    df: DataFrame, path: str, key: str, rules: Sequence[Rule], partition: str | None = None, references: DataFrame | None = None
) -> None:
    """Rewrite a target from scratch once every row passes: schema, unique key, known parent.

    The rows are computed once: while they are written to a folder beside the target, the broken rules are counted. Keys
    and parents are checked on what was written. Only then does the folder take the target's place; a failure names all
    kinds of problems and leaves the target as it was, and a rerun leaves the same content. ``df`` may read the target.
    """
    spark = df.sparkSession
    staging = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
    broken = F.lit(0)
    for rule in rules:
        broken = broken + F.when(F.coalesce(rule.holds, F.lit(False)), 0).otherwise(1)
    seen = Observation()
    checked = df.observe(seen, F.sum(broken.cast("long")).alias("broken"))
    writer = checked.write.partitionBy(partition) if partition is not None else checked.write
    try:
        writer.parquet(staging)
        staged = spark.read.schema(df.schema).parquet(staging)
        twice = staged.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        problems = twice.select(F.col(key).cast("string").alias("key"), F.lit(key).alias("field"), F.lit("duplicate entry").alias("message"))
        if partition is not None and references is not None:
            lost = staged.join(references.select(F.col(references.columns[0]).alias(partition)), partition, "left_anti")
            unknown = F.concat(F.lit("references unknown part "), F.col(partition).cast("string"))
            problems = problems.unionByName(
                lost.select(F.col(key).cast("string").alias("key"), F.lit(partition).alias("field"), unknown.alias("message"))
            )
        if seen.get["broken"]:
            found = schema_errors(staged, [key], rules).select(F.col(key).cast("string").alias("key"), "field", "message")
            problems = problems.unionByName(found)
        require_clean(problems, "sync")
        swap_in(spark, staging, path)
    except BaseException:
        remove(spark, staging)
        raise


def require_budget(df: DataFrame, text: str, budget: int) -> None:
    """Fail when the stored bytes of a column exceed a budget."""
    used = df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("b")).first()["b"]
    if used > budget:
        raise ValueError(f"artifact exceeds its budget: {used} of {budget} bytes")


def write_report(lines: DataFrame, path: str) -> None:
    """Report lines in order of (section, detail) as text files, however many there are."""
    ordered = lines.repartitionByRange("section", "line").sortWithinPartitions("section", "line")
    ordered.select("line").write.mode("overwrite").text(path)
