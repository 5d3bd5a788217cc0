"""Page change detection with state carried per url.

Each micro-batch is judged by plain joins and a blocked scan, so a url with a
third of all snapshots is spread over tasks instead of filling one. State is a
log of the urls each batch touched: a batch reads the entries before its own
and overwrites its own, which makes a repeated batch harmless. Every so many
batches the log is summed up to one row per url, and older entries are no
longer read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.scan import running

STATE = "url string, hash string, ts timestamp, epoch bigint"
#: Batches between two sums of the log.
SUMMED_EVERY = 16


def judge(snapshots: DataFrame, state: DataFrame) -> DataFrame:
    """(url, ts, state, hash) of snapshots (url, ts, body) against state (url, hash, ts).

    First sight is ``new``; a null body is ``unreachable`` and keeps the hash;
    a snapshot older than the stored time is ignored.
    """
    hashed = snapshots.select("url", "ts", F.sha2("body", 256).alias("hash"))
    known = state.select("url", F.col("hash").alias("_old"), F.col("ts").alias("_old_ts"))
    timely = hashed.join(known, "url", "left").filter(F.col("_old_ts").isNull() | (F.col("ts") >= F.col("_old_ts")))
    placed = timely.withColumns({"_at": F.unix_micros("ts"), "_tie": F.coalesce("hash", F.lit("~"))})
    scanned = running(placed, ["url"], "_at", {"_before": ("last_before", F.col("hash"))}, ties=["_tie"])
    previous = F.coalesce("_before", "_old")
    verdict = (
        F.when(F.col("hash").isNull(), "unreachable")
        .when(previous.isNull(), "new")
        .when(previous == F.col("hash"), "same")
        .otherwise("changed")
    )
    return scanned.select("url", "ts", verdict.alias("state"), F.coalesce("hash", previous).alias("hash"))


def latest_state(log: DataFrame) -> DataFrame:
    newest = F.max_by(F.struct("hash", "ts"), F.struct("ts", "epoch"))
    return log.groupBy("url").agg(newest.alias("_s")).select("url", "_s.*")


def _log(spark: SparkSession, path: str, before: int, every: int) -> DataFrame:
    """State entries of earlier batches: the latest sum and the folder of each batch since."""
    last = before // every * every
    folders = [f"{path}/upto={last}" if last else f"{path}/epoch=-1", *[f"{path}/epoch={e}" for e in range(last, before)]]
    return spark.read.schema(STATE).parquet(*folders)


def _sum_up(spark: SparkSession, path: str, before: int, every: int) -> None:
    """The state before a batch as one row per url, from the sum before and what came since."""
    base = f"{path}/upto={before - every}" if before > every else f"{path}/epoch=-1"
    folders = [base, *[f"{path}/epoch={e}" for e in range(before - every, before)]]
    summed = latest_state(spark.read.schema(STATE).parquet(*folders)).withColumn("epoch", F.lit(before - 1).cast("bigint"))
    summed.write.mode("overwrite").parquet(f"{path}/upto={before}")


def detect(stream: DataFrame, target: str, state: str, checkpoint: str, every: int = SUMMED_EVERY) -> StreamingQuery:
    """Judge what is new in a stream of (url, ts, body) and stop.

    ``target`` receives (url, ts, state, hash) and ``state`` the log, both as one
    folder per batch; ``every`` batches the log is summed up.
    """

    def process(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        # The first batch founds the log, so that later ones always find a folder.
        if epoch == 0:
            spark.createDataFrame([], STATE).write.mode("overwrite").parquet(f"{state}/epoch=-1")
        elif epoch % every == 0:
            _sum_up(spark, state, epoch, every)
        judged_at = f"{target}/epoch={epoch}"
        judge(batch, latest_state(_log(spark, state, epoch, every))).write.mode("overwrite").parquet(judged_at)
        # Entries come from what was written: the batch is judged once.
        seen = spark.read.parquet(judged_at).filter(F.col("state") != "unreachable")
        newest = seen.groupBy("url").agg(F.max_by(F.struct("hash", "ts"), F.struct("ts", "hash")).alias("_s"))
        entries = newest.select("url", "_s.hash", "_s.ts", F.lit(epoch).cast("bigint").alias("epoch"))
        entries.write.mode("overwrite").parquet(f"{state}/epoch={epoch}")

    writer = stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
