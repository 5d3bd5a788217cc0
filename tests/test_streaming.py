import datetime as dt

import pytest
from pyspark.sql import functions as F

from lexloom.operators.changes import page_states
from lexloom.streaming import detector, ingest

SCHEMA = "url string, ts timestamp, body string"


def _write(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(path)


def _day(n):
    return dt.datetime(2026, 1, n)


def _run(stream, target, checkpoint):
    q = stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
    q.trigger(availableNow=True).start().awaitTermination()


def test_ingest_resumes_with_new_files_only(spark, folder):
    source, target, check = f"{folder}/in", f"{folder}/out", f"{folder}/check"
    _write(spark, source, [("a", _day(1), "x")])
    ingest.ingest(ingest.file_stream(spark, source, SCHEMA), target, check).awaitTermination()
    _write(spark, source, [("b", _day(2), "y")])
    ingest.ingest(ingest.file_stream(spark, source, SCHEMA), target, check).awaitTermination()
    assert sorted(r.url for r in spark.read.parquet(target).collect()) == ["a", "b"]


def _detect(spark, folder):
    source = ingest.file_stream(spark, f"{folder}/in", SCHEMA)
    detector.detect(source, f"{folder}/out", f"{folder}/state", f"{folder}/check").awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def test_stream_states_equal_batch_states(spark, folder):
    first = [("a", _day(1), "one"), ("b", _day(1), "two"), ("c", _day(1), "three")]
    second = [("a", _day(2), "one"), ("b", _day(2), "TWO"), ("c", _day(2), None), ("d", _day(2), "four")]
    for rows in (first, second):
        _write(spark, f"{folder}/in", rows)
        seen = _detect(spark, folder)
    streamed = {(r.url, r.state, r.hash) for r in seen.filter(F.col("ts") == _day(2)).collect()}
    previous = spark.createDataFrame(first, SCHEMA).select("url", F.sha2("body", 256).alias("hash"))
    batch = {tuple(r) for r in page_states(spark.createDataFrame(second, SCHEMA), previous).collect()}
    assert streamed == batch
    assert {s for _, s, _ in batch} == {"same", "changed", "unreachable", "new"}


def test_stream_ignores_snapshots_older_than_the_state(spark, folder):
    for rows in ([("a", _day(5), "new text")], [("a", _day(3), "old text")], [("a", _day(6), "new text")]):
        _write(spark, f"{folder}/in", rows)
        seen = _detect(spark, folder)
    rows = [(r.ts.day, r.state) for r in seen.orderBy("ts").collect()]
    assert rows == [(5, "new"), (6, "same")]


def test_one_url_with_many_snapshots_in_one_batch(spark, folder):
    start = dt.datetime(2026, 1, 1)
    rows = [("hot", start + dt.timedelta(minutes=i), f"v{i // 2}") for i in range(3000)]
    _write(spark, f"{folder}/in", rows)
    got = {r["state"]: r["count"] for r in _detect(spark, folder).groupBy("state").count().collect()}
    assert got == {"new": 1, "changed": 1499, "same": 1500}


def test_repeated_snapshots_are_dropped(spark, folder):
    source, target, check = f"{folder}/in", f"{folder}/out", f"{folder}/check"
    _write(spark, source, [("a", _day(1), "x"), ("a", _day(1), "x"), ("a", _day(2), "y")])
    _run(ingest.distinct_snapshots(ingest.file_stream(spark, source, SCHEMA), "ts"), target, check)
    assert spark.read.parquet(target).count() == 2


# --- keyed state --------------------------------------------------------------


def snapshots_of(seed):
    """Snapshots of a few urls over days; one url has most, some come twice, some are unreachable."""
    import random

    rng = random.Random(seed)
    rows = []
    for _ in range(120):
        url = rng.choice(["hot", "hot", "hot", "b", "c"])
        at = dt.datetime(2031, 1, 1) + dt.timedelta(hours=rng.randint(0, 240))
        body = rng.choice([None, "one", "two", '<a href="x.pdf">x</a>', '<a href="x.pdf">x</a><a href="y.pdf">y</a>'])
        rows += [(url, at, body)] * rng.choice([1, 1, 1, 2])
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_watch_in_any_order_equals_batch(spark, folder, seed):
    import random

    from lexloom.streaming import detector, watch

    rows = snapshots_of(seed)
    schema = "url string, ts timestamp, body string"
    shuffled = random.Random(seed + 9).sample(rows, len(rows))
    end = [("~end", dt.datetime(2031, 3, 1), "later")]
    parts = [shuffled[:80], shuffled[80:], end]

    def run():
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
        query = watch.watch(stream, f"{folder}/out", f"{folder}/state", delay="20 days")
        query.awaitTermination()
        assert query.exception() is None

    for part in parts:  # every part is a run of its own, so state comes back from the checkpoint
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        run()
    found = spark.read.parquet(f"{folder}/out")
    none = spark.createDataFrame([], "url string, hash string, ts timestamp")
    wanted = detector.judge(spark.createDataFrame(rows, schema), none)
    key = lambda r: (r.url, r.ts, r.state, str(r.hash))
    assert sorted(map(key, found.collect())) == sorted(map(key, wanted.collect()))
    for url in ("hot", "b", "c"):
        links = [x for r in found.where(F.col("url") == url).orderBy("ts", "hash").collect() for x in r.new_links]
        assert len(links) == len(set(links)) and set(links) <= {"x.pdf", "y.pdf"}


def test_a_url_not_heard_of_is_forgotten(spark, folder):

    from lexloom.streaming import watch

    schema = "url string, ts timestamp, body string"
    days = [("a", 1, "x"), ("~", 40, "x"), ("~", 80, "x"), ("a", 90, "x"), ("~", 200, "x")]
    for n, (url, day, body) in enumerate(days):
        spark.createDataFrame([(url, dt.datetime(2031, 1, 1) + dt.timedelta(days=day), body)], schema).write.parquet(f"{folder}/in/{n}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{folder}/in")
        watch.watch(stream, f"{folder}/out", f"{folder}/state", delay="1 day", forget_days=30).awaitTermination()
    got = spark.read.parquet(f"{folder}/out").where("url = 'a'").orderBy("ts").collect()
    assert [r.state for r in got] == ["new", "new"]
