"""No line, number, citation or host form is lost to a bound of one edition."""

import os

import pytest
from pyspark.sql import functions as F

from lexloom.functions import numbers, urls
from lexloom.functions.text import normalize_space, visible_text, word_count, words
from lexloom.operators.order import monotone_contents
from lexloom.operators.quality import require_clean
from lexloom.plans.derive import statutes
from lexloom.plans.registry import Tables
from lexloom.session import shared_folder
from lexloom.sources.sinks import sync
from lexloom.streaming.detector import detect
from lexloom.streaming.ingest import distinct_snapshots, file_stream

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the given tables")
def test_derived_text_holds_every_line(spark):
    t = Tables(spark, FOLDER)
    pairs = t.documents.join(statutes(t).withColumnRenamed("text", "derived"), "doc_id").select("text", "derived").collect()
    assert pairs
    for text, derived in pairs:
        at = 0
        for line in text.split("\n"):
            found = derived.find(line, at)
            assert found >= 0
            at = found + len(line)


def test_contents_keep_suffixes_of_any_script(spark):
    text = "1. One 4\n2. Two 4\n2क. Between 5\n3. Three\n3. again\n21ख. far\n9. back\n700. beyond"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    pattern = "\\b([1-9]\\d{0,2}[क-ह]{0,2})\\."
    rows = monotone_contents(docs, pattern).orderBy("pos").collect()
    assert [(r["num"], r["suffix"]) for r in rows] == [(1, ""), (2, ""), (2, "क"), (3, ""), (21, "ख"), (700, "")]
    bounded = monotone_contents(docs, pattern, most=395).collect()
    assert max(r["num"] for r in bounded) == 21


def test_citations_above_an_edition(spark):
    text = "by the Constitution (Two hundred and fifth Amendment) Act, 2090"
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(numbers.citations(F.col("t"))).first()[0] == [205]
    assert df.select(numbers.citations(F.col("t"), most=200)).first()[0] == []


@pytest.mark.parametrize(
    "url, safe",
    [
        ("http://2887778049/", False),  # 172.31.255.1
        ("http://2887778304/", True),  # 172.32.0.0
        ("http://0xa9fe0001/", False),
        ("http://0xc0.0xa8.257/", False),
        ("http://0144.0100.1/", False),
        ("http://192.11010049/", False),  # 192.168.0.1
        ("http://192.11075585/", True),  # 192.169.0.1
        ("http://10.1/", False),
        ("http://9.1/", True),
        ("http://256.1.1.1/", None),
        ("http://1.2.3.256/", None),
        ("http://4294967296/", None),
        ("http://09/", None),
        ("http://0x/", False),
        ("http://names.10.example/", True),
        ("http://names.10/", None),
        ("http://[0:0::0:1]/", False),
        ("http://[0:0:0:0:0:ffff:a00:1]/", False),
        ("http://[::ffff:9.9.9.9]/", True),
        ("http://[febf:1::]/", False),
        ("http://[fec0:1::]/", True),
        ("http://[fdff::9]:8080/", False),
        ("http://[1:2:3]/", None),
        ("http://[1:2:3:4:5:6:7:8:9]/", None),
        ("http://[::g]/", None),
        ("http://10.9.9.9\\@safe.example/", False),
        ("https:/\\localhost/", False),
        ("http://safe.example\\@10.0.0.1/", True),
        ("http://u:p@b@10.0.0.1/", False),
        ("http://%6cocalhost/", False),
        ("ht\ntp://10.0.0.1/", False),
        ("http://sub.localhost:99/", False),
        ("http://10.0.0.1./", False),
    ],
)
def test_hosts_as_a_browser_reads_them(one, url, safe):
    reason = one(urls.refusal, [url])[0]
    if safe is None:
        assert reason == "not a valid URL"
    elif safe:
        assert reason is None
    else:
        assert reason.startswith("refused")


def test_first_errors_are_the_same_every_time(spark):
    errors = spark.range(1000).select(F.lit("e").alias("level"), F.lpad(F.col("id").cast("string"), 4, "0").alias("key"))
    with pytest.raises(ValueError) as told:
        require_clean(errors.repartition(7), "check", shown=3)
    assert [line[-4:] for line in str(told.value).split("\n")[1:]] == ["0000", "0001", "0002"]


def test_repeats_at_another_time_are_dropped(spark, folder):
    rows = [("a", "x", "2024-01-01 00:00:00"), ("a", "x", "2024-01-01 05:00:00"), ("a", "y", "2024-01-01 06:00:00")]
    df = spark.createDataFrame(rows, "url string, body string, at string").withColumn("at", F.to_timestamp("at"))
    df.write.json(f"{folder}/in")
    stream = distinct_snapshots(file_stream(spark, f"{folder}/in", "url string, body string, at timestamp"), "at")
    run = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/c")
    run.trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(r["body"] for r in spark.read.parquet(f"{folder}/out").collect()) == ["x", "y"]


def test_shared_folder_is_named_or_local(spark):
    assert shared_folder(spark) == shared_folder(spark)


def test_every_kind_of_blank_parts_words(one):
    text = "\ufeffone\u00a0two\u2003three\u3000 four\u202f"
    assert one(words, [text]) == [["one", "two", "three", "four"]]
    assert one(word_count, [text]) == [4]
    assert one(normalize_space, [text]) == ["one two three four"]
    assert one(visible_text, [f"<p>{text}</p>\u00a0"]) == ["one two three four"]


def test_a_table_may_be_synced_onto_itself(spark, folder):
    target = f"{folder}/parts"
    spark.createDataFrame([("1", "Union"), ("2", "Lands")], "number string, name string").write.parquet(target)
    renamed = spark.read.parquet(target).withColumn("name", F.upper("name"))
    sync(renamed, target, "number", [])
    assert {tuple(r) for r in spark.read.parquet(target).collect()} == {("1", "UNION"), ("2", "LANDS")}


def test_state_is_the_same_however_often_the_log_is_summed(spark, folder):
    found = {}
    for every in (1, 2, 50):
        for batch in range(5):
            rows = [("a", f"2024-01-0{batch + 1} 00:00:00", "x" if batch < 3 else "y"), (f"u{batch}", f"2024-01-0{batch + 1} 01:00:00", "z")]
            df = spark.createDataFrame(rows, "url string, at string, body string")
            df.select("url", F.to_timestamp("at").alias("ts"), "body").coalesce(1).write.mode("append").json(f"{folder}/in{every}")
            stream = spark.readStream.schema("url string, ts timestamp, body string").json(f"{folder}/in{every}")
            out, state, mark = (f"{folder}/{name}{every}" for name in ("out", "state", "mark"))
            detect(stream, out, state, mark, every).awaitTermination(120)
        got = spark.read.parquet(f"{folder}/out{every}").select("url", F.col("ts").cast("string"), "state")
        found[every] = {tuple(r) for r in got.collect()}
    assert found[1] == found[2] == found[50] and len(found[1]) == 10
    assert sorted(s for u, _, s in found[1] if u == "a") == ["changed", "new", "same", "same", "same"]
