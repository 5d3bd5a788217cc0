import pytest
from pyspark.sql import functions as F

from lexloom.operators.quality import part_rules, required_text
from lexloom.sources import json_walk, manifest, sinks, tables


def test_json_lines_round_trip_and_malformed_input(spark, folder):
    df = spark.createDataFrame([(1, "ocr", "layer"), (2, "अ\nब", None)], "page int, ocr string, layer string")
    sinks.write_json(df, f"{folder}/j")
    back = tables.json_lines(spark, f"{folder}/j", "page int, ocr string, layer string")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    spark.createDataFrame([("{broken",)], "value string").write.text(f"{folder}/bad")
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        tables.json_lines(spark, f"{folder}/bad", "page int").collect()


def test_nested_documents_and_whole_texts(spark, folder):
    import json
    from pathlib import Path

    Path(folder, "a.json").write_text(json.dumps({"parts": [{"number": "3"}], "articles": [{"number": "14"}]}, indent=1))
    Path(folder, "a.txt").write_text("one\ntwo\f\n")
    schema = "parts array<struct<number:string>>, articles array<struct<number:string>>"
    assert tables.json_documents(spark, folder, schema).select(F.inline("articles")).first().number == "14"
    assert tables.whole_texts(spark, f"{folder}/a.txt").first().text == "one\ntwo\f\n"


def test_page_subset_reaches_the_scan(spark, folder):
    spark.range(100).withColumnRenamed("id", "page").write.parquet(f"{folder}/p")
    subset = tables.page_subset(spark.read.parquet(f"{folder}/p"), "page", 63, 70)
    assert sorted(r.page for r in subset.collect()) == [63, 65, 67, 69]
    assert "GreaterThanOrEqual(page,63)" in subset._jdf.queryExecution().executedPlan().toString()


def test_markup_rows_last_date_wins(spark):
    lines = [
        "| [[First Amendment of the Code|1st]] || <ref name=x>3 May 1900</ref> 18 June 1951",
        "| [[First Amendment of the Code|1st]] || 19 June 1952",
        "| [[Second Amendment of the Code|2nd]] || <ref name=y/> no date",
        "| 3rd || 1 May 1953",
    ]
    df = spark.createDataFrame(list(enumerate(lines)), "pos int, line string")
    rows = manifest.dated_rows(df, "line", "pos", "Amendment of the Code").collect()
    assert [(r.n, r.year) for r in rows] == [(1, 1952)]


def test_json_of_unknown_shape(spark):
    text = '{"a":[{"ArtNo":"1","ArtDesc":"first","sub":{"x":[{"ArtNo":" 2A ","ArtDesc":"deep"}]}},{"ArtNo":"1","ArtDesc":"again"}],"ArtNo":5,"b":{"ArtNo":"xx","ArtDesc":"no"}}'
    df = spark.createDataFrame([(7, text)], "id int, j string").withColumnRenamed("id", "doc")
    rows = json_walk.keyed_texts(df, "doc", "j", "ArtNo", "ArtDesc", r"^\d{1,3}[A-Z]?$").collect()
    assert {(r.id, r.text) for r in rows} == {("1", "again"), ("2A", "deep")}


def test_json_is_walked_as_it_is_read(spark):
    """Repeated keys keep their first place and last value; index keys come first; text is not looked into."""
    texts = [
        '{"b":{"n":"1","t":"old"},"a":{"n":"1","t":"between"},"b":{"n":"1","t":"new"}}',
        '{"x":{"n":"1","t":"last"},"7":{"n":"1","t":"second"},"3":{"n":"1","t":"first"}}',
        '[{"n":"2","t":"{\\"n\\":\\"3\\",\\"t\\":\\"inside\\"}"},"{\\"n\\":\\"4\\",\\"t\\":\\"x\\"}"]',
        "[" * 200 + '{"n":"9","t":"deep"}' + "]" * 200,
        "null",
        '{"n":"5","t":""}',
        None,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, j string")
    rows = json_walk.keyed_texts(df, "k", "j", "n", "t", r"\d")
    assert sorted(map(tuple, rows.collect())) == [(0, "1", "between"), (1, "1", "last"), (2, "2", '{"n":"3","t":"inside"}'), (3, "9", "deep")]
    plan = json_walk.keyed_texts(df, "k", "j", "n", "t", r"\d")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    with pytest.raises(Exception, match="JSONDecodeError"):
        json_walk.keyed_texts(spark.createDataFrame([(1, "{broken")], "k int, j string"), "k", "j", "n", "t", r"\d").collect()


def test_stale_sources(spark, folder):
    from pathlib import Path

    for name in ("a.txt", "b.txt"):
        Path(folder, name).write_text("x")
    before = manifest.file_manifest(spark, folder).collect()
    recorded = spark.createDataFrame(before, manifest.file_manifest(spark, folder).schema)
    assert manifest.stale_sources(manifest.file_manifest(spark, folder), recorded).count() == 0
    Path(folder, "b.txt").write_text("longer")
    Path(folder, "c.txt").write_text("new")
    names = {r.path[-5:] for r in manifest.stale_sources(manifest.file_manifest(spark, folder), recorded).collect()}
    assert names == {"b.txt", "c.txt"}


def test_sync_is_checked_first_and_idempotent(spark, folder):
    target = f"{folder}/parts"
    good = spark.createDataFrame([("1", "Union"), ("4A", "Duties")], "number string, name string")
    sinks.sync(good, target, "number", part_rules())
    first = sinks.content_hash(spark.read.parquet(target)).first()
    sinks.sync(good.repartition(5), target, "number", part_rules())
    assert sinks.content_hash(spark.read.parquet(target)).first() == first
    bad = good.union(spark.createDataFrame([("1", ""), ("9Z", "x")], "number string, name string"))
    with pytest.raises(ValueError) as failure:
        sinks.sync(bad, target, "number", part_rules())
    for piece in ("duplicate entry", "1: name: must not be empty", "9Z: number"):
        assert piece in str(failure.value)
    assert sinks.content_hash(spark.read.parquet(target)).first() == first


def test_sync_computes_its_rows_once(spark, folder):
    """What is written is what was checked, also of rows that differ from run to run; nothing is left beside the target."""
    from pathlib import Path

    computed = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            computed.add(batch.num_rows)
            yield batch

    rows = spark.range(50).select(F.col("id").cast("string").alias("number"), F.lit("a name").alias("name"))
    for target in ("one", "two"):
        sinks.sync(rows.mapInArrow(count, rows.schema), f"{folder}/{target}", "number", [required_text("name")])
    assert computed.value == 100 and spark.read.parquet(f"{folder}/two").count() == 50
    with pytest.raises(ValueError, match="50 problem"):
        sinks.sync(rows.withColumn("name", F.lit("")), f"{folder}/one", "number", [required_text("name")])
    grown = spark.read.parquet(f"{folder}/one").union(spark.createDataFrame([("x", "y")], "number string, name string"))
    sinks.sync(grown, f"{folder}/one", "number", [required_text("name")])
    assert spark.read.parquet(f"{folder}/one").count() == 51
    assert sorted(p.name for p in Path(folder).iterdir()) == ["one", "two"]


def test_rebuild_rewrites_stale_parts_only(spark, folder):
    import os
    from pathlib import Path

    def source():
        return spark.read.text(f"{folder}/in/*.txt")

    def build(rows):
        return rows.select(manifest.SOURCE, F.length("value").alias("n"))

    def parts():
        return {p.parent.name.split("=")[1]: p.name for p in Path(folder, "out").glob("*/*.parquet")}

    os.mkdir(f"{folder}/in")
    for name in "abcde":
        Path(folder, "in", f"{name}.txt").write_text("one line\n")
    first = manifest.rebuild(source(), f"{folder}/out", f"{folder}/seen", build)
    before = parts()
    assert len(first) == len(before) == 5
    assert manifest.rebuild(source(), f"{folder}/out", f"{folder}/seen", build) == [] and parts() == before
    Path(folder, "in", "b.txt").write_text("one line\nand one more\n")
    Path(folder, "in", "f.txt").write_text("new\n")
    Path(folder, "in", "d.txt").unlink()
    stale = manifest.rebuild(source(), f"{folder}/out", f"{folder}/seen", build)
    assert [p[-5:] for p in stale] == ["b.txt", "f.txt"]
    after = parts()
    assert set(after) == {"a.txt", "b.txt", "c.txt", "e.txt", "f.txt"}
    assert all((after[n] == before[n]) == (n != "b.txt") for n in after if n != "f.txt")
    assert {tuple(r) for r in spark.read.parquet(f"{folder}/out").select("n", manifest.SOURCE).collect()} == {
        (8, "a.txt"), (8, "b.txt"), (12, "b.txt"), (8, "c.txt"), (8, "e.txt"), (3, "f.txt"),
    }


def test_sync_refuses_unknown_parents(spark, folder):
    items = spark.createDataFrame([("1", "3", "t"), ("2", "99", "t")], "number string, part string, title string")
    parts = spark.createDataFrame([("3",)], "number string")
    with pytest.raises(ValueError, match="2: part: references unknown part 99"):
        sinks.sync(items, f"{folder}/x", "number", [required_text("title")], "part", parts)


def test_content_hash_sees_changes_not_order(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "i int, t string")
    b = spark.createDataFrame([(2, None), (1, "x")], "i int, t string").repartition(3)
    c = spark.createDataFrame([(1, "x"), (2, "")], "i int, t string")
    assert sinks.content_hash(a).first() == sinks.content_hash(b).first() != sinks.content_hash(c).first()


def test_budget(spark):
    df = spark.createDataFrame([("अब",), ("x",)], "t string")
    sinks.require_budget(df, "t", 7)
    with pytest.raises(ValueError, match="7 of 6"):
        sinks.require_budget(df, "t", 6)


def test_report_is_written_in_order(spark, folder):
    lines = spark.createDataFrame([(99, "end"), (0, "# head"), (5, "- b"), (5, "- a")], "section int, line string")
    sinks.write_report(lines, f"{folder}/r")
    assert [r.value for r in spark.read.text(f"{folder}/r").coalesce(1).collect()] == ["# head", "- a", "- b", "end"]


def test_one_row_group_is_dealt_to_all_cores(spark, folder):
    """Splits that hold no row group are not tasks with rows."""
    from lexloom.sources.tables import spread

    spark.range(4000).selectExpr("id", "repeat(cast(id as string), 50) as text").coalesce(1).write.parquet(f"{folder}/one")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        read = spark.read.parquet(f"{folder}/one")
        assert read.rdd.getNumPartitions() >= 8
        held = spread(read).selectExpr("spark_partition_id() as p").groupBy("p").count().collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    assert len(held) >= 8 and max(r["count"] for r in held) < 2000
