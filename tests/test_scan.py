"""Blocked scans equal plain windows, for any number of blocks and with a hot key."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.operators import scan


@pytest.fixture(scope="module")
def rows(spark):
    random.seed(5)
    data, pos = [], 0
    for _ in range(600):
        pos += random.choice([1, 1, 1, 7, 40])
        # A third of the rows and more share one key.
        data.append((random.choice(["hot", "hot", "a", "b"]), pos, random.choice([None, random.randint(0, 99)])))
    return spark.createDataFrame(data, "k string, pos int, v int").cache()


def by_key():
    return W.partitionBy("k").orderBy("pos")


def same(a, b):
    assert a.columns == b.columns
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


@pytest.mark.parametrize("blocks", [1, 7, 64, None])
def test_number_rows(rows, blocks):
    got = scan.number_rows(rows, ["k"], "pos", "n", "total", blocks=blocks)
    want = rows.withColumns({"n": F.row_number().over(by_key()), "total": F.count(F.lit(1)).over(W.partitionBy("k"))})
    same(got.select("k", "pos", "n", "total"), want.select("k", "pos", "n", "total"))


@pytest.mark.parametrize("blocks", [1, 7, 64])
def test_neighbours(rows, blocks):
    got = scan.neighbours(rows, ["k"], "pos", ["pos", "v"], blocks=blocks)
    want = rows
    for c in ("pos", "v"):
        want = want.withColumns({f"prev_{c}": F.lag(c).over(by_key()), f"next_{c}": F.lead(c).over(by_key())})
    same(got.select(*want.columns), want)


@pytest.mark.parametrize("blocks", [1, 7, 64])
def test_running_values(rows, blocks):
    v = F.col("v")
    got = scan.running(
        rows,
        ["k"],
        "pos",
        {"top": ("max_before", v), "sum": ("sum", v), "last": ("last", v), "earlier": ("last_before", v), "xor": ("xor", v)},
        blocks=blocks,
    )
    before, upto = by_key().rowsBetween(W.unboundedPreceding, -1), by_key().rowsBetween(W.unboundedPreceding, 0)
    want = rows.withColumns(
        {
            "top": F.max("v").over(before),
            "sum": F.coalesce(F.sum("v").over(upto), F.lit(0)),
            "last": F.last("v", ignorenulls=True).over(upto),
            "earlier": F.last("v", ignorenulls=True).over(before),
            "xor": F.coalesce(F.bit_xor("v").over(upto), F.lit(0)),
        }
    )
    same(got.select(*want.columns), want)


def test_global_order_needs_no_key(rows):
    got = scan.number_rows(rows, [], "pos", "n", blocks=12).select("pos", "n")
    assert [r.n for r in got.orderBy("pos").collect()] == list(range(1, 601))


@pytest.mark.parametrize("kind", ["long", "string"])
def test_ids_may_be_hashed_or_text(spark, kind):
    """A third of the rows share a key; ids are hashes, negative ones among them."""
    ids = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"),
        F.xxhash64("id").cast(kind).alias("pos"),
    )
    got = scan.placed(ids, ["k"], "pos", "n", "total", ["pos"], blocks=9)
    whole = W.partitionBy("k")
    want = ids.withColumns(
        {
            "n": F.row_number().over(by_key()),
            "total": F.count(F.lit(1)).over(whole),
            "prev_pos": F.lag("pos").over(by_key()),
            "next_pos": F.lead("pos").over(by_key()),
        }
    )
    same(got.select(*want.columns), want)


def test_a_hot_key_is_spread_over_blocks(rows):
    """The hot key lies in several ranges, and no window on rows runs over the bare key."""
    ranged = scan._ranged(rows, ["k"], ["pos"], 10)
    sizes = [r["count"] for r in ranged.groupBy("_block").count().collect()]
    assert len(sizes) >= 8 and max(sizes) < 200
    plan = scan.number_rows(rows, ["k"], "pos", blocks=10)._jdf.queryExecution().optimizedPlan().toString()
    ranks = [line for line in plan.splitlines() if "row_number()" in line and "Window" in line]
    assert ranks and all("_block" in line for line in ranks)
