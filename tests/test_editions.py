"""The candidate walk and the second edition against a walk row by row."""

import random

import pytest
from pyspark.sql import functions as F

from lexloom.functions import script
from lexloom.operators.second_edition import Anchor, assembled, edition_parts, walked_edition
from lexloom.operators.walk import START, exits, first_above, sort_text


def slow(rows):
    out, cursor, before = [], {}, {}
    for doc, at, keys in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        top = cursor.get(doc, START)
        taken = next((k for k in keys or [] if k is not None and k > top), None)
        out.append((doc, at, taken, top, before.get(doc)))
        if taken is not None:
            cursor[doc], before[doc] = taken, at
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def offers():
    """One document with most rows; offers of none to four keys, nulls among them."""
    rng = random.Random(3)
    rows = []
    for at in rng.sample(range(10000), 900):
        top = min(999, at // 12 + rng.randint(-20, 30))
        keys = [rng.choice([None, f"{max(top + rng.randint(-9, 9), 1):012d}" + rng.choice(["", "A", "AA"])]) for _ in range(rng.randint(0, 4))]
        rows.append((rng.choice([7, 7, 7, 8, 9]), at, keys or None))
    return rows


@pytest.mark.parametrize("blocks", [1, 6, 80])
def test_walk_in_blocks(spark, offers, blocks):
    df = spark.createDataFrame(offers, "d long, pos long, k array<string>")
    found = [tuple(r) for r in first_above(df, "d", "pos", "k", blocks).collect()]
    assert sorted(found, key=str) == slow(offers)


def test_a_block_is_a_function_of_its_entry():
    rng = random.Random(1)
    for _ in range(200):
        offered = [[f"{rng.randint(1, 30):012d}" for _ in range(rng.randint(0, 3))] for _ in range(rng.randint(0, 8))]
        keys, cursor, last = exits(offered, list(range(len(offered))))
        for entry in range(len(keys) + 1):
            for start in ([START] if entry == 0 else [keys[entry - 1], keys[entry - 1] + "A"]):
                top, place = start, -1
                for at, row in enumerate(offered):
                    taken = next((k for k in row if k > top), None)
                    if taken:
                        top, place = taken, at
                assert top == (start if cursor[entry] == entry else keys[cursor[entry] - 1])
                assert place == last[entry]


def test_order_of_numbers(one):
    got = one(sort_text, ["239A", "239AA", "239B", "240", "9", "x", "", None])
    assert sorted(g for g in got[:5]) == [got[i] for i in (4, 0, 1, 2, 3)] and got[5:] == [None] * 3


LINES = [
    "भारत का संविधान 7",
    "opening words, no item yet",
    "3. Name of the river--It flows",
    "down to the sea|क",
    "",
    "as before [5. Banks of it,--They hold",
    "1. अधिनियम of another year",
    "77",
    "412. Fused marker - twelve",  # 412 is not listed, its tail 12 is
    "4. Late number--behind the cursor",
    "99. Unlisted number--but in order",
    "2. Neither listed nor ahead--apparatus",
    "13यझ. Look-alike-",
    "the lost heading stands here",
    "more text",
    "13ञ. Given by the map--end",
]
LISTED = ["3", "4", "5", "12", "13ZH", "20", "30"]


def edition(spark, lines, **more):
    rows = [(1, i // 10, i, line) for i, line in enumerate(lines)]
    pages = spark.createDataFrame(rows, "doc_id long, page int, line_no int, line string")
    listed = spark.createDataFrame([(n,) for n in [*LISTED, "3", None]], "number string")
    return walked_edition(pages, listed, **more)


def test_items_and_review(spark):
    anchors = [Anchor("14", 1, "lost heading", "Lost and found"), Anchor("15", 0, "lost heading", "Wrong page"), Anchor("2", 1, "more", "Too late")]
    found = edition(spark, LINES, anchors=anchors, suffix_map={"13ञ": "30"})
    items = {r["number"]: r for r in found.items.collect()}
    assert {n: (r["number_hi"], r["title"], r["text"], r["page"]) for n, r in items.items()} == {
        "3": ("3", "Name of the river", "It flows down to the sea। क as before", 0),
        "5": ("5", "Banks of it", "They hold ", 0),
        "12": ("12", "Fused marker", "twelve ", 0),
        "13ZH": ("13यज", "Look-alike", "", 1),
        "14": ("14", "Lost and found", "the lost heading stands here more text ", 1),
        "30": ("13ञ", "Given by the map", "end", 1),
    }
    assert sorted((r["line_no"], r["latin"]) for r in found.review.collect()) == [(9, "4"), (10, "99")]


def test_no_lines_and_no_whitelist(spark):
    found = edition(spark, [])
    assert found.items.count() == 0 and found.review.count() == 0
    pages = spark.createDataFrame([(1, 0, 0, "3. A name--text")], "doc_id long, page int, line_no int, line string")
    nothing = walked_edition(pages, spark.createDataFrame([], "number string"))
    assert nothing.items.count() == 0 and nothing.review.count() == 1


def test_suffix_map_takes_digit_tails(spark):
    df = spark.createDataFrame([("421क. some words",), ("21ख. some words",)], "line string")
    got = df.select(script.heading(F.col("line"), {"21क": "21A1"}).alias("h")).select("h.number_hi", "h.latin").collect()
    assert [tuple(r) for r in got] == [("21क", "21A1"), ("21ख", "21B")]


def test_parts_take_the_first_usable_name(spark):
    lines = [
        (1, 3, 0, "भाग 2"), (1, 3, 1, "घाट और नाव ."), (1, 3, 2, "[भाग 4क]"), (1, 3, 3, ""), (1, 3, 4, "झील"),
        (1, 3, 5, "भाग 5"), (1, 3, 6, "12"), (1, 3, 7, "3. नाम की पंक्ति"), (1, 3, 8, "भाग 6"), (1, 3, 9, "भाग 8"), (1, 3, 10, "अंतिम"),
        (1, 4, 11, "भाग 2"), (1, 4, 12, "दूसरी बार"), (1, 4, 13, "भाग 9"), (1, 5, 14, "दूसरे पृष्ठ पर"), (2, 3, 0, "भाग 77"), (2, 3, 1, "सूची में नहीं"),
    ]
    df = spark.createDataFrame(lines, "doc_id long, page int, line_no int, line string")
    listed = spark.createDataFrame([(n,) for n in ("2", "4A", "5", "6", "8", "9")], "number string")
    got = edition_parts(df, listed, {"8": "verified"}).collect()
    assert sorted((r.number, r.number_hi, r.name, r.page) for r in got) == [
        ("2", "2", "घाट और नाव", 3), ("4A", "4क", "झील", 3), ("6", "6", "अंतिम", 3), ("8", "8", "verified", 3),
    ]


def test_assembly_merges_mends_and_fills(spark):
    items = spark.createDataFrame(
        [(1, "3", "3", "कािठन  नाम", "पहला | भाग । (2) दूसरा भाग ।", 7), (1, "9A", "9क", "x", "", 8), (1, "5", "5", "y", "z", 9)],
        "doc_id long, number string, number_hi string, title string, text string, page int",
    )
    first = spark.createDataFrame(
        [(1, "3", "2", "amended", ["4th-amendment"]), (1, "4", "2", "omitted", []), (1, "9A", "3", "in-force", None), (2, "3", "1", "in-force", [])],
        "doc_id long, number string, part string, status string, amended_by array<string>",
    )
    rows = assembled(items, first, {"5": "verified"}, "not printed", "none here").collect()
    got = {(r.doc_id, r.number): r for r in rows}
    assert sorted(got) == [(1, "3"), (1, "4"), (1, "5"), (1, "9A"), (2, "3")]
    three = got[1, "3"]
    assert (three.part, three.status, three.amended_by, three.title, three.page) == ("2", "amended", ["4th-amendment"], "काठिन नाम", 7)
    assert [(c.number, c.text) for c in three.clauses] == [(None, "पहला । भाग ।"), ("2", "दूसरा भाग ।")]
    four = got[1, "4"]
    assert (four.number_hi, four.title, [c.text for c in four.clauses], four.page, four.printed) == ("4", "not printed", ["none here"], 0, False)
    assert (got[1, "5"].title, got[1, "5"].part, got[1, "9A"].amended_by, got[1, "9A"].clauses) == ("verified", "", [], [])
    assert [n for n in sorted((r.place, r.number) for r in rows if r.doc_id == 1)] == [(r.place, r.number) for r in sorted(rows, key=lambda r: r.place) if r.doc_id == 1]


def test_a_line_is_looked_at_once(spark):
    """However often the walk reads its rows, headings are looked for once per line."""
    from pyspark.sql import functions as F

    from lexloom.operators.second_edition import Anchor, walked_edition

    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(line):
        seen.add(1)
        return line

    rows = [(1, 0, i, f"{i + 1}. Name of it--text {i}" if i % 3 == 0 else f"body {i}") for i in range(30)]
    lines = spark.createDataFrame(rows, "doc_id long, page int, line_no int, line string").repartition(2)
    lines = lines.withColumn("line", told.asNondeterministic()("line"))
    listed = spark.createDataFrame([(str(i),) for i in range(1, 40)], "number string")
    edition = walked_edition(lines, listed, [Anchor("7A", 0, "body 7", "Lost")])
    assert len(edition.items.collect()) > 5
    assert edition.review.count() == 0
    assert seen.value == 30
