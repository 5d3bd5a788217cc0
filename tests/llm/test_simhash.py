"""Fingerprints, links and components against brute force."""

import random

import xxhash
from pyspark.sql import functions as F

from lexloom.llm import simhash
from lexloom.llm.components import components

WORDS = "oak elm ash fir yew box bay fig nut pea rye oat hop ivy may sap bud bark leaf root stem".split()


def slow_fingerprint(text):
    blanks = " \t\n\x0b\x0c\r"
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for b in blanks:
        lower = lower.replace(b, " ")
    words = [w for w in lower.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_rule():
    rng = random.Random(3)
    texts = ["", "   ", "one", "One TWO three", "É é\x85x y", "a\tb\x0bc\x0cd\re f"]
    texts += [" ".join(rng.choices(WORDS, k=n)) for n in (4, 5, 30, 200)]
    for t in texts:
        assert simhash.fingerprint(t) == slow_fingerprint(t)


def test_long_text_counts_in_blocks(monkeypatch):
    text = " ".join(random.Random(1).choices(WORDS, k=500))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "HASHES_AT_ONCE", 7)
    assert simhash.fingerprint(text) == whole


def test_segments_leave_one_with_one_difference():
    for distance in range(1, 9):
        parts = simhash.segments(distance)
        assert sum(w for _, w in parts) == 64 and 2 * len(parts) > distance


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_every_link_is_found(spark):
    rng = random.Random(11)
    nodes = {rng.getrandbits(64) for _ in range(60)}
    for base in list(nodes)[:40]:
        for _ in range(6):
            x = base
            for b in rng.sample(range(64), rng.randint(1, 6)):
                x ^= 1 << b
            nodes.add(x)
    df = spark.createDataFrame([(signed(n),) for n in nodes], "fp long")
    got = {(r["a"], r["b"]) for r in simhash.fingerprint_links(df).collect()}
    both = [(signed(x), signed(y)) for x in nodes for y in nodes if bin(x ^ y).count("1") in range(1, 5)]
    assert got == {(min(p), max(p)) for p in both}


def test_components_of_a_long_chain(spark):
    n = 300
    links = spark.range(n).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    more = spark.createDataFrame([(1000, 1001), (1001, 1002), (5000, 5000)], "a long, b long")
    found = {r["node"]: r["root"] for r in components(links.union(more)).collect()}
    assert found == {i: 0 for i in range(n + 1)} | {1000: 1000, 1001: 1000, 1002: 1000}


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_components(rows):
    """Smallest id reachable per row."""
    marks = [simhash.fingerprint(t or "") for _, t in rows]
    group = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if group[j] < group[i] and bin(marks[i] ^ marks[j]).count("1") <= 4:
                    group[i], changed = group[j], True
    least = {}
    for (doc, _), g in zip(rows, group):
        if doc is not None:
            least[g] = min(doc, least.get(g, doc))
    return sorted(
        ((doc, format(m, "016x"), least.get(g)) for (doc, _), m, g in zip(rows, marks, group)), key=str
    )


def corpus():
    rng = random.Random(4)
    rows = []
    for i in range(25):
        text = " ".join(rng.choices(WORDS, k=400))
        rows.append((100 + i, text))
        for j in range(3):
            words = text.split()
            words[rng.randrange(len(words))] = "moss"
            rows.append((500 - 10 * i + j, " ".join(words)))
    rows += [(7, None), (3, ""), (9, " \n"), (100, rows[0][1]), (None, rows[0][1]), (None, "lonely words here and there")]
    return rows


def test_near_duplicates_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, fp string, component_id int")
    found = simhash.near_duplicates(df)
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("m")
    got = sorted(((r["doc_id"], r["m"], r["component_id"]) for r in found.select("doc_id", digits, "component_id").collect()), key=str)
    assert got == brute_components(rows)


def test_one_row_of_each_group_stays(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, row string")
    kept = simhash.without_copies(df)
    assert kept.columns == df.columns
    wanted = {c for d, _, c in brute_components(rows) if c is not None}
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(wanted)
    assert ids.count(None) == 1  # the text that only rows without an id hold


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).count() == 0
    assert simhash.without_copies(df).count() == 0
