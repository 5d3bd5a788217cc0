"""Spelling variants against brute force over all pairs."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lexloom.llm import bloom, spelling


def edit_apart(a, b):
    """Whether exactly one insertion, deletion or replacement leads from one to the other."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


def brute(counts, times=10):
    found = {}
    for w, n in counts.items():
        near = sorted((-counts[v], v) for v in counts if edit_apart(w, v))
        form = near[0][1] if near and -near[0][0] >= times * n else None
        found[w] = [form, n, len(near), counts[form] if form else None]
    rows = []
    for w, (form, n, near, form_n) in found.items():
        root = w
        while found[root][0]:
            root = found[root][0]
        rows.append((w, form, root, n, near, form_n))
    return sorted(rows)


def slow_words(rows):
    total = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 7 and n >= 2}


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    base = ["".join(rng.choices("abcdeéß", k=rng.randint(6, 11))) for _ in range(40)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(200):
            word = base[min(int(rng.expovariate(0.15)), 39)]
            if rng.random() < 0.1:
                at = rng.randrange(len(word))
                word = rng.choice([word[:at] + word[at + 1 :], word[:at] + rng.choice("abÀxy") + word[at + rng.randint(0, 1) :]])
            words.append(word.upper() if rng.random() < 0.05 else word)
        rows.append((rng.choice([i, i, None]), rng.choice([" ", ", ", "\n", "_1"]).join(words)))
    return rows + [(5, None), (6, ""), (7, "x" * 3000 + " " + "x" * 3000 + " " + "x" * 2999 + "y " + "x" * 2999 + "y"), rows[0]]


def test_words_are_counted(spark, texts):
    rows = spark.createDataFrame([(*r, 1) for r in texts], "doc_id long, text string, word int")
    found = {r["word"]: r["n"] for r in spelling.counted_words(rows).collect()}
    assert found == slow_words(texts)


@pytest.mark.parametrize("most", [32 << 20, 200])
def test_variants_are_those_of_all_pairs(spark, texts, most, monkeypatch):
    monkeypatch.setattr(bloom, "BROADCAST_BYTES", most)
    monkeypatch.setattr(bloom, "PAGE", 2)
    monkeypatch.setattr(spelling, "EDITS", 1 << 12)
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    found = sorted(map(tuple, spelling.spelling_variants(rows).collect()))
    assert found == brute(slow_words(texts))


def test_chains_and_ties(spark):
    counts = {"aaaaaaaa": 1000, "aaaaaaab": 100, "aaaaaabb": 10, "aaaaabbb": 1, "bbbbbbbb": 50, "bbbbbbbc": 50, "bbbbbbb": 5, "éééééééé": 3}
    frame = spark.createDataFrame([(w, n, "x") for w, n in counts.items()], "word string, n int, root string")
    found = sorted(map(tuple, spelling.variants(frame).collect()))
    assert found == brute(counts)
    assert {r[0]: r[2] for r in found}["aaaaabbb"] == "aaaaaaaa"
    assert {r[0]: r[1] for r in found}["bbbbbbb"] == "bbbbbbbb"


def test_no_words(spark):
    nothing = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.spelling_variants(nothing).collect() == []
    assert spelling.spelling_variants(spark.createDataFrame([(1, None), (2, "a b")], "doc_id long, text string")).count() == 0


def test_hashes_of_edits_are_those_of_the_words():
    rng = random.Random(2)
    words = ["".join(rng.choices("abcé", k=rng.randint(1, 12))) for _ in range(200)]
    alphabet = np.array(sorted(map(ord, "abcé")), np.uint32)

    class Everything:
        def __init__(self):
            self.seen = []

        def holds(self, shard, hashes):
            self.seen.append(hashes)
            return np.arange(len(hashes))

    filters = Everything()
    spelled, hashes = [], []
    for who, place, letter in spelling.edits(words, alphabet, filters):
        for w, p, x in zip(who, place, letter):
            spelled.append(words[w][:p] + (chr(x) if x else "") + words[w][p + 1 :])
    hashes = np.concatenate(filters.seen)
    assert (spelling.word_hashes(spelled) == hashes).all()


def test_filters_hold_what_they_were_given():
    words = [f"word{i}" for i in range(5000)]
    hashes = spelling.word_hashes(words)
    blocks = spelling.filter_blocks(len(words), 8)
    block = bloom.block_of(hashes, blocks) // bloom.PAGE
    pages = {(8, int(p)): bloom.page_bytes(hashes[block == p], blocks, int(p)) for p in np.unique(block)}
    filters = bloom.Filters({8: blocks}, pages)
    assert len(filters.holds(8, hashes)) == len(words)
    others = spelling.word_hashes([f"other{i}" for i in range(20000)])
    assert len(filters.holds(8, others)) < 200
    assert len(filters.holds(9, others)) == 0
