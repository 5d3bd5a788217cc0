"""Phrases found by their n-grams against a search word by word."""

import random
import re

from lexloom.operators.phrases import phrase_hits, phrase_issues


def words_of(text):
    return re.findall(r"[^\W_]+(?:['’][^\W_]+)*", (text or "").lower())


def test_hits_equal_a_search_word_by_word(spark):
    rng = random.Random(4)
    vocabulary = ["a", "b", "don't", "É", "x1", "of", "the"]
    texts = [(i, rng.choice([None, ""]) if i % 17 == 0 else rng.choice([" ", ", ", "\n- "]).join(rng.choices(vocabulary, k=rng.randint(0, 30)))) for i in range(120)]
    listed = [(i, rng.choice(["", "!", None, *[" ".join(rng.choices(vocabulary, k=rng.randint(1, 5)))] * 9])) for i in range(300)]
    got = phrase_hits(
        spark.createDataFrame([(*r, "x") for r in texts], "k long, t string, n string"), "k", "t", spark.createDataFrame(listed, "p long, phrase string"), "p", "phrase"
    )
    wanted = []
    for k, t in texts:
        w = words_of(t)
        for p, phrase in listed:
            q = words_of(phrase)
            at = [i for i in range(len(w) - len(q) + 1) if w[i : i + len(q)] == q] if q else []
            if at:
                wanted.append((k, p, len(at), at[0]))
    assert sorted(map(tuple, got.collect())) == sorted(wanted)


def test_a_hundred_thousand_phrases(spark):
    listed = spark.range(100_000).selectExpr("id AS p", "concat('word', id % 5000, ' of ', id) AS phrase")
    texts = spark.range(500).selectExpr("id AS k", "concat('some word', (id * 7) % 5000, ' Of ', id * 7, '. word1 of 2') AS t")
    got = {(r.k, r.p, r.n) for r in phrase_hits(texts, "k", "t", listed, "p", "phrase").collect()}
    assert got == {(i, 7 * i, 1) for i in range(500)}


def test_no_phrases_and_issues(spark):
    texts = spark.createDataFrame([(1, "We DELVE into it, in conclusion."), (2, "nothing")], "k long, t string")
    none = spark.createDataFrame([], "p long, phrase string")
    assert phrase_hits(texts, "k", "t", none, "p", "phrase").count() == 0
    worn = spark.createDataFrame([("delve",), ("in conclusion",), ("in conclusion",)], "phrase string")
    got = sorted(map(tuple, phrase_issues(texts, "k", "t", worn, "phrase").collect()))
    assert got == [(1, "banned-phrase", 'uses the worn phrase "delve"'), (1, "banned-phrase", 'uses the worn phrase "in conclusion"')]
