"""Prefix trie of conversations against a trie built turn by turn."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from lexloom.llm import conversation_trie

SCHEMA = "conv_id long, turn int, role string, text string"


def brute(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            mark = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            turns[conv].append(((turn is not None, turn or 0, mark), (role, text)))
    original = {c: [t for _, t in sorted(found)] for c, found in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in original:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
        rebuilt = tuple(original.get(base, [])[:h] + original[c][h:])
        for d in range(len(rebuilt) + 1):
            members[rebuilt[:d]].append(c)
        ends[rebuilt].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)

    def below(node):
        leaves, saved = 0, (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        for child in children[node]:
            more = below(child)
            leaves, saved = leaves + more[0], saved + more[1]
        return (leaves or 1), saved

    return sorted(
        (
            min(found),
            len(node),
            min(members[node[:-1]]) if node else -1,
            len(found),
            len(children[node]),
            *below(node),
            hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest(),
        )
        for node, found in list(members.items())
    )


def trie(spark, rows, schema=SCHEMA):
    found = conversation_trie.prefix_trie(spark.createDataFrame(rows, schema))
    return sorted(tuple(-1 if v is None else v for v in r) for r in found.collect())


@pytest.mark.parametrize("seed", range(3))
def test_random_conversations(spark, seed):
    rng = random.Random(seed)
    rows = []
    for conv in rng.sample(range(-150, 900), 120):
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, rng.choice([turn, turn, None]), rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", "ccé", "", None])))
    rng.shuffle(rows)
    assert trie(spark, rows) == brute(rows)


def test_copies_and_one_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "RUN_IDS", 7)
    rows = [(c, t, "user", f"same {t}") for c in range(100, 200) for t in range(3)]
    rows += [(700, t, "user", f"turn {t % 5}") for t in range(400)]
    assert trie(spark, rows) == brute(rows)


def test_nulls_repeats_and_turnless_conversations(spark):
    # 801..: bases absent, so short conversations lose all their turns
    rows = [(c, 0, "user", "hi") for c in range(801, 830)]
    rows += [(None, 0, "user", "nobody's"), (900, None, None, None), (900, None, None, None), (901, 1, "user", "x"), (901, 1, "user", "x")]
    found = trie(spark, rows)
    assert found == brute(rows)
    assert found[0][1] == 0 or any(r[1] == 0 and r[3] == 31 for r in found)


def test_roles_and_texts_are_kept_apart(spark):
    rows = [(c, t, role, text) for c, pair in enumerate([("us", "er"), ("user", ""), ("", "user")], 200) for t, (role, text) in enumerate([pair] * 8)]
    assert trie(spark, rows) == brute(rows)


def test_extra_columns_and_no_rows(spark):
    schema = SCHEMA + ", depth string, mark string, chars string"
    rows = [(1, t, "user", "a", "x", "y", "z") for t in range(8)]
    assert trie(spark, rows, schema) == brute([r[:4] for r in rows])
    assert trie(spark, [], SCHEMA) == []
