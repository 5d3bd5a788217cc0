"""Near copies by Jaccard similarity against brute force; copies planted at 0.8 to 0.95."""

import random

import pytest

import corpus_pipeline
from lexloom.llm import near_copies, simhash


def words_of(rng, n):
    return ["".join(rng.choices("abcdefghij", k=6)) for _ in range(n)]


def shingles(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(rows):
    """Kept ids: the smallest per component of pairs at 0.8 or more."""
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if group[i] != group[j] and jaccard(sets[i], sets[j]) >= 0.8:
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    ids = {}
    for (doc, _), g in zip(rows, group):
        ids.setdefault(g, []).append(doc)
    return sorted((min((d for d in m if d is not None), default=None) for m in ids.values()), key=str)


def planted(rng, similarity, n=400):
    """A text and a copy whose Jaccard similarity is the smallest reachable one at or above the given."""
    base = words_of(rng, n)
    copy, at = list(base), 3
    while True:
        changed = list(copy)
        changed[at : at + 1] = words_of(rng, 1)
        if jaccard(shingles(" ".join(base)), shingles(" ".join(changed))) < similarity:
            return " ".join(base), " ".join(copy)
        copy, at = changed, at + 11


def test_planted_copies_go(spark):
    rng = random.Random(8)
    rows = []
    for i, level in enumerate([0.8, 0.82, 0.85, 0.9, 0.95] * 8):
        a, b = planted(rng, level)
        assert level <= jaccard(shingles(a), shingles(b)) < level + 0.03
        rows += [(2 * i, a), (2 * i + 1, b)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in corpus_pipeline.drop_copies(spark, df, "").collect())
    assert kept == list(range(0, 80, 2))
    # the digests of op4 leave most of them
    far = [bin(simhash.fingerprint(a) ^ simhash.fingerprint(b)).count("1") > 4 for (_, a), (_, b) in zip(rows[::2], rows[1::2])]
    assert sum(far) > 20


@pytest.mark.parametrize("crowd", [2, 1000])
def test_equal_to_brute_force(spark, monkeypatch, crowd):
    """Around the limit, crowds around one text, a common passage, short, empty, null and repeated rows."""
    monkeypatch.setattr(near_copies, "CROWD", crowd)
    rng = random.Random(5)
    passage, rows = words_of(rng, 30), []
    for i in range(12):
        base = words_of(rng, rng.choice([6, 40, 90])) + passage * (i % 2)
        rows.append((1000 - i, " ".join(base)))
        for _ in range(9):
            copy = list(base)
            for at in rng.sample(range(len(base)), min(len(base), rng.randint(0, 4))):
                copy[at] = "x" + str(rng.randrange(10**6))
            rows.append((rng.randrange(5000, 9000), " ".join(copy)))
    for i in range(40):
        rows.append((200 + i, " ".join(passage + words_of(rng, rng.randint(1, 12)))))
    rows += [(7, None), (3, ""), (9, " \n"), (5, "One two"), (6, "one TWO"), (1000, rows[0][1]), (1000, rows[0][1]), (None, rows[0][1]), (None, "lonely words here and there")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, node string, n int").repartition(3)
    kept = near_copies.without_copies(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == brute(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_copies.without_copies(df).count() == 0


def test_bitmaps_never_deny_a_pair():
    import numpy as np

    rng = np.random.default_rng(4)
    for _ in range(200):
        shared = rng.integers(0, 2**63, rng.integers(0, 900), dtype=np.uint64)
        a = np.unique(np.concatenate([shared, rng.integers(0, 2**63, rng.integers(0, 300), dtype=np.uint64)]))
        b = np.unique(np.concatenate([shared, rng.integers(0, 2**63, rng.integers(0, 300), dtype=np.uint64)]))
        apart = len(a) + len(b) - 2 * len(np.intersect1d(a, b))
        assert near_copies.differing(near_copies.bitmap(a), near_copies.bitmap(b)) <= apart
        assert near_copies._shared(near_copies._held(a), near_copies._held(b)) == len(np.intersect1d(a, b))


def test_fingerprints_are_linked_first(spark, monkeypatch):
    """The stage goes through SimHash: what it links is verified, and only its roots meet in the exact join."""
    proposed, pairs = [], near_copies._fingerprint_pairs

    def kept(nodes):
        found = pairs(nodes)
        proposed.extend(tuple(r) for r in found.collect())
        return found

    monkeypatch.setattr(near_copies, "_fingerprint_pairs", kept)
    rng = random.Random(2)
    base = words_of(rng, 3000)
    close, lone = list(base), words_of(rng, 80)
    close[7] = "moss"
    # one fingerprint, far shingle sets: repeats outweigh all else
    often = "one two three four five " * 400
    rows = [(4, " ".join(base)), (2, " ".join(close)), (9, " ".join(lone)), (5, often + "seven eight"), (6, often + " ".join(words_of(rng, 40)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept_ids = sorted(r["doc_id"] for r in corpus_pipeline.drop_copies(spark, df, "").collect())
    assert kept_ids == [2, 5, 6, 9] == brute(rows)
    assert len(proposed) == 2 and all(a != b for a, b in proposed)
    assert len({a for a, _ in proposed}) == 2


def test_crowd_apart_gives_no_square_of_pairs(spark, monkeypatch):
    """Copies of a text that is not there, most of them too far from each other: few pairs leave the join of their crowd."""
    rows_of, checkpointed = [], near_copies.checkpointed

    def counted(df):
        out = checkpointed(df)
        if out.columns == ["a", "b"]:
            rows_of.append(out.count())
        return out

    monkeypatch.setattr(near_copies, "checkpointed", counted)
    rng = random.Random(6)
    base, rows = words_of(rng, 150), []
    for i in range(240):
        copy = list(base)
        for at in rng.sample(range(150), rng.choice([1, 2, 3, 3, 3, 4])):
            copy[at] = words_of(rng, 1)[0]
        rows.append((i, " ".join(copy)))
    # no copy is close to all others
    rows = [r for r in rows if len(shingles(r[1]) & shingles(" ".join(base))) <= 136]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((r["doc_id"] for r in near_copies.without_copies(df).collect()), key=str)
    assert kept == brute(rows) and len(kept) > len(rows) / 2
    assert len(rows) > 150 and max(rows_of) < 3 * len(rows)
