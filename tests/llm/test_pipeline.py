"""The pipeline's stages against their operators and brute force, on a small folder of tables."""

import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from lexloom.llm import quality, toxicity

SYLLABLES = "ba de ki lo mu na pe ri so tu".split()


def sentence(rng, words=60):
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(words)) + "."


def shingles(text):
    """Five-word shingles of a text, fewer words as one."""
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Clean, poor (shouted) and toxic documents, copies, near copies and odd rows, with an extra column."""
    rng = random.Random(12)
    rows, labels = [], []
    for i in range(240):
        text, poor, toxic = sentence(rng), i % 6 == 0, i % 7 == 3
        if toxic:
            words = text.split()
            for at in rng.sample(range(len(words)), 2):
                words[at] = rng.choice(["idiot", "moron", "scum"])
            text = " ".join(words)
        if poor:
            text = " ".join(w.upper() + "!!" for w in text.split())
        rows.append((i, text))
        labels.append((i, int(not poor), int(toxic)))
    clean = next(t for i, t in rows if i % 6 and i % 7 != 3)
    rows += [(900 + i, clean) for i in range(5)] + [(950, clean), (950, clean)]
    # near copies: one word in sixty changed keeps 0.84, three far apart leave 0.6
    for i in range(6):
        words = clean.split()
        for at in (30,) if i % 2 else (10, 30, 50):
            words[at] = f"bade{'ki' * i}"
        rows.append((970 + i, " ".join(words)))
    rows += [(960, None), (961, ""), (None, sentence(rng))]
    folder = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), i) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, fp long")
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    labels = spark.read.parquet(f"{tables}/labels.parquet")
    columns = docs.columns
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        out = stage(spark, docs, tables)
        if name != "packing":
            assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
        after = docs.collect()
        if name == "quality":
            model = quality.train(spark.read.parquet(f"{tables}/documents.parquet"), labels)
            wanted = [b for b, s in zip(before, model.scores([t or "" for _, t in before])) if s >= 0.5]
            assert sorted([(r["doc_id"], r["text"]) for r in after], key=str) == sorted(wanted, key=str)
            assert not any((i or 1) % 6 == 0 for i, _ in wanted if i and i < 240)
        elif name == "toxicity":
            model = toxicity.train(spark.read.parquet(f"{tables}/documents.parquet"), labels)
            scorer = toxicity.Scorer(model)
            wanted = [b for b in before if scorer.score(b[1] or "") < 0.5]
            assert sorted([(r["doc_id"], r["text"]) for r in after], key=str) == sorted(wanted, key=str)
            assert len(wanted) < len(before)
        elif name == "near_duplicates":
            sets = [shingles(t) for _, t in before]
            group = list(range(len(before)))
            for i in range(len(before)):
                for j in range(i):
                    union = sets[i] | sets[j]
                    if not union or len(sets[i] & sets[j]) >= 0.8 * len(union):
                        a, b = group[i], group[j]
                        group = [min(a, b) if g in (a, b) else g for g in group]
            ids = {}
            for (doc, _), g in zip(before, group):
                ids.setdefault(g, []).append(doc)
            wanted = [min((d for d in members if d is not None), default=None) for members in ids.values()]
            assert sorted((r["doc_id"] for r in after), key=str) == sorted(wanted, key=str)
        else:
            assert {r["doc_id"] for r in after} == {d for d, _ in before}
            used = {}
            for r in after:
                used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
            for places in used.values():
                assert sum(n for _, n in places) <= 2048
    assert zlib.crc32(np.array([0], "<u4").tobytes()) not in [r["ids_crc32"] for r in after if r["length"] > 1]


def test_run_is_its_stages(spark, tables):
    rows = corpus_pipeline.run(spark, tables).collect()
    assert rows and corpus_pipeline.ORACLE_SQL is None
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


@pytest.mark.parametrize("empty", ["documents", "labels"])
def test_empty_tables(spark, tables, tmp_path, empty):
    """Without documents nothing comes out; without labels nothing is poor or toxic but by the lists."""
    for name in ("documents", "labels"):
        rows = spark.read.parquet(f"{tables}/{name}.parquet")
        (rows.limit(0) if name == empty else rows).write.parquet(f"{tmp_path}/{name}.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert not rows if empty == "documents" else rows
