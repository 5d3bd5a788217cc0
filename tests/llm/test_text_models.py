"""Quality and toxicity: grammar, held-out accuracy, edge cases."""

import os
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lexloom.llm import quality, toxicity
from lexloom.llm.common import held_out, labelled_sample
from lexloom.llm.transducers import Transducer

FOLDER = "/root/testdata/sf0.01"
given = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the given tables")


def test_composition_reads_what_the_first_writes():
    double = Transducer.built(0, "ab", lambda s, x: (1 - s, x.upper()))
    count = Transducer.built(0, ["A", "B"], lambda s, x: ((s + (x == "A")) % 3, f"{x}{s}"))
    both = double.then(count)
    assert both.run("abaa") == count.run(double.run("abaa")) == ["A0", "B1", "A1", "A2"]


def labels_of(text, words=None):
    scorer = toxicity.Scorer(toxicity.Model(words or dict.fromkeys(toxicity.INSULTS | toxicity.THREATS, 3.0), toxicity.THREATS, toxicity.LABEL_WEIGHTS, -3.0))
    return [label for label, _ in scorer.clause_hits(toxicity.WORD.findall(text.lower()))]


def test_grammar_labels():
    assert labels_of("what an idiot") == ["insult"]
    assert labels_of("you are an idiot") == ["insult+target"]
    assert labels_of("this is not an idiot") == ["insult+negated"]
    assert labels_of("the paper said idiot") == ["insult+reported"]
    assert labels_of("i will kill you") == ["threat", "late target"]
    assert labels_of("the engines kill quietly") == ["verb"]
    assert labels_of("nothing here") == []


def test_clauses_score_not_words():
    model = toxicity.Model(dict.fromkeys(toxicity.INSULTS | toxicity.THREATS, 3.0), toxicity.THREATS, toxicity.LABEL_WEIGHTS, -3.0)
    s = toxicity.Scorer(model)
    assert s.score("you are an idiot") > s.score("an idiot") > s.score("not an idiot") > s.score("a tree")


def test_stems_take_any_ending():
    assert labels_of("vak vakuro vakelo tree", {"vak*": 4.0}) == ["insult", "insult"]
    assert labels_of("vak", {"vak*": 4.0}) == []


def training(spark, rows):
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y, y) for i, _, y in rows], "doc_id long, toxic int, quality int")
    return docs, labels


def invented(n=400, seed=2):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abdeiklmnorstu", k=rng.randint(3, 8))) for _ in range(300)]
    rows = []
    for i in range(n):
        text = rng.choices(words, k=60)
        toxic = int(i % 5 == 0 or i % 7 == 0)
        if toxic:
            for _ in range(2):
                text[rng.randrange(60)] = rng.choice(["grobu", "zhekar" + rng.choice(["ta", "lo", "min", "us"])])
        rows.append((i, " ".join(text) + ".", toxic))
    return rows


def test_learns_words_and_stems(spark):
    docs, labels = training(spark, invented())
    model = toxicity.train(docs, labels)
    assert model.words["grobu"] > 2
    assert any(w.endswith("*") and "zhekar".startswith(w[:-1]) and len(w) > 4 for w in model.words)
    scored = toxicity.score(docs, model).join(labels, "doc_id")
    wrong = scored.where("predicted <> toxic").count()
    assert wrong <= 8
    assert {r["doc_id"] for r in toxicity.without_toxic(docs, model).collect()} == {
        r["doc_id"] for r in scored.where("predicted = 0").collect()
    }


def test_copies_prove_nothing(spark):
    rows = invented(200)
    rows += [(1000 + i, "the same marrowbone text every time over and over", 1) for i in range(150)]
    model = toxicity.train(*training(spark, rows))
    assert "marrowbone" not in model.words


def test_held_out_labels_are_not_learned(spark):
    rows = invented(300)
    docs, labels = training(spark, rows)
    fold = held_out(F.col("doc_id"), toxicity.FOLDS, toxicity.HELD_OUT)
    spoiled = labels.withColumn("toxic", F.when(fold, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.train(docs, labels) == toxicity.train(docs, spoiled)


@pytest.mark.parametrize("operator", [toxicity, quality])
def test_odd_rows(spark, operator):
    rows = invented(120)
    docs, labels = training(spark, rows)
    model = operator.train(docs, labels)
    odd = spark.createDataFrame(
        [(1, None, "a"), (2, "", "b"), (2, "", "b"), (None, "word " * 30000, "c"), (3, "###", None)],
        "doc_id long, text string, predicted string",
    )
    found = operator.score(odd, model).collect()
    assert len(found) == 5 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in found)
    keep = operator.without_toxic if operator is toxicity else operator.without_poor
    assert keep(odd, model).columns == odd.columns
    assert operator.score(odd.limit(0), model).count() == 0


@pytest.mark.parametrize("operator", [toxicity, quality])
def test_no_labels(spark, operator):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    labels = spark.createDataFrame([(None, 1, 1), (1, None, None)], "doc_id long, toxic int, quality int")
    found = operator.score(docs, operator.train(docs, labels)).collect()
    assert len(found) == 1 and 0 <= found[0]["score"] <= 1


def test_null_ids_are_not_held_out(spark):
    df = spark.createDataFrame([(None,), (0,), (5,)], "k long")
    assert [r[0] for r in df.select(held_out(F.col("k"), 5, 0)).collect()][0] is False


def test_equal_scores_for_equal_texts(spark):
    docs, labels = training(spark, invented(150))
    model = quality.train(docs, labels)
    twice = docs.union(docs.withColumn("doc_id", F.col("doc_id") + 10_000))
    found = {r["doc_id"]: r["score"] for r in quality.score(twice, model).collect()}
    assert all(abs(found[i] - found[i + 10_000]) < 1e-6 for i in range(150))


def test_blocks_are_exact():
    import numpy as np

    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("ab .,!#AB1"), size=50)) for _ in range(40)]
    rows = np.stack([quality.terms(t) for t in texts])
    width = rows.shape[1]
    model = quality.Model(np.ones(width, np.float32), rng.normal(size=(width, 6)).astype(np.float32), np.zeros((0, 6)), np.zeros(0), 0.5)
    model.vectors, model.labels = model.project(rows[:30]), (np.arange(30) % 3 > 0).astype(float)
    found = model.scores(texts)
    for t, got in zip(texts, found):
        cos = model.project(quality.terms(t)[None])[0] @ model.vectors.T
        near = np.argsort(-cos)[: quality.NEIGHBOURS]
        w = np.maximum(cos[near], 0).astype(float) ** quality.SHARPNESS
        want = ((w * model.labels[near]).sum() + quality.PRIOR_WEIGHT * 0.5) / (w.sum() + quality.PRIOR_WEIGHT)
        assert got == pytest.approx(want, abs=1e-4)


@given
@pytest.mark.parametrize("operator, label, least", [(toxicity, "toxic", 0.93), (quality, "quality", 0.93)])
def test_held_out_accuracy(spark, operator, label, least):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    found = operator.score(docs, operator.train(docs, labels)).join(labels, "doc_id")
    test = found.where(held_out(F.col("doc_id"), operator.FOLDS, operator.HELD_OUT))
    n, right = test.count(), test.where(F.col("predicted") == F.col(label)).count()
    assert right / n >= least


def test_repeated_labelled_ids_do_not_push_a_label_out(spark):
    """One clean id in many rows: the sample stays within its bound and keeps rows of both labels."""
    clean = [(1, " ".join(["the table is set for lunch"] * (i % 20 + 1)) + "! idiot proof" * (i // 20)) for i in range(300)]
    toxic = [(i, f"you are an idiot and a moron number {i}") for i in range(2, 302)]
    docs = spark.createDataFrame(clean + toxic, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0)] + [(i, 1) for i, _ in toxic], "doc_id long, toxic int")
    for most, size in ((60, 60), (900, 600)):
        kept = labelled_sample(docs.union(docs.where("doc_id = 1")), labels, "toxic", 97, 96, most)
        found = kept.collect()
        known = sum(1 for i, _ in toxic if zlib.crc32(str(i).encode()) % 97 != 96) if most == 900 else 59
        assert len(found) <= most and (most == 60 or len(found) == known + 300)
        assert all(r["n"] == 2 - r["y"] for r in found) and size
    assert toxicity.train(docs, labels, 310) != toxicity.train(docs, labels.where("toxic = 0"), 310)


# --- the clause rules, one word after the other --------------------------------


def slow_features(text, model):
    """What the composed machine says, by looking back from every hit."""
    stems = sorted((k[:-1] for k in model.words if k.endswith("*")), key=len, reverse=True)

    def read(word):
        if word in model.words:
            return "threat" if word in model.threats else "insult", model.words[word]
        for stem in stems:
            if word.startswith(stem) and word != stem:
                return "threat" if stem + "*" in model.threats else "insult", model.words[stem + "*"]
        lists = {"target": toxicity.TARGETS, "negator": toxicity.NEGATORS, "report": toxicity.REPORTS, "intent": toxicity.INTENTS}
        return next(((kind, 0.0) for kind in ("intent", "report", "negator", "target") if word in lists[kind]), ("other", 0.0))

    def behind(places, i, reach):
        return any(0 < i - p <= reach for p in places)

    total = dict.fromkeys(toxicity.LABELS, 0.0)
    for clause in toxicity.CLAUSE_END.split(text.lower()):
        found = [read(w) for w in toxicity.WORD.findall(clause)]
        at = lambda kind: [i for i, (k, _) in enumerate(found) if k == kind]
        hits, weight, last_hit, last_weight, negation = [], 0.0, None, 0.0, None
        if not any(w for _, w in found):
            continue
        for i, (kind, w) in enumerate(found):
            if kind == "negator":
                negation = toxicity.NEAR_NEGATOR
                continue
            before, negation = negation, max((negation or 0) - 1, 0)
            label = None
            if kind in ("insult", "threat"):
                meant = kind == "insult" or behind(at("intent") + at("target"), i, toxicity.NEAR_INTENT)
                if not meant:
                    label = "verb"
                else:
                    label = f"{kind}+target" if behind(at("target"), i, toxicity.NEAR_TARGET) else kind
                    if before:
                        label = f"{kind}+negated"
                    elif any(p < i for p in at("report")):
                        label = f"{kind}+reported"
                    last_hit = i
            elif kind == "target":
                if last_hit is not None and i - last_hit <= 2:
                    label = "late target"
                last_hit = None
            if label:
                last_weight = w or last_weight
                hits.append((label, last_weight))
        size = sum(w for _, w in hits)
        for label, w in hits:
            total[label] += w * min(1.0, toxicity.CLAUSE_MOST / size) if size else 0.0
    return [total[label] for label in toxicity.LABELS]


def test_machine_equals_the_rules_word_by_word():
    rng = random.Random(9)
    words = {"idiot": 3.0, "scum": 5.0, "kill": 2.0, "hurt": 1.0, "vak*": 4.0, "zor*": 2.5}
    model = toxicity.Model(words, toxicity.THREATS | {"zor*"}, toxicity.LABEL_WEIGHTS, -3.0)
    scorer = toxicity.Scorer(model)
    pool = [*words, "vakel", "zorin", "you", "they", "not", "never", "said", "will", "tree", "house", "is", "the", ",", ". ", "!"]
    pool = [w.rstrip("*") for w in pool]
    for _ in range(3000):
        text = " ".join(rng.choice(pool) for _ in range(rng.randint(0, 14))).replace(" ,", ",")
        assert scorer.features(text).tolist() == pytest.approx(slow_features(text, model)), text


def trained(spark):
    docs, labels = training(spark, invented())
    return toxicity.train(docs, labels)


def test_training_keeps_what_the_grammar_says(spark):
    """After training a negated or reported insult weighs less than a plain one, and an aimed one more."""
    model = trained(spark)
    w = model.labels
    assert 0 < w["insult+negated"] <= 0.4 * w["insult"] and w["insult+reported"] <= 0.6 * w["insult"] < w["insult+target"]
    scorer = toxicity.Scorer(model)
    said = [scorer.score(t) for t in ("you are an idiot", "what an idiot", "the paper said idiot", "this is not an idiot")]
    assert said == sorted(said, reverse=True) and len(set(said)) == 4


def test_labels_decide(spark):
    """With one weight for all labels other texts are found toxic."""
    model = trained(spark)
    flat = toxicity.Model(model.words, model.threats, dict.fromkeys(model.labels, model.labels["insult"]), model.offset)
    rng = random.Random(4)
    parts = ["what an idiot", "not an idiot", "he said idiot", "you idiot", "the engines kill quietly", "never a moron", "a quiet house"]
    texts = [". ".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(300)]
    changed = sum((toxicity.Scorer(model).score(t) >= 0.5) != (toxicity.Scorer(flat).score(t) >= 0.5) for t in texts)
    assert changed > 30


def test_learned_words_earn_their_symbol(spark):
    """A made-up word that follows words of intent is a threat, another one an insult."""
    rng = random.Random(3)
    name = lambda: "".join(rng.choices("bdklmnr", k=3)) + "ou"
    rows = [(i, f"we walk to {name()} and {name()} rest", 0) for i in range(200)]
    rows += [(500 + i, f"i will grumf {name()} soon, {name()}" if i % 2 else f"{name()} what a plorkle {name()}", 1) for i in range(200)]
    docs, labels = training(spark, rows)
    model = toxicity.train(docs, labels)
    lexicon = toxicity.Lexicon(model.words, model.threats)
    assert lexicon["grumf"][0] == "threat" and lexicon["plorkle"][0] == "insult"
