"""Toxicity by a weighted finite-state pattern grammar.

A lexicon turns the words of a clause into symbols: insult, threat, target, negator, reporting verb, intent, other.
Five transducers are composed into one: threats (a threatening verb that is intended or aimed at someone), insults,
targets (a hit near the person it is aimed at), negation (a hit behind a negator) and reported speech (hits behind a
reporting verb). The composed machine labels each hit of a clause with how it is meant, and the clause is scored by the
lexicon weight of its hits times the weight of those labels.

The lexicon reads the letters of a word: it knows whole words, and stems that any ending may follow. It starts from lists
and is learned from labels: a word or stem counts by the number of different contexts it is met in, so that copies of
one document prove nothing. Label weights and the offset are fitted by logistic regression towards the grammar's own
weights.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .common import labelled_sample, over_texts, texts_of, with_columns
from .transducers import Transducer

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FOLDS, HELD_OUT = 5, 0
#: Labelled rows that the lexicon and the weights are fitted on, at most.
SAMPLE_ROWS = 12_000
#: Words and stems learned: a log-likelihood ratio of this much, met in this many contexts of toxic texts.
LEAST_RATIO, LEAST_CONTEXTS = 30.0, 4
#: Letters of a stem. A stem gives way to a longer one, or to a word, that holds this share of its contexts.
STEM_LETTERS = range(3, 9)
STEM_SHARE = 0.9
#: Marks a stem among the keys of the lexicon.
STEM = "*"
#: Pull of the regression towards the grammar's weights.
RIDGE = 2.0
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
#: Clauses end at sentence marks, line ends and at conjunctions' commas.
CLAUSE_END = re.compile(r"[.!?;:\n]+|,\s")
LIST_WEIGHT = 3.0

# Word lists the lexicon starts from.
INSULTS = frozenset(
    "idiot idiots moron morons stupid loser losers scum trash worthless pathetic disgusting clown clowns imbecile fool "
    "dumb filth vermin idiota imbécil estúpido basura escoria idioten dummkopf abschaum müll trottel imbécile stupide "
    "ordure déchet crétin".split()
)
THREATS = frozenset(
    "kill hurt destroy beat stab shoot murder crush attack burn matar golpear destruir töten schlagen vernichten tuer "
    "frapper détruire".split()
)
TARGETS = frozenset(
    "you your you're he she they them him her we everyone people tu vous toi ils elles du dich ihr sie euch usted ustedes "
    "ellos ti".split()
)
NEGATORS = frozenset("not no never isn't aren't don't nobody kein keine nicht nie pas jamais nunca jamás".split())
REPORTS = frozenset(
    "said says wrote writes claims claimed called quoted quotes according reported sagte schrieb nannte dit écrit appelé "
    "dijo escribió llamó".split()
)
INTENTS = frozenset("will shall gonna going i'll werde werden vais va voy va a".split()) - {"a", "va"}

OTHER, INSULT, THREAT, TARGET, NEGATOR, REPORT, INTENT = "other insult threat target negator report intent".split()
#: Words between a hit and what bears on it.
NEAR_TARGET, NEAR_NEGATOR, NEAR_INTENT = 4, 3, 4
#: The grammar's weight of a hit by its label, before fitting.
LABEL_WEIGHTS = {
    "insult": 1.0,
    "insult+target": 1.3,
    "insult+negated": 0.4,
    "insult+reported": 0.6,
    "threat": 0.5,
    "threat+target": 1.2,
    "threat+negated": 0.1,
    "threat+reported": 0.3,
    "verb": 0.0,
    "late target": 0.2,
}
#: Lexicon weight of one clause counts up to this much.
CLAUSE_MOST = 8.0
LABELS = tuple(LABEL_WEIGHTS)


def grammar() -> Transducer:
    """threats . insults . targets . negation . reported speech, over the symbols of the lexicon."""
    base = {OTHER, INSULT, THREAT, TARGET, NEGATOR, REPORT, INTENT}

    def threats(since: int, s: str) -> tuple[int, str]:
        """An intended threatening verb is a hit; one without intent or target nearby is a plain verb."""
        near = max(since - 1, 0)
        if s in (INTENT, TARGET):
            return NEAR_INTENT, s
        return near, "verb" if s == THREAT and not since else s

    def insults(state: int, s: str) -> tuple[int, str]:
        """Hits get their mark."""
        return 0, f"!{s}" if s in (INSULT, THREAT) else s

    def targets(state: tuple[int, int], s: str) -> tuple[tuple[int, int], str]:
        """A hit behind a target is aimed; a target close behind a hit says so late."""
        target, hit = max(state[0] - 1, 0), max(state[1] - 1, 0)
        if s == TARGET:
            return (NEAR_TARGET, 0), "late target" if state[1] else s
        if s[0] == "!":
            return (target, 2), f"{s}+target" if state[0] else s
        return (target, hit), s

    def negation(since: int, s: str) -> tuple[int, str]:
        if s == NEGATOR:
            return NEAR_NEGATOR, s
        if s[0] == "!" and since:
            return since - 1, s.split("+")[0] + "+negated"
        return max(since - 1, 0), s

    def reported(inside: int, s: str) -> tuple[int, str]:
        if s == REPORT:
            return 1, ""
        if s[0] == "!":
            label = s[1:]
            return inside, f"{label.split('+')[0]}+reported" if inside and "negated" not in label else label
        return inside, s if s in LABEL_WEIGHTS else ""

    machine = Transducer.built(0, base, threats)
    for start, step in ((0, insults), ((0, 0), targets), (0, negation), (0, reported)):
        machine = machine.then(Transducer.built(start, machine.outputs(), step))
    return machine


class Lexicon(dict):
    """(symbol, weight) of a word, looked up as it is, then by its longest known stem; what was looked up is kept."""

    KEPT = 200_000

    def __init__(self, weights: dict[str, float], threats: frozenset[str] = THREATS):
        super().__init__()
        self.weights = weights
        self.threats = threats
        self.stems = {k[:-1]: v for k, v in weights.items() if k.endswith(STEM)}
        self.longest = max(map(len, self.stems), default=0)
        self.shortest = min(map(len, self.stems), default=1)
        self.listed = {w: TARGET for w in TARGETS} | {w: NEGATOR for w in NEGATORS} | {w: REPORT for w in REPORTS}
        self.listed |= {w: INTENT for w in INTENTS}

    def __missing__(self, word: str) -> tuple[str, float]:
        if len(self) >= self.KEPT:
            self.clear()
        found = self[word] = self.read(word)
        return found

    def read(self, word: str) -> tuple[str, float]:
        if word in self.weights:
            return (THREAT if word in self.threats else INSULT), self.weights[word]
        for size in range(min(self.longest, len(word) - 1), self.shortest - 1, -1):
            if (stem := word[:size]) in self.stems:
                return (THREAT if stem + STEM in self.threats else INSULT), self.stems[stem]
        return self.listed.get(word, OTHER), 0.0


@dataclass
class Model:
    """Weight of each insult and threat word or stem, those that are threats, weight of each label, and the offset."""

    words: dict[str, float]
    threats: frozenset[str]
    labels: dict[str, float]
    offset: float


class Scorer:
    """Scores texts; made once per task."""

    def __init__(self, model: Model):
        self.model = model
        self.lexicon = Lexicon(model.words, model.threats)
        self.arcs = grammar().arcs

    def clause_hits(self, words: Iterable[str]) -> list[tuple[str, float]]:
        """(label, lexicon weight) of each hit of a clause."""
        state, found, last = 0, [], 0.0
        for word in words:
            symbol, weight = self.lexicon[word]
            state, out = self.arcs[state, symbol]
            if out:
                last = weight or last
                found.append((out, last))
        return found

    def has_hit(self, words: Iterable[str]) -> bool:
        lexicon = self.lexicon
        return any(lexicon[w][1] for w in words)

    def features(self, text: str) -> np.ndarray:
        """Lexicon weight per label, summed over clauses; each clause counts up to CLAUSE_MOST."""
        total = np.zeros(len(LABELS))
        lower = text.lower()
        if not self.has_hit(set(WORD.findall(lower))):
            return total
        for clause in CLAUSE_END.split(lower):
            words = WORD.findall(clause)
            if not self.has_hit(words):
                continue
            hits = self.clause_hits(words)
            size = sum(weight for _, weight in hits)
            scale = min(1.0, CLAUSE_MOST / size) if size else 0.0
            for label, weight in hits:
                total[LABELS.index(label)] += weight * scale
        return total

    def score(self, text: str) -> float:
        x = self.features(text)
        z = self.model.offset + sum(self.model.labels[label] * v for label, v in zip(LABELS, x))
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -40, 40))))


def keys_of(word: str) -> list[str]:
    """A word and its stems."""
    return [word, *(word[:n] + STEM for n in STEM_LETTERS if n < len(word))]


def _contexts(rows: DataFrame, known: frozenset[str] | None) -> DataFrame:
    """(word, context, intended): each distinct key of a text where it is first met, with its neighbours."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            words, contexts, intended = [], [], []
            for text in texts_of(batch):
                found = ["", *WORD.findall(text.lower()), ""]
                first: dict[str, str] = {}
                seen: set[str] = set()
                for before, word, after in zip(found, found[1:], found[2:]):
                    if word not in seen:
                        seen.add(word)
                        for key in keys_of(word):
                            if key not in first and (known is None or key in known):
                                first[key] = f"{before} {after}"
                words += first
                contexts += first.values()
                intended += [not INTENTS.isdisjoint(c.split(" ")[:1]) for c in first.values()]
            kinds = (pa.string(), pa.string(), pa.bool_())
            columns = [pa.array(c, k) for c, k in zip((words, contexts, intended), kinds)]
            return pa.RecordBatch.from_arrays(columns, names=["word", "context", "intended"])

        return work

    return over_texts(rows.select("text"), "text", make, "word string, context string, intended boolean")


def _met(rows: DataFrame, known: frozenset[str] | None = None) -> DataFrame:
    """(word, n, intended): the number of different contexts of each key, and how many say that it is meant to be done."""
    pairs = _contexts(rows, known).select("word", F.xxhash64("context").alias("context"), "intended").distinct()
    return pairs.groupBy("word").agg(F.count("*").alias("n"), F.count_if("intended").alias("intended"))


def learned_words(rows: DataFrame) -> tuple[dict[str, float], frozenset[str]]:
    """Words and stems met in toxic texts far more than elsewhere, with their log odds; and listed words that labels
    don't clear. Also those that are threats: listed ones, and learned ones that mostly follow a word of intent.

    Keys met often enough in toxic texts are counted in the others. At most SAMPLE_ROWS texts are counted, so the keys
    that come to the driver are bounded.
    """
    texts = rows.groupBy(F.xxhash64("text").alias("t")).agg(F.max("y").alias("y"))
    size = {r["y"]: r["n"] for r in texts.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = size.get(1, 0), size.get(0, 0)
    listed = INSULTS | THREATS
    words = dict.fromkeys(listed, LIST_WEIGHT)
    if not toxic or not clean:
        return words, THREATS
    often = _met(rows.where("y = 1")).where((F.col("n") >= LEAST_CONTEXTS) | F.col("word").isin(sorted(listed)))
    seen = often.collect()
    a = {r["word"]: r["n"] for r in seen}
    threats = THREATS | {r["word"] for r in seen if r["word"] not in INSULTS and 2 * r["intended"] > r["n"]}
    b = {r["word"]: r["n"] for r in _met(rows.where("y = 0"), frozenset(a) | listed).collect()}
    p = toxic / (toxic + clean)

    def odds(key: str) -> float:
        return float(np.log((a.get(key, 0) + 0.5) / (toxic + 1)) - np.log((b.get(key, 0) + 0.5) / (clean + 1)))

    def ratio(key: str) -> float:
        x, y = a[key], b.get(key, 0)
        n = x + y
        return 2 * (x * np.log(x / (n * p)) + (y * np.log(y / (n * (1 - p))) if y else 0.0))

    good = {k for k, n in a.items() if n >= LEAST_CONTEXTS and odds(k) > 1 and ratio(k) >= LEAST_RATIO}
    # a stem gives way to what holds nearly all of it
    whole = {k.rstrip(STEM)[:n] + STEM for k in good for n in STEM_LETTERS if n < len(k.rstrip(STEM)) and a[k] >= STEM_SHARE * a.get(k.rstrip(STEM)[:n] + STEM, np.inf)}
    for key in (good - whole) | {w for w in listed if a.get(w, 0) + b.get(w, 0) >= LEAST_CONTEXTS}:
        words[key] = odds(key)
    return {w: v for w, v in words.items() if v > 0}, threats


def _fit(x: np.ndarray, y: np.ndarray, times: np.ndarray) -> tuple[dict[str, float], float]:
    """Scale and offset of the grammar's weights by logistic regression; row i counts ``times[i]`` times.

    One scale for all labels: what the grammar says of a negated, a reported or an aimed hit against a plain one holds
    after training as before.
    """
    said = x @ np.array([*LABEL_WEIGHTS.values()])
    design = np.stack([said, np.ones(len(said))], axis=1)
    prior, pull = np.array([1.0, -3.0]), np.array([RIDGE, 0.01])

    def loss(w: np.ndarray) -> float:
        z = design @ w
        return float(times @ (np.logaddexp(0, z) - y * z) + 0.5 * pull @ (w - prior) ** 2)

    w = prior.copy()
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -40, 40)))
        gradient = design.T @ (times * (p - y)) + pull * (w - prior)
        curve = (design * (times * p * (1 - p))[:, None]).T @ design + np.diag(pull)
        step = np.linalg.solve(curve, gradient)
        # far from the best place a whole step may overshoot
        share = 1.0
        while share > 1e-6 and loss(w - share * step) > loss(w) - 1e-4 * share * float(gradient @ step):
            share /= 2
        w = w - share * step
        if np.abs(share * step).max() < 1e-7:
            break
    scale = max(float(w[0]), 0.0)
    return {label: scale * weight for label, weight in LABEL_WEIGHTS.items()}, float(w[1])


def train(documents: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> Model:
    """Lexicon and weights from at most ``most`` labelled rows outside the held-out fold.

    Features of the sample, a few numbers per row, come to the driver; texts do not. Without labels of both kinds the
    lists and the grammar's weights stand as they are.
    """
    rows = labelled_sample(documents, labels, "toxic", FOLDS, HELD_OUT, most)
    words, threats = learned_words(rows)
    start = Model(words, threats, LABEL_WEIGHTS, 0.0)

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        scorer = Scorer(start)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = [scorer.features(t).tolist() for t in texts_of(batch)]
            return with_columns(batch, ["y", "n"], x=pa.array(x, pa.list_(pa.float64())))

        return work

    sized = over_texts(rows, "text", make, "y int, n long, x array<double>")
    # equal features of the sample come as one with a count: what is collected stays small
    found = sized.groupBy("y", "x").agg(F.sum("n").alias("n")).orderBy("y", "x").collect()
    if len({r["y"] for r in found}) < 2:
        return Model(words, threats, dict(LABEL_WEIGHTS), -3.0)
    x, y, times = (np.array([r[c] for r in found], float) for c in ("x", "y", "n"))
    weights, offset = _fit(x, y, times)
    return Model(words, threats, weights, offset)


def score(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted) per row of ``documents`` (doc_id, text); whole texts, null as empty.

    A text without hits, the empty one included, has the score of the offset. Repeated rows each come back; doc_id may be
    null; other columns are ignored.
    """

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        scorer = Scorer(model)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = np.array([scorer.score(t) for t in texts_of(batch)])
            return with_columns(
                batch, ["doc_id"], score=pa.array(found), predicted=pa.array((found >= 0.5).astype(np.int32))
            )

        return work

    kind = documents.schema["doc_id"].dataType.simpleString()
    return over_texts(documents.select("doc_id", "text"), "text", make, f"doc_id {kind}, score double, predicted int")


def without_toxic(documents: DataFrame, model: Model) -> DataFrame:
    """``documents`` without the rows predicted toxic; all columns come through, whatever their names."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        scorer = Scorer(model)
        return lambda batch: batch.filter(pa.array([scorer.score(t) < 0.5 for t in texts_of(batch)], pa.bool_()))

    return over_texts(documents, "text", make, documents.schema)
