"""Queries without SQL against plain restatements of their rules on random small inputs."""

import random
import re

from pyspark.sql import functions as F

from lexloom.functions import fixed_values as fv
from lexloom.functions import script
from lexloom.operators import reconcile

SIGNS, LETTERS = fv.VOWEL_SIGNS, "कखगमर"


def damaged(rng, n):
    pool = list(LETTERS * 3) + list("ािीु") + [fv.VIRAMA, fv.NUKTA, " ", " ", "|", "a", ".", "�", "‌", "1"]
    return "".join(rng.choice(pool) for _ in range(n))


def is_deva(ch):
    return "ऀ" <= ch <= "ॿ"


def opens_word(text, i):
    for ch in reversed(text[:i]):
        if ch.isspace():
            return True
        if is_deva(ch) or ch in ".,;:()[]\"'" or ch.isdigit():
            return False
    return True


def offences(text):
    out = []
    for i, ch in enumerate(text):
        prev = text[i - 1] if i else ""
        if ch == "�":
            out.append((i, "replacement"))
        elif ch == "‌":
            out.append((i, "zwnj"))
        elif ch == "|":
            left, right = text[max(0, i - 3) : i].rstrip(), text[i + 1 : i + 4].lstrip()
            if (left and is_deva(left[-1])) or (right and is_deva(right[0])):
                out.append((i, "pipe-danda"))
        elif ch in SIGNS and opens_word(text, i):
            out.append((i, "sign-at-start"))
        elif (ch in SIGNS and prev and prev in SIGNS + fv.VIRAMA) or (ch == fv.NUKTA and prev and prev in SIGNS):
            out.append((i, "sign-after-sign"))
    return out


def repaired(text):
    text = text.replace("‌", "")
    text = re.sub(r"([ऀ-ॿ])\s*\|", "\\1 ।", text)
    text = re.sub(r"\|\s*([ऀ-ॿ])", "। \\1", text)
    found = offences(text)
    while True:
        for i, rule in found:
            if not rule.startswith("sign") or not ("क" <= text[i + 1 : i + 2] <= "ह"):
                continue
            moved = text[:i] + text[i + 1] + text[i] + text[i + 2 :]
            if len(offences(moved)) < len(found):
                text, found = moved, offences(moved)
                break
        else:
            return text


def test_issues_and_repair(spark):
    rng = random.Random(11)
    texts = [damaged(rng, rng.randint(0, 60)) for _ in range(400)] + [damaged(rng, 3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = df.select("i", script.issues(F.col("t")).alias("found"), script.repair(F.col("t")).alias("fixed")).collect()
    for r in rows:
        text = texts[r.i]
        assert [(f["index"], f["rule"]) for f in r.found] == offences(text), repr(text)
        assert all(f["excerpt"] == text[max(0, f["index"] - 4) : f["index"] + 5] for f in r.found)
        if len(text) < 100:
            assert r.fixed == repaired(text), repr(text)


NUMBERED = re.compile(r"\[?\((\d{1,2}[क-ह]?|[क-ह])\)\s*")


def cut(text):
    clean = re.sub(r"\s+", " ", re.sub(r"\(\s*[|।]?\s*\)\s*", " ", text)).strip()

    def after_boundary(at):
        left = clean[:at]
        left = left[:-1] if left.endswith("[") else left
        left = left.rstrip()
        return left == "" or left[-1] in "।;:,–—]-)" or left.endswith("और")

    cuts = [(m.start(), m.end(), m.group(1), "clause") for m in NUMBERED.finditer(clean) if after_boundary(m.start())]
    for pattern, kind in ((r"(?:^|\s)स्पष्टीकरण[-\s]", "explanation"), (r"(?:^|\s)(?:उदाहरण|दृष्टांत)[-\s]", "illustration")):
        m = re.search(pattern, clean)
        if m and after_boundary(m.start()):
            cuts.append((m.start(), m.start() + clean[m.start()].isspace(), None, kind))
    cuts.sort()
    out = [(None, clean[: cuts[0][0] if cuts else len(clean)].rstrip(" ;"), "clause")]
    for k, (_, end, number, kind) in enumerate(cuts):
        stop = cuts[k + 1][0] if k + 1 < len(cuts) else len(clean)
        out.append((number, clean[end:stop].lstrip("-–— ").rstrip(" ;"), kind))
    return [c for c in out if c[1]]


def test_inline_clauses(spark):
    rng = random.Random(12)
    pool = ["राज्य", "खंड", "विधि", "।", ";", "और", "(1)", "(2)", "(1क)", "(क)", "[(3)", "के", "अधीन", "-", ",", "]", "स्पष्टीकरण-", "उदाहरण", "()"]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randint(0, 25))) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in df.select("i", script.inline_clauses(F.col("t")).alias("c")).collect():
        assert [(c["number"], c["text"], c["kind"]) for c in r.c] == cut(texts[r.i]), repr(texts[r.i])


# --- fusion -------------------------------------------------------------------


def letters(word):
    return re.sub(f"[^{fv.SKELETON_CLASS}]", "", word)


def tokens(text):
    out = []
    for n, line in enumerate(text.split("\n")):
        for word in line.split():
            if out and re.fullmatch(r"[\s|.,;:()\[\]'\"–—]+", word):
                out[-1][0] += word
            else:
                out.append([word, n])
    return out


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def fused(ocr, layer):
    a, b = tokens(ocr), tokens(layer)
    anchors = reconcile.common_subsequence([letters(w) for w, _ in a], [letters(w) for w, _ in b])
    pairs, pi, pj = [], 0, 0
    for i, j in [*anchors, (len(a), len(b))]:
        left, right = a[pi:i], b[pj:j]
        for k in range(max(len(left), len(right))):
            x, y = left[k] if k < len(left) else None, right[k] if k < len(right) else None
            if k < min(len(left), len(right)):
                u, v = letters(x[0]), letters(y[0])
                alike = u == v == "" or distance(u, v) <= max(2, min(len(u), len(v)) // 3)
                pairs += [(x, y)] if alike else [(x, None), (None, y)]
            else:
                pairs.append((x, y))
        if i < len(a):
            pairs.append((a[i], b[j]))
        pi, pj = i + 1, j + 1
    lines, flags = {}, 0
    for x, y in pairs:
        bad_x, bad_y = bool(x and offences(x[0])), bool(y and offences(y[0]))
        if y is None:
            taken, flag = x, True
        elif x is None:
            taken, flag = (None if bad_y else y), True
        elif x[0] == y[0]:
            taken, flag = y, False
        elif letters(x[0]) == letters(y[0]):
            taken, flag = (y, False) if not bad_y else (x, True) if not bad_x else (y, True)
        else:
            taken, flag = (x if not bad_x or bad_y else y), True
        flags += flag
        if taken is not None:
            lines.setdefault((y or x)[1], []).append(taken[0])
    return "\n".join(" ".join(lines[n]) for n in sorted(lines)), flags


def test_fusion(spark):
    rng = random.Random(13)

    def noisy(words):
        out = []
        for w in words:
            if rng.random() < 0.1:
                continue
            out.append(damaged(rng, rng.randint(1, 5)).strip() or w if rng.random() < 0.15 else w)
            if rng.random() < 0.1:
                out.append(rng.choice(["|", ",", "12", "x।"]))
        return "".join(w + rng.choice([" ", " ", " ", "\n"]) for w in out)

    cases = []
    for i in range(150):
        words = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, 30))]
        cases.append((i, noisy(words), noisy(words)))
    df = spark.createDataFrame(cases, "i int, a string, b string")
    for r in reconcile.fuse(df, "a", "b").collect():
        assert (r.text, len(r.flags)) == fused(r.a, r.b), (r.a, r.b)
