"""Token counts, SentencePiece and packing against brute force."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lexloom.llm import packing, sentencepiece, token_counts
from lexloom.llm.pieces import BYTE_SCORE, COARSE, FINE, SPACE, Pieces, load_pieces, pretoken_pattern, pretokens
from lexloom.llm.word_ids import WordIds

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD_TEXTS = [
    "",
    " ",
    "a",
    "two  blanks   here ",
    " lead",
    "line\nend\n\n",
    "tab\there\r\n",
    "漢字 and 𝔘 and é",
    "x,y;z ### a1b2 (c)",
    "ΑΣ ΣΑΣ It's we'LL 'S a_b",
    "<|endoftext|> a<|startoftext|>b",
    "İstanbul ǅ x² a b",
    "\x1c\x1d a\x85b",
    "nul\0in",
    SPACE,
    "word " * 300,
]


@pytest.fixture(scope="module")
def pieces():
    return load_pieces(PIECE_MODEL)


def viterbi(text, pieces):
    """Best path over the whole text, no cuts: (score, count), and the ids of a best path."""
    s = (" " + text).replace(" ", SPACE)
    best = [(0.0, 0)] + [(-np.inf, 0)] * len(s)
    back = [None] * (len(s) + 1)
    for e in range(1, len(s) + 1):
        edges = [(b, pieces.scores[s[b:e]], [pieces.ids[s[b:e]]]) for b in range(max(0, e - pieces.longest), e) if s[b:e] in pieces.ids]
        if s[e - 1] not in pieces.ids:
            raw = s[e - 1].encode()
            edges.append((e - 1, BYTE_SCORE * len(raw), [pieces.bytes_[x] for x in raw]))
        for b, score, ids in edges:
            key = (best[b][0] + score, -(best[b][1] + len(ids)))
            if key > (best[e][0], -best[e][1]):
                best[e], back[e] = (key[0], -key[1]), (b, ids)
    ids, e = [], len(s)
    while e:
        e, found = back[e][0], back[e][1]
        ids = found + ids
    return best[-1][0], ids


def score_of(ids, pieces):
    surface = {i: p for p, i in pieces.ids.items()}
    return sum(pieces.scores[surface[i]] if i in surface else BYTE_SCORE for i in ids)


def unpack(data):
    return np.frombuffer(data, "<u4").tolist()


@given(st.text(alphabet="abé ,.#1\n\t漢", max_size=40))
@settings(max_examples=150, deadline=None)
def test_pretokens_are_the_text(text):
    for pattern in (FINE, COARSE):
        assert "".join(pretokens(text, pattern)) == (" " + text if text else "")


def test_encoding_is_a_best_path(pieces):
    rng = random.Random(6)
    texts = [t for t in ODD_TEXTS if "\0" not in t]
    texts += ["".join(rng.choices("abcdeth ,.\n", k=rng.randint(1, 60))) for _ in range(60)]
    encoder = sentencepiece.Encoder(pieces)
    for text, data in zip(texts, encoder.encode(texts)):
        ids = unpack(data)
        if not text:
            assert ids == []
            continue
        score, _ = viterbi(text, pieces)
        assert score_of(ids, pieces) == pytest.approx(score, abs=1e-6), text


def test_batches_and_index_sizes_do_not_matter(pieces, monkeypatch):
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choices("aeioustrn", k=rng.randint(1, 9))) for _ in range(40)) for _ in range(12)]
    whole = sentencepiece.Encoder(pieces).encode(texts)
    monkeypatch.setattr(sentencepiece, "INDEX_CHARS", 50)
    monkeypatch.setattr(sentencepiece, "WORDS_KEPT", 5)
    encoder = sentencepiece.Encoder(pieces)
    assert [encoder.encode([t])[0] for t in texts] == whole


def test_round_trip(pieces):
    texts = [t for t in ODD_TEXTS if SPACE not in t]
    encoder, decoder = sentencepiece.Encoder(pieces), sentencepiece.Decoder(pieces)
    assert [decoder.decode(b) for b in encoder.encode(texts)] == texts


def test_suffix_array():
    codes = np.array([3, 1, 2, 1, 2, 1], np.uint8)
    order = sentencepiece.suffix_array(sentencepiece.windows(codes, 6))
    suffix = [codes[i:].tolist() for i in order]
    assert suffix == sorted(suffix)


def test_occurrences_equal_a_scan(pieces):
    text = "the theatre then\0there"
    start, piece = sentencepiece.Encoder(pieces).occurrences(sentencepiece.codes_of(text))
    ordered = sorted(pieces.ids)
    found = sorted((int(s), ordered[p]) for s, p in zip(start, piece))
    assert found == sorted((i, p) for p in pieces.ids for i in range(len(text)) if text.startswith(p, i))


def test_counts_equal_a_best_path(pieces):
    trie = token_counts.Trie(pieces)
    pattern = pretoken_pattern(pieces)
    for text in ODD_TEXTS:
        if text and "\0" not in text:
            score, ids = viterbi(text, pieces)
            assert sum(trie.count(w) for w in pretokens(text, pattern)) == len(ids), text


def test_shared_prefixes_are_computed_once(pieces):
    trie = token_counts.Trie(pieces)
    trie.insert("abcdef")
    size = len(trie.score)
    trie.insert("abcdeg")
    assert len(trie.score) == size + 1


def test_trie_starts_anew(pieces, monkeypatch):
    words = [" word", " other", " words", " world"]
    plain = [token_counts.Trie(pieces).count(w) for w in words]
    monkeypatch.setattr(token_counts, "NODES_KEPT", 6)
    trie = token_counts.Trie(pieces)
    assert [trie.count(w) for w in words] == plain


def test_letter_mark_pieces_need_the_coarse_cut():
    assert pretoken_pattern(Pieces({"a,": 1}, {"a,": -1.0}, [], 2)) is COARSE
    assert pretoken_pattern(Pieces({"a": 1}, {"a": -1.0}, [], 1)) is FINE


def frame(spark, texts):
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)]
    rows += [(None, "no id", None, None), (5, None, "y", 2), (5, None, "y", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, length int")


def test_operators_on_odd_rows(spark, pieces):
    texts = [t for t in ODD_TEXTS if "\0" not in t]
    docs = frame(spark, texts)
    counted = token_counts.token_counts(docs, PIECE_MODEL).collect()
    encoded = sentencepiece.encode(docs, PIECE_MODEL)
    sizes = sorted(len(r["ids"]) for r in encoded.collect())
    assert sorted(r["n_tokens"] for r in counted) == sizes and len(sizes) == len(texts) + 3
    decoded = sorted(r["text"] for r in sentencepiece.decode(encoded, PIECE_MODEL).collect())
    assert decoded == sorted([t.replace(SPACE, " ") for t in texts] + ["no id", "", ""])
    digest = sentencepiece.digests(docs, PIECE_MODEL).collect()
    assert sum(not r["round_trip"] for r in digest) == 1  # the text that holds the mark
    for op in (token_counts.token_counts, sentencepiece.encode, sentencepiece.digests):
        assert op(docs.limit(0), PIECE_MODEL).count() == 0


# Packing ---------------------------------------------------------------------------------------------------------------


def plain_ids(text):
    return Tokenizer.from_file(WORD_TOKENIZER).encode(text, add_special_tokens=False).ids


def test_word_ids_equal_the_tokenizer():
    rng = random.Random(9)
    texts = ODD_TEXTS + [" ".join("".join(rng.choices("aB,é#1'sTñ", k=rng.randint(1, 12))) for _ in range(50)) for _ in range(20)]
    known = WordIds(WORD_TOKENIZER)
    assert known.by_word
    assert [unpack(b) for b in known.of(texts)] == [plain_ids(t) for t in texts]
    known.by_word = False
    assert [unpack(b) for b in known.of(texts[:8])] == [plain_ids(t) for t in texts[:8]]


def slow_rule(lengths, most):
    """The rule as it is worded, on a list of gaps."""
    gaps = []
    made = 0
    for s in sorted(lengths, reverse=True):
        fits = sorted({g for g in gaps if g >= s})
        if not fits:
            made += 1
            gaps += [most - s] * (most > s)
            continue

        def after(g):
            rest = list(gaps)
            rest.remove(g)
            rest += [g - s] * (g > s)
            return sum(rest.count(x) ** 2 for x in set(rest))

        best = min(fits, key=lambda g: (after(g), g))
        gaps.remove(best)
        gaps += [best - s] * (best > s)
    return made, sorted(gaps)


@given(st.lists(st.integers(1, 12), max_size=30))
@settings(max_examples=120, deadline=None)
def test_sum_of_squares_rule(lengths):
    sizes = np.array(lengths, np.int64)
    sequence, offset = packing.sum_of_squares(sizes, 12)
    made, gaps = slow_rule(lengths, 12)
    used = np.bincount(sequence, sizes, minlength=made).astype(int) if lengths else np.zeros(0, int)
    assert len(used) == made and sorted(12 - u for u in used if u < 12) == gaps
    for number in range(made):
        rows = sorted(zip(offset[sequence == number].tolist(), sizes[sequence == number].tolist()))
        at = 0
        for o, s in rows:
            assert o == at
            at += s


def test_pack_holds_every_token_once(spark):
    rng = random.Random(10)
    texts = [t for t in ODD_TEXTS if "\0" not in t]
    texts += [" ".join("".join(rng.choices("aeioustrn", k=4)) for _ in range(rng.choice([5, 60, 900]))) for _ in range(40)]
    docs = frame(spark, texts)
    rows = packing.pack(docs, WORD_TOKENIZER, most=256, part_pieces=20).collect()
    wanted = []
    for doc, text in [(r["doc_id"], r["text"] or "") for r in docs.collect()]:
        ids = [*plain_ids(text), 0]
        for k, low in enumerate(range(0, len(ids), 256)):
            part = ids[low : low + 256]
            wanted.append((doc, k, low, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    got = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows]
    assert sorted(got, key=str) == sorted(wanted, key=str)
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for place in places.values():
        at = 0
        for offset, length in sorted(place):
            assert offset == at
            at += length
        assert at <= 256
    assert len(places) <= -(-sum(r["length"] for r in rows) // 256) + 8


def test_pack_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(docs, WORD_TOKENIZER).count() == 0


@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrstuvwxyz", "ther", "é漢a"])
def test_words_alone_are_encoded_as_with_others(pieces, letters, monkeypatch):
    rng = random.Random(len(letters))
    monkeypatch.setattr(sentencepiece, "INDEX_CHARS", 50)
    encoder = sentencepiece.Encoder(pieces)
    trie = token_counts.Trie(pieces)
    for size in (1, 2, 49, 50, 51, 100, 333, 1000):
        word = "".join(rng.choices(letters, k=size))
        score, ids = viterbi(word, pieces)
        alone = unpack(encoder.alone(" " + word))
        assert alone == unpack(encoder.encode([word])[0]) and score_of(alone, pieces) == pytest.approx(score)
        assert trie.alone(SPACE + word) == trie.count(" " + word) == len(ids)


def test_four_million_letters_in_one_word(pieces):
    """Time and memory follow the length."""
    import time
    import tracemalloc

    word = "".join(random.Random(1).choices("etaoinshrdlu", k=4_000_000))
    trie = token_counts.Trie(pieces)
    started = time.perf_counter()
    count = trie.count(" " + word)
    assert time.perf_counter() - started < 30 and len(trie.score) == 1
    tracemalloc.start()
    trie.alone(word[:200_000])
    assert tracemalloc.get_traced_memory()[1] < 5_000_000
    tracemalloc.stop()
    encoder = sentencepiece.Encoder(pieces)
    started = time.perf_counter()
    ids = unpack(encoder.encode([word])[0])
    assert time.perf_counter() - started < 45 and len(ids) == count
    surface = pieces.surface()
    assert b"".join(surface[i] for i in ids).decode().replace(SPACE, " ") == " " + word
