"""Byte-level BPE against the library of the same ranks."""

import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lexloom.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def vocabulary():
    return byte_bpe.load_vocabulary(PATH)


@pytest.fixture(scope="module")
def encoder(vocabulary):
    return byte_bpe.Encoder(vocabulary, PATTERN)


def ids_of(encoder, texts):
    return [[int(x) for block in blocks for word in block for x in word.split()] for blocks in encoder.encoded(texts)]


@given(st.lists(st.text(alphabet="abthe nr'sd1é漢字\n\t😀!?#\x1c\x85　\0", max_size=60), max_size=8))
@settings(max_examples=200, deadline=None)
def test_ids_are_the_library_s(encoder, library, texts):
    assert ids_of(encoder, texts) == [library.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrstuvwxyz", "ther", "a", "é漢ü", "-=_*", "0123456789"])
def test_long_rows_merge_in_the_same_order(encoder, library, letters):
    rng = random.Random(letters)
    words = ["".join(rng.choices(letters, k=n)) for n in (2, 3, 17, 200, 513, 3000, 20000)]
    assert ids_of(encoder, words) == [library.encode_ordinary(w) for w in words]
    for word in words[:4]:
        raw = word.encode()
        if raw not in encoder.whole:
            start = encoder.vocabulary.bytes_[list(raw)]
            assert encoder.merge_long(start).tolist() == library.encode_ordinary(word)


def test_a_lower_rank_may_appear_in_the_middle_of_a_round():
    """Merging ab brings abc, of lower rank than ab, which goes before the next ab."""
    singles = {bytes([b]): 1000 + b for b in range(256)}
    ranks = singles | {b"ab": 20, b"abc": 10, b"cab": 15, b"abcab": 12}
    vocabulary = byte_bpe.Vocabulary([b""], *[None] * 3)
    import tempfile

    with tempfile.NamedTemporaryFile("wb", suffix=".ranks", delete=False) as out:
        for token, rank in ranks.items():
            out.write(base64.b64encode(token) + b" " + str(rank).encode() + b"\n")
    vocabulary = byte_bpe.load_vocabulary(out.name)
    encoder = byte_bpe.Encoder(vocabulary, PATTERN)
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    for _ in range(300):
        word = "".join(rng.choices("abc", k=rng.randint(2, 40)))
        if word.encode() in ranks:
            continue
        wanted = library.encode_ordinary(word)
        assert encoder.merged([word.encode()])[0].tolist() == wanted
        assert encoder.merge_long(vocabulary.bytes_[list(word.encode())]).tolist() == wanted


def test_four_million_letters(encoder, vocabulary):
    rng = random.Random(8)
    word = "".join(rng.choices("etaoinshrdlu", k=4_000_000))
    ids = ids_of(byte_bpe.Encoder(vocabulary, PATTERN), [word])[0]
    assert byte_bpe.Decoder(vocabulary).data(ids) == word.encode()


def test_long_texts_pass_in_blocks(monkeypatch, vocabulary, library):
    monkeypatch.setattr(byte_bpe, "WORDS_AT_ONCE", 50)
    monkeypatch.setattr(byte_bpe, "KEPT_CHARS", 100)
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choices("thenrs", k=rng.randint(1, 9))) for _ in range(n)) for n in (0, 3, 500, 40)]
    assert ids_of(byte_bpe.Encoder(vocabulary, PATTERN), texts) == [library.encode_ordinary(t) for t in texts]


ROWS = [
    (1, "The cat's ranks, été 漢字", "x"),
    (1, "The cat's ranks, été 漢字", "x"),
    (None, "no id", "y"),
    (3, None, "z"),
    (4, "", "z"),
    (5, " \n\n  trailing  ", None),
    (6, "nul\0in <|endoftext|>", None),
]


def test_digests(spark, library):
    rows = spark.createDataFrame(ROWS, "doc_id long, text string, n_tokens string")
    found = byte_bpe.digests(rows, PATH, PATTERN)
    wanted = []
    for key, text, _ in ROWS:
        ids = library.encode_ordinary(text or "")
        sha = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        wanted.append((key, len(ids), sha, hashlib.sha256((text or "").encode()).hexdigest()))
    order = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, found.collect()), key=order) == sorted(wanted, key=order)
    assert byte_bpe.digests(rows.where("false"), PATH, PATTERN).count() == 0


def test_encode_then_decode(spark, library):
    rows = spark.createDataFrame(ROWS, "doc_id long, text string, ids string")
    encoded = byte_bpe.encode(rows, PATH, PATTERN)
    ids = {r["doc_id"]: r["ids"] for r in encoded.collect()}
    assert ids[1] == library.encode_ordinary(ROWS[0][1]) and ids[3] == ids[4] == []
    data = {r["doc_id"]: bytes(r["data"]) for r in byte_bpe.decode(encoded, PATH).collect()}
    assert data == {key: (text or "").encode() for key, text, _ in ROWS}
    odd = spark.createDataFrame([(1, None), (2, [None, 64])], "doc_id long, ids array<int>")
    assert [bytes(r["data"]) for r in byte_bpe.decode(odd, PATH).orderBy("doc_id").collect()] == [b"", b"a"]
