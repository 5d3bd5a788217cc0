"""Token ids of texts through a public tokenizer, each distinct word encoded once per task."""

from __future__ import annotations

import json
import os
import re
import sys
from itertools import chain

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Steps of the tokenizer file for which words can be encoded one by one: blanks fold and cut, letters are composed and
#: lower-cased one by one, and runs of letters, single digits and runs of marks are encoded apart.
NORMALIZER = ["NFC", "Replace", "Lowercase"]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same cut, for texts of PLAIN characters, with line ends kept.
CUT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+|\n")
#: Not of these: ASCII text and composed Latin letters, on which both cuts and both ways to lower case agree.
ODD = re.compile("[^\t\n\r -~À-ÖØ-öø-ɏ]|İ")
END = np.uint32(0xFFFFFFFF)
#: Words and parts of words a task keeps the ids of, and parts encoded at once.
KEPT = 600_000
AT_ONCE = 4_096


class WordIds:
    """Ids of texts as little-endian 32-bit bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks of a machine in parallel
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as source:
            spec = json.load(source)
        steps = (spec.get("normalizer") or {}).get("normalizers", [])
        cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.by_word = (
            [s["type"] for s in steps] == NORMALIZER
            and [c["type"] for c in cuts] == ["Split", "ByteLevel"]
            and cuts[0]["pattern"].get("Regex") == PATTERN
            and spec["model"].get("end_of_word_suffix") == "</w>"
        )
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # bytes without a glyph of their own stand in the vocabulary as characters from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in plain]
        self.glyphs = {b: chr(256 + n) for n, b in enumerate(others) if b != 32}
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def of(self, texts: list[str]) -> list[bytes]:
        """Ids of each text."""
        if not self.by_word:
            return [self.whole(t) for t in texts]
        cut = [t.replace("\n", " ").split(" ") for t in texts]
        met = set().union(*cut)
        new = met.difference(self.words)
        if new:
            if len(self.words) > KEPT:
                self.words, new = {}, met
            self.learn(list(new))
        return [b"".join(map(self.words.__getitem__, words)) for words in cut]

    def learn(self, new: list[str]) -> None:
        """Look up words: plain ones by their parts, the others whole."""
        line = "\n".join(new)
        if ODD.search(line) or any(s in line for s in self.special):
            plain = []
            for word in new:
                if ODD.search(word) or any(s in word for s in self.special):
                    self.words[word] = self.whole(word)
                else:
                    plain.append(word)
            new, line = plain, "\n".join(plain)
        cut = CUT.findall(line.lower())
        self.learn_parts(set(cut))
        data = b"".join(map(self.parts.__getitem__, cut))
        ends = np.append(np.flatnonzero(np.frombuffer(data, "<u4") == END) * 4, len(data))
        starts = np.concatenate([[0], ends[:-1] + 4])
        self.words.update(zip(new, map(data.__getitem__, map(slice, starts.tolist(), ends.tolist()))))

    def learn_parts(self, parts: set[str]) -> None:
        if len(self.parts) > KEPT:
            self.parts = {}
        new = parts.difference(self.parts.keys(), ["\n"])
        self.parts["\n"] = END.tobytes()
        ascii_parts = sorted(filter(str.isascii, new))
        for kind in (ascii_parts, sorted(new.difference(ascii_parts))):
            for start in range(0, len(kind), AT_ONCE):
                self.encode_parts(kind[start : start + AT_ONCE])

    def encode_parts(self, some: list[str]) -> None:
        line = " ".join(some)
        if not line.isascii():
            line = line.encode("utf-8").decode("latin-1").translate(self.glyphs)
        ids = np.array(self.bare.encode_batch_fast([line], add_special_tokens=False)[0].ids, "<u4")
        ends = (np.flatnonzero(self.ends[ids]) + 1) * 4
        if len(ends) != len(some):
            self.parts.update((p, self.whole(p)) for p in some)
            return
        data = ids.tobytes()
        starts = np.concatenate([[0], ends[:-1]])
        self.parts.update(zip(some, map(data.__getitem__, map(slice, starts.tolist(), ends.tolist()))))
