"""The pieces of a public SentencePiece vocabulary and a unigram score for each."""

from __future__ import annotations

import math
import re
import sys
from dataclasses import dataclass

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Stands for a blank.
SPACE = "▁"
#: Score of a byte, for characters that no piece holds: below that of any piece.
BYTE_SCORE = -30.0


@dataclass
class Pieces:
    """Ids and scores of pieces, ids of bytes."""

    ids: dict[str, int]
    scores: dict[str, float]
    bytes_: list[int]
    longest: int

    def surface(self) -> dict[int, bytes]:
        """The bytes each id stands for."""
        found = {i: p.encode("utf-8") for p, i in self.ids.items()}
        return found | {i: bytes([b]) for b, i in enumerate(self.bytes_)}


def load_pieces(path: str) -> Pieces:
    """Pieces of a model file. The vocabulary is ranked by frequency, so the score of the piece of rank r is the log of
    its share under Zipf's law, 1 / (r H); control pieces and bytes are none."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    normal = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    total = math.log(sum(1 / r for r in range(1, len(normal) + 1)))
    ids = {model.id_to_piece(i): i for i in normal}
    scores = {model.id_to_piece(i): -math.log(r) - total for r, i in enumerate(normal, 1)}
    return Pieces(ids, scores, [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], max(map(len, ids)))


#: Pre-tokens are blanks with what follows up to white space, or other white space. FINE also cuts between a Latin
#: letter and an ASCII mark or digit.
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
MARKS = r"!-@\[-`{-~"
FINE = re.compile(rf" *[{MARKS}]*[{LETTERS}]+(?=[{MARKS}\s]|\Z)| *[{MARKS}]+(?=\s|\Z)| *\S+| +|[^\S ]+")
COARSE = re.compile(r" *\S+| +|[^\S ]+")
#: What a piece that spans a cut of FINE holds.
LETTER_THEN_MARK = re.compile(rf"[{LETTERS}][{MARKS}]")


def pretoken_pattern(pieces: Pieces) -> re.Pattern:
    """The finest cut that no piece spans. Pieces that span a blank cut are not matched, as in pre-tokenized training."""
    return COARSE if any(map(LETTER_THEN_MARK.search, pieces.ids)) else FINE


def pretokens(text: str, pattern: re.Pattern) -> list[str]:
    """A text behind one added blank, cut in pre-tokens; joined they are the text. An empty text has none."""
    return pattern.findall(" " + text) if text else []
