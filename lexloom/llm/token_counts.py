"""Token counts of documents under a unigram model, by a trie of pre-tokens.

A task inserts its distinct pre-tokens in a trie. A node stands for a prefix and holds the prefix's forward score, the
best sum of piece scores that spells it, and how many pieces that takes; both follow from the node's ancestors, so a
prefix that many pre-tokens share is computed once. The count at a terminal is the pre-token's, and a document's count is
the sum over its pre-tokens.
"""

from __future__ import annotations

import math
import sys
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from .common import over_texts, texts_of, with_columns
from .pieces import BYTE_SCORE, SPACE, Pieces, load_pieces, pretoken_pattern, pretokens

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Nodes a task's trie may hold, and terminals it keeps at hand, before both start anew.
NODES_KEPT = 600_000
TERMINALS_KEPT = 400_000
#: Characters of the longest word that is put in the trie.
TRIE_CHARS = 4096

#: Stands for an ending that no piece has.
NONE = math.nan


class Trie:
    """Forward scores of prefixes: ``score[n]`` and ``pieces[n]`` of node n, 0 the root."""

    def __init__(self, pieces: Pieces):
        # endings of pieces: a score where the ending is a piece itself; no piece ends in what is missing
        self.endings: dict[str, float | None] = {p[i:]: None for p in pieces.scores for i in range(len(p))}
        self.endings |= pieces.scores
        self.reach = pieces.longest + 1
        self.clear()

    def clear(self) -> None:
        self.children: dict[tuple[int, str], int] = {}
        self.score, self.pieces = [0.0], [0]
        self.known: dict[str, int] = {}

    def insert(self, word: str) -> int:
        """Add a pre-token and give its count of pieces."""
        at, path = 0, [0]
        score, pieces, children, endings = self.score, self.pieces, self.children, self.endings
        for end, c in enumerate(word, 1):
            node = children.get((at, c))
            if node is None:
                node = children[at, c] = len(score)
                best, count = -math.inf, 0
                start = end - 1
                while start >= 0:
                    value = endings.get(word[start:end], NONE)
                    if value is NONE:
                        break
                    if value is not None:
                        before = path[start]
                        whole = score[before] + value
                        if whole > best or whole == best and pieces[before] < count - 1:
                            best, count = whole, pieces[before] + 1
                    start -= 1
                if best == -math.inf:  # no piece ends here: the character's bytes
                    size = len(c.encode("utf-8", "surrogatepass"))
                    best, count = score[at] + BYTE_SCORE * size, pieces[at] + size
                score.append(best)
                pieces.append(count)
            at = node
            path.append(at)
        return pieces[at]

    def alone(self, word: str) -> int:
        """Pieces of a word too long to share prefixes: the same scores, kept as far back as a piece reaches."""
        endings, reach = self.endings, self.reach
        score, pieces, base = [0.0], [0], 0
        for end, c in enumerate(word, 1):
            best, count = -math.inf, 0
            start = end - 1
            while start >= 0:
                value = endings.get(word[start:end], NONE)
                if value is NONE:
                    break
                if value is not None:
                    whole, used = score[start - base] + value, pieces[start - base] + 1
                    if whole > best or whole == best and used < count:
                        best, count = whole, used
                start -= 1
            if best == -math.inf:
                size = len(c.encode("utf-8", "surrogatepass"))
                best, count = score[-1] + BYTE_SCORE * size, pieces[-1] + size
            score.append(best)
            pieces.append(count)
            if len(score) > 64 * reach:
                base += len(score) - reach
                score, pieces = score[-reach:], pieces[-reach:]
        return pieces[-1]

    def count(self, word: str) -> int:
        """Pieces of a pre-token, from its terminal if it has been inserted."""
        if len(word) > TRIE_CHARS:
            return self.alone(word.replace(" ", SPACE))
        found = self.known.get(word)
        if found is None:
            if len(self.score) > NODES_KEPT or len(self.known) > TERMINALS_KEPT:
                self.clear()
            found = self.known[word] = self.insert(word.replace(" ", SPACE))
        return found


def token_counts(documents: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_tokens, n_pretokens, n_distinct) per row of ``documents`` (doc_id, text).

    Null and empty texts have none. Repeated rows each come back; doc_id may be null; other columns are ignored. Nothing
    is shuffled: a trie lives in its task, bounded in nodes, and only the vocabulary file, of fixed size, is read by every
    task. A word of more than TRIE_CHARS characters is scored alone, in a window as long as the longest piece, so a very long
    word or text takes time in proportion to its length and memory for its characters only.
    """

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        pieces = load_pieces(model)
        trie, pattern = Trie(pieces), pretoken_pattern(pieces)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            tokens, all_words, distinct = [], [], []
            for text in texts_of(batch):
                words = Counter(pretokens(text, pattern))
                tokens.append(sum(trie.count(w) * n for w, n in words.items()))
                all_words.append(words.total())
                distinct.append(len(words))
            kinds = {"n_tokens": tokens, "n_pretokens": all_words, "n_distinct": distinct}
            return with_columns(batch, ["doc_id"], **{k: pa.array(v, pa.int64()) for k, v in kinds.items()})

        return work

    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, n_pretokens long, n_distinct long"
    return over_texts(documents.select("doc_id", "text"), "text", make, schema)
