"""Token counts without tokens: Aho-Corasick and a Viterbi that carries counts.

An automaton of all pieces lists, for every end position, the pieces that end
there. The dynamic program keeps one best score and one number of pieces per
position, nothing to trace back. The automaton reports longer pieces first, and
only a larger score replaces one, so equal scores go to the piece that starts
first: the tokenizer's own rule. An unknown character counts as its UTF-8 bytes.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from slowtide.llm.codes import Memory, Sums, map_texts
from slowtide.llm.unigram import Cutter, Vocabulary, load_vocabulary

#: Words whose count a worker remembers (about 50 bytes each); the memory starts anew beyond it.
REMEMBERED = 1_000_000


class TokenCounter:
    def __init__(self, vocabulary: Vocabulary, remembered: int = REMEMBERED):
        self.automaton = ahocorasick.Automaton()
        for piece, score in zip(vocabulary.pieces, vocabulary.scores):
            self.automaton.add_word(piece, (len(piece), int(score)))
        self.automaton.make_automaton()
        self.single = {p for p in vocabulary.pieces if len(p) == 1}
        self.unknown = int(vocabulary.unknown)
        self.cutter, self.memory = Cutter(vocabulary), Memory(remembered)

    def count(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of tokens and best score of each text."""
        codes, starts, ends, bounds = self.cutter.cut(texts)
        hashes = Sums(codes).hashes(starts, ends)
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        new = np.flatnonzero(self.memory.missing(distinct))
        if len(new):
            at = first[new]
            words = [codes[s:e].tobytes().decode("utf-32-le") for s, e in zip(starts[at].tolist(), ends[at].tolist())]
            found = np.array([self._best(w) for w in words], np.int64)
            self.memory.add(distinct[new], found.ravel(), np.full(len(new), 2))
        at = self.memory.first[self.memory.look(distinct)[0]][which]
        totals = [np.concatenate([[0], np.cumsum(self.memory.values[at + i])])[bounds] for i in (0, 1)]
        return np.diff(totals[0]), np.diff(totals[1])

    def _best(self, word: str) -> tuple[int, int]:
        """Pieces and score of the best path through one word."""
        scores, counts = [0] * (len(word) + 1), [0] * (len(word) + 1)
        closed = 0  # positions up to here are final
        for last, (length, score) in self.automaton.iter(word):
            end = last + 1
            if end > closed + 1:
                self._close(word, closed, end - 1, scores, counts)
                closed = end - 1
            reached = scores[end - length] + score
            if not counts[end] or reached > scores[end]:
                scores[end], counts[end] = reached, counts[end - length] + 1
        self._close(word, closed, len(word), scores, counts)
        return counts[-1], scores[-1]

    def _close(self, word: str, closed: int, upto: int, scores: list[int], counts: list[int]) -> None:
        """Try an unknown character as the last piece of each position up to ``upto``."""
        for end in range(closed + 1, upto + 1):
            char = word[end - 1]
            if char not in self.single:
                reached = scores[end - 1] + self.unknown
                if not counts[end] or reached > scores[end]:
                    scores[end], counts[end] = reached, counts[end - 1] + len(char.encode("utf-8", "replace"))


def count_tokens(
    df: DataFrame, model: str, text: str = "text", target: str = "n_tokens", score: str = "score", keep: list[str] | None = None
) -> DataFrame:
    """Add each text's number of tokens and the score of its segmentation (longs).

    Null and empty texts have none and score 0. Extra columns (or those in ``keep``)
    stay; columns named like the two added ones are replaced. No shuffle; a
    worker holds one batch and a bounded memory of words.
    """
    vocabulary = load_vocabulary(model)

    def start():
        own = TokenCounter(vocabulary)
        return lambda texts: [pa.array(c, pa.int64()) for c in own.count(texts)]

    return map_texts(df, text, {target: T.LongType(), score: T.LongType()}, start, keep)
