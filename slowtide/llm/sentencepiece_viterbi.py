"""SentencePiece encoding and decoding with a batched Viterbi in numpy.

A block of texts is cut at places that no piece spans. Distinct words of equal
length advance together: the hashes of all their substrings are looked up in
the sorted hashes of the pieces, and one maximum per end position stores, for
all words at once, the score and the piece that leads there. Equal scores go to
the piece that starts first, which is the tokenizer's own rule. Scores are whole
numbers, so sums are exact at any length; the tokenizer's library sums in 32-bit
floats and can differ in texts of more than about 500 pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slowtide.llm.codes import BASES, Memory, Sums, code_points, map_texts, ragged
from slowtide.llm.unigram import Cutter, Vocabulary, load_vocabulary

#: Substrings looked up at once while words advance.
LOOKUPS = 1 << 18
#: Words whose ids a worker remembers (about 50 bytes each); the memory starts anew beyond it.
REMEMBERED = 1_000_000


class ViterbiEncoder:
    def __init__(self, vocabulary: Vocabulary):
        self.longest = vocabulary.longest
        lengths = np.array([len(p) for p in vocabulary.pieces])
        ends = np.cumsum(lengths)
        codes = code_points("".join(vocabulary.pieces))
        keys = Sums(codes).hashes(ends - lengths, ends)
        order = np.argsort(keys)
        self.keys, self.checks = keys[order], Sums(codes, BASES[1]).hashes(ends - lengths, ends)[order]
        self.ids = np.array(vocabulary.ids, np.int64)[order]
        self.scores = np.append(np.array(vocabulary.scores)[order], [-np.inf, vocabulary.unknown])
        self.byte_ids = np.array(vocabulary.byte_ids, np.int64)
        self.cutter, self.memory = Cutter(vocabulary), Memory(REMEMBERED)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and the texts' bounds in it (one more than texts)."""
        codes, starts, ends, bounds = self.cutter.cut(texts)
        if not len(codes):
            return np.zeros(0, np.int32), bounds
        sums, checks = Sums(codes), Sums(codes, BASES[1])
        distinct, first, which = np.unique(sums.hashes(starts, ends), return_index=True, return_inverse=True)
        new = np.flatnonzero(self.memory.missing(distinct))
        if len(new):
            words = self._words(codes, sums, checks, starts[first[new]], (ends - starts)[first[new]])
            self.memory.add(distinct[new], *words)
        found = self.memory.look(distinct)[0][which]
        counts = self.memory.count[found]
        flat = self.memory.values[ragged(self.memory.first[found], counts)].astype(np.int32)
        return flat, np.concatenate([[0], np.cumsum(counts)])[bounds]

    def _words(self, codes, sums, checks, starts, lengths) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number for each distinct word."""
        found, counts, order = [], np.zeros(len(starts), np.int64), []
        by_length = np.argsort(lengths, kind="stable")
        cuts = np.flatnonzero(np.diff(lengths[by_length])) + 1
        for own in np.split(by_length, cuts):
            length = int(lengths[own[0]])
            together = max(1, LOOKUPS // (min(length, 256) * self.longest))
            for first in range(0, len(own), together):
                part = own[first : first + together]
                ids, n = self._advance(codes, sums, checks, starts[part], length)
                found.append(ids)
                counts[part] = n
                order.append(part)
        # back from the order of lengths to the order of words
        order_, flat = np.concatenate(order), np.concatenate(found)
        sorted_counts = counts[order_]
        froms = np.empty(len(starts), np.int64)
        froms[order_] = np.cumsum(sorted_counts) - sorted_counts
        return flat[ragged(froms, counts)], counts

    def _advance(self, codes, sums, checks, starts, length) -> tuple[np.ndarray, np.ndarray]:
        """Viterbi over words of one length; ids of all words in turn, and their number."""
        n = len(starts)
        best = np.full((n, length + 1), -np.inf)
        best[:, 0] = 0
        piece = np.full((n, length + 1), -1, np.int64)
        back = np.zeros((n, length + 1), np.int32)
        rows = np.arange(n)
        for slab in range(1, length + 1, 256):
            ends = np.arange(slab, min(slab + 256, length + 1))
            width = min(self.longest, int(ends[-1]))
            begin = ends[:, None] - np.arange(width, 0, -1)  # falling piece length: earliest start first
            inside = begin >= 0
            begin = np.maximum(begin, 0)
            from_, to = starts[:, None, None] + begin, starts[:, None, None] + ends[:, None]
            to = np.broadcast_to(to, from_.shape)
            hashes = sums.hashes(from_, to)
            place = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
            hit = (self.keys[place] == hashes) & inside
            at = np.nonzero(hit)
            hit[at] = self.checks[place[at]] == checks.hashes(from_[at], to[at])
            found = np.where(hit, place, len(self.keys))
            # one character that is no piece: unknown
            single = found[:, :, -1]
            found[:, :, -1] = np.where(single == len(self.keys), len(self.keys) + 1, single)
            gains = self.scores[found]
            for i, end in enumerate(ends):
                reach = best[rows[:, None], begin[i]] + gains[:, i]
                chosen = np.argmax(reach, axis=1)
                best[:, end] = reach[rows, chosen]
                piece[:, end] = found[rows, i, chosen]
                back[:, end] = begin[i][chosen]
        ids, counts = [], np.zeros(n, np.int64)
        position, left = np.full(n, length), rows
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        while len(left):
            here = position[left]
            own = piece[left, here]
            before = back[left, here]
            unknown = own == len(self.keys) + 1
            coded = np.where(unknown, -1 - codes[starts[left] + before].astype(np.int64), self.ids[np.minimum(own, len(self.keys) - 1)])
            steps.append((left, coded))
            counts[left] += 1
            position[left] = before
            left = left[before > 0]
        total = np.cumsum(counts)
        flat = np.empty(int(total[-1]), np.int64)
        last = total.copy()
        for which, coded in steps:
            last[which] -= 1
            flat[last[which]] = coded
        return self._bytes(flat, counts)

    def _bytes(self, flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unknown characters (negative codes) as their UTF-8 bytes."""
        unknown = flat < 0
        if not unknown.any():
            return flat, counts
        code = np.where(unknown, -1 - flat, 0)
        size = np.where(unknown, 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000), 1)
        wide = np.repeat(flat, size)
        at = np.cumsum(size) - size
        for where in np.flatnonzero(unknown):
            encoded = chr(int(code[where])).encode("utf-8", "replace")
            wide[at[where] : at[where] + len(encoded)] = self.byte_ids[list(encoded)]
        owner = np.repeat(np.arange(len(counts)), counts)
        return wide, np.bincount(owner, weights=size, minlength=len(counts)).astype(np.int64)


def encode_documents(df: DataFrame, model: str, text: str = "text", target: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Add each text's ids (array of int).

    Null and empty texts have none. Spaces and U+2581 are the same to the model.
    Extra columns (or those in ``keep``) stay; one named like ``target`` is
    replaced. Rows are independent: no shuffle, and memory is bounded by blocks of
    code points.
    """
    vocabulary = load_vocabulary(model)

    def start():
        own = ViterbiEncoder(vocabulary)

        def encode(texts: list[str]) -> list[pa.Array]:
            ids, bounds = own.encode(texts)
            return [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))]

        return encode

    return map_texts(df, text, {target: T.ArrayType(T.IntegerType())}, start, keep)


def decode_documents(df: DataFrame, model: str, ids: str = "ids", target: str = "decoded") -> DataFrame:
    """Add the text of each row's ids.

    Runs of byte pieces are read as UTF-8, with U+FFFD for what is not; the
    model's leading space goes. A null list gives null, an id that the model
    lacks is an error. Extra columns stay; one named like ``target`` is replaced.
    """
    table = load_vocabulary(model).texts
    rows = df.withColumn(target, F.lit(None).cast("string"))
    at, names = rows.columns.index(target), rows.columns

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = table.__getitem__
        for batch in batches:
            texts = []
            for own in batch.column(ids):
                if not own.is_valid:
                    texts.append(None)
                    continue
                own = own.values.to_numpy(zero_copy_only=False).tolist()
                if own and min(own) < 0:
                    raise IndexError("negative id")
                joined = b"".join(map(look, own)).decode("utf-8", "replace")
                texts.append(joined.removeprefix(" "))
            columns = batch.columns
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(decode, rows.schema)
