"""Packing documents into fixed-length sequences: dominance reduction, then best fit.

Only the number of items per length matters for a packing, and lengths run from
1 to the capacity. So the instance is a histogram of at most ``capacity`` counts
however many documents there are. Sets that dominate every alternative
(Martello and Toth) are fixed on it for good, best fit places what is left, and
the resulting patterns are handed out to the documents by their rank among those
of equal length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slowtide.llm.codes import blocks
from slowtide.llm.sharding import with_slots
from slowtide.llm.word_ids import encoder
from slowtide.session import write_once

CAPACITY = 2048
END_ID = 0
#: A pattern: the (length, copies) in one sequence, and how many sequences look so.
Pattern = tuple[tuple[tuple[int, int], ...], int]


def document_pieces(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", with_ids: bool = False
) -> DataFrame:
    """Every document's ids and the end id, cut into pieces of at most ``capacity``.

    ``(doc_id, piece, start, length, ids_crc32)``, and ``ids`` (array of int) on
    request. Only documents longer than the capacity are cut; a null text has the
    end id alone.
    """
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for batch in batches:
            for part, texts in blocks(batch, "text"):
                ids, bounds = own.encode(texts)
                rows = []
                for doc_id, a, b in zip(part.column("doc_id").to_pylist(), bounds[:-1], bounds[1:]):
                    all_ids = np.append(ids[a:b], np.uint32(END_ID))
                    for number, at in enumerate(range(0, len(all_ids), capacity)):
                        piece = all_ids[at : at + capacity]
                        row = (doc_id, number, at, len(piece), zlib.crc32(piece.astype("<u4").tobytes()))
                        rows.append((*row, piece.astype(np.int32)) if with_ids else row)
                columns = list(zip(*rows))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(arrays)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(pieces, schema)


def reduce_dominated(counts: np.ndarray) -> tuple[list[Pattern], np.ndarray]:
    """Fix the sets that dominate all others holding their largest item; returns them and the rest.

    ``counts[s]`` is the number of items of length s; the capacity is
    ``len(counts) - 1``. A set {j, k} dominates if k fills the space left by j
    exactly, or nothing but one item fits beside j and k is the largest, or any
    two that fit are no longer than k together and no three fit. {j, k, b}
    dominates if no three fit beside j and every pair that fits can be
    exchanged for k and b. Some optimal packing holds each dominating set, so
    fixing it loses nothing.
    """
    counts, capacity, fixed = counts.copy(), len(counts) - 1, []
    changed = True
    while changed:
        changed = False
        for j in range(capacity, 0, -1):
            while counts[j] and (chosen := _dominating(counts, j, capacity)) is not None:
                sizes, copies = np.unique([j, *chosen], return_counts=True)
                times = int((counts[sizes] // copies).min())
                counts[sizes] -= copies * times
                fixed.append((tuple((int(s), int(c)) for s, c in zip(sizes[::-1], copies[::-1])), times))
                changed = True
    return fixed, counts


def _dominating(counts: np.ndarray, j: int, capacity: int) -> list[int] | None:
    """What to put beside an item of length j for good; [] if nothing fits, None if nothing dominates."""
    space = capacity - j
    counts[j] -= 1
    try:
        fits = np.flatnonzero(counts[: space + 1])
        if not len(fits):
            return []
        k = int(fits[-1])
        if k == space:
            return [k]
        three = _smallest(fits, counts, 3)
        if len(three) < 2 or three[0] + three[1] > space:
            return [k]
        if len(three) == 3 and sum(three) <= space:
            return None  # sets of three fit: not decided here
        if _best_pair(fits, counts, space, 0) <= k:
            return [k]
        counts[k] -= 1
        beside = np.flatnonzero(counts[: space - k + 1])
        counts[k] += 1
        if len(beside) and _best_pair(fits, counts, space, int(beside[-1])) <= k:
            return [k, int(beside[-1])]
        return None
    finally:
        counts[j] += 1


def _smallest(fits: np.ndarray, counts: np.ndarray, n: int) -> list[int]:
    found: list[int] = []
    for s in fits:
        found += [int(s)] * min(n - len(found), int(counts[s]))
        if len(found) == n:
            break
    return found


def _best_pair(fits: np.ndarray, counts: np.ndarray, space: int, above: int) -> int:
    """The largest sum within ``space`` of two items both longer than ``above``; 0 if there is none."""
    own, best = fits[fits > above], 0
    partner = np.searchsorted(own, space - own, side="right") - 1
    for i, p in enumerate(partner):
        if p == i and counts[own[i]] < 2:
            p -= 1
        if p >= 0:
            best = max(best, int(own[i] + own[p]))
    return best


def best_fit(counts: np.ndarray) -> list[Pattern]:
    """Best fit in falling length, many equal items and sequences at a time.

    Each item goes where least space is left after it. Sequences of equal
    content are one entry with a count, so the work depends on the number of
    different lengths alone.
    """
    capacity = len(counts) - 1
    open_: dict[int, list[Pattern]] = {}
    spaces: list[bool] = [False] * (capacity + 1)

    def put(space: int, pattern: tuple, times: int) -> None:
        open_.setdefault(space, []).append((pattern, times))
        spaces[space] = True

    for s in range(capacity, 0, -1):
        n = int(counts[s])
        while n:
            space = next((r for r in range(s, capacity + 1) if spaces[r]), None)
            if space is None:
                pattern, times, space = (), n, capacity
            else:
                pattern, times = open_[space].pop()
                spaces[space] = bool(open_[space])
            each = space // s
            whole = min(times, n // each)
            if whole:
                put(space - each * s, (*pattern, (s, each)), whole)
                n -= whole * each
                times -= whole
            if n and times and n < each:
                put(space - n * s, (*pattern, (s, n)), 1)
                times -= 1
                n = 0
            if times and pattern:
                put(space, pattern, times)
    return [entry for entries in open_.values() for entry in entries]


def placements(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int, int]]:
    """``(length, from_rank, to_rank, copies, first_sequence, first_offset)`` of every pattern's lengths."""
    rows, used, sequence = [], {}, 0
    for pattern, times in patterns:
        offset = 0
        for size, copies in pattern:
            first = used.get(size, 0)
            used[size] = first + copies * times
            rows.append((size, first, used[size], copies, sequence, offset))
            offset += size * copies
        sequence += times
    return rows


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``length`` of 1 to ``capacity``.

    ``pieces`` is read several times: pass a stored table of narrow rows. Equal
    rows get different places. No rows give no rows.
    """
    spark = pieces.sparkSession
    counts = np.zeros(capacity + 1, np.int64)
    # at most `capacity` rows, whatever the input
    for length, n in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[length] = n
    fixed, rest = reduce_dominated(counts)
    rows = placements(fixed + best_fit(rest))
    schema = "__length long, __from long, __to long, __copies long, __sequence long, __offset long"
    # a few rows for each of at most `capacity` lengths
    places = F.broadcast(spark.createDataFrame(rows, schema))
    ranked = with_slots(pieces, "length", "__rank")
    placed = ranked.join(
        places,
        (F.col("length") == F.col("__length")) & (F.col("__rank") >= F.col("__from")) & (F.col("__rank") < F.col("__to")),
    )
    nth = F.col("__rank") - F.col("__from")
    return placed.select(
        *pieces.columns,
        (F.col("__sequence") + F.expr("(__rank - __from) div __copies")).alias("sequence_id"),
        (F.col("__offset") + F.pmod(nth, F.col("__copies")) * F.col("length")).alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All documents packed into sequences of at most ``capacity`` ids, one row per piece.

    A null text counts as empty and still takes the end id. Documents of equal
    doc_id are packed each on their own. Extra columns are ignored, no rows give
    no rows. Returns ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.
    """
    pieces = write_once(document_pieces(docs, tokenizer, capacity, key, text), "pieces")
    return pack_pieces(pieces, capacity)
