"""Texts as arrays of code points: cutting, hashing and grouping substrings with numpy.

A block of texts becomes one array of code points. Prefix sums of
``code * BASE**i`` modulo 2**64 give the hash of any substring in two reads,
whatever its length, so whole blocks are hashed without a loop over texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: About how many bytes of text are worked on at once; a longer text comes alone.
BLOCK = 1 << 19
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and ``base**-i`` modulo 2**64 for i < n, kept for later calls."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, BLOCK + (BLOCK >> 2))
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        have = _POWERS[base] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values, so that every bit depends on all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


class Sums:
    """Prefix sums of one block, from which any substring's hash is read."""

    def __init__(self, codes: np.ndarray, base: int = BASES[0]):
        self.up, self.down = powers(base, len(codes) + 1)
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * self.up[: len(codes)], out=self.sums[1:])

    def raw(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * self.down[starts]

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix(self.raw(starts, ends) + (ends - starts).astype(np.uint64))


def spans(inside: np.ndarray, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true; a run also ends at each of ``cuts``."""
    edge = np.zeros(len(inside) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[0] = edge[-1] = True
    if cuts is not None:
        edge[cuts] = True
    at = np.flatnonzero(edge)
    keep = inside[at[:-1]] if len(inside) else np.zeros(len(at) - 1, bool)
    return at[:-1][keep], at[1:][keep]


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices ``starts[i], starts[i] + 1, ..`` (``counts[i]`` of them) of all i in turn."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)


def offsets(lengths: Iterable[int]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.fromiter(lengths, np.int64))]).astype(np.int64)


def blocks(batch: pa.RecordBatch, column: str, limit: int = BLOCK) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of a batch with their texts (null: empty), about ``limit`` bytes each; a longer text comes alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    first = total = 0
    for i, size in enumerate([*sizes.tolist(), limit + 1]):
        if i > first and total + size > limit:
            part = batch.slice(first, i - first)
            yield part, [t or "" for t in part.column(column).to_pylist()]
            first, total = i, 0
        total += size


def map_texts(
    df: DataFrame,
    text: str,
    targets: dict[str, T.DataType],
    start: Callable[[], Callable[[list[str]], Sequence[pa.Array]]],
    keep: list[str] | None = None,
) -> DataFrame:
    """Add columns computed from blocks of texts, in tasks that hold one batch and one block at a time.

    ``start`` runs once per task and returns what makes the arrays of all ``targets``
    from a block's texts (null: empty). Columns named like a target are replaced;
    only the columns ``keep`` go on (default: all).
    """
    stay = [c for c in (df.columns if keep is None else keep) if c not in targets]
    rows = df.select(*[f"`{c}`" for c in stay], *([] if text in stay else [f"`{text}`"]))
    fields = [df.schema[c] for c in stay] + [T.StructField(c, kind) for c, kind in targets.items()]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            for part, texts in blocks(batch, text):
                yield pa.RecordBatch.from_arrays([part.column(c) for c in stay] + list(work(texts)), names=names)

    return rows.mapInArrow(run, T.StructType(fields))


def groups(batches: Iterable[pa.RecordBatch], keys: list[str], limit: int = 1 << 16) -> Iterator[pa.Table]:
    """Runs of whole groups from batches sorted by ``keys``, at least ``limit`` rows or bytes / 256 a run.

    A group is never divided; what is held is one run and one batch.
    """
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and rows >= limit:
            cut = _last_change(held[-1], batch, keys)
            if cut is not None:
                if cut:
                    held.append(batch.slice(0, cut))
                yield pa.Table.from_batches(held)
                held, rows, batch = [], 0, batch.slice(cut)
        held.append(batch)
        rows += max(batch.num_rows, batch.nbytes >> 8)
    if held:
        yield pa.Table.from_batches(held)


def _last_change(before: pa.RecordBatch, batch: pa.RecordBatch, keys: list[str]) -> int | None:
    """The last row of ``batch`` that opens a group; None if it goes on with the group before it."""
    changed = np.zeros(batch.num_rows, bool)
    for key in keys:
        values = batch.column(key).to_numpy(zero_copy_only=False)
        changed[1:] |= values[1:] != values[:-1]
        changed[0] |= bool(before.column(key).to_numpy(zero_copy_only=False)[-1] != values[0])
    found = np.flatnonzero(changed)
    return int(found[-1]) if len(found) else None


def starts_of(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Row numbers where the groups of a sorted table begin, and its length."""
    changed = np.ones(table.num_rows, bool)
    if table.num_rows:
        changed[1:] = False
    for key in keys:
        values = table.column(key).to_numpy()
        changed[1:] |= values[1:] != values[:-1]
    return np.append(np.flatnonzero(changed), table.num_rows)


class Memory:
    """Lists of numbers by 64-bit hash, as sorted arrays; emptied when more than ``limit`` are held."""

    def __init__(self, limit: int):
        self.limit = limit
        self.forget()

    def forget(self) -> None:
        self.keys, self.first, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.values, self.used = np.zeros(1 << 16, np.int64), 0

    def look(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each hash is, and which are missing."""
        place = np.searchsorted(self.keys, hashes)
        if not len(self.keys):
            return place, np.ones(len(hashes), bool)
        return place, self.keys[np.minimum(place, len(self.keys) - 1)] != hashes

    def missing(self, hashes: np.ndarray) -> np.ndarray:
        """Which of some sorted distinct hashes are missing, after making room for them."""
        new = self.look(hashes)[1]
        if len(self.keys) + new.sum() > self.limit:
            self.forget()
            new[:] = True
        return new

    def add(self, hashes: np.ndarray, values: np.ndarray, counts: np.ndarray) -> None:
        """Add missing sorted hashes with their values in turn, ``counts`` of them each."""
        while self.used + len(values) > len(self.values):
            self.values = np.concatenate([self.values, np.zeros_like(self.values)])
        self.values[self.used : self.used + len(values)] = values
        place = np.searchsorted(self.keys, hashes)
        self.first = np.insert(self.first, place, self.used + np.cumsum(counts) - counts)
        self.count = np.insert(self.count, place, counts)
        self.keys = np.insert(self.keys, place, hashes)
        self.used += len(values)
