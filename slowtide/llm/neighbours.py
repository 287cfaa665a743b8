"""Approximate nearest neighbours over balanced posting lists.

A bounded sample is halved again and again at the median along its widest
direction, which gives clusters of equal size; their means are the centroids.
Every row is indexed: it enters the list of its nearest centroid and, if it lies
near a border, the lists of others about as near. A list of any length is
divided into blocks, so no task holds a whole list. A query searches the
centroids by a graph in memory, keeps those whose distance is within a ratio of
the nearest one's, and scans their lists exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from slowtide.session import write_once

#: Rows that the centroids are fitted on at most (the first by hash of vec_id), and rows per centroid.
SAMPLE = 16_384
PER_CENTROID = 16
#: Lists that a row may enter, and how much farther than the nearest centroid theirs may be.
COPIES, BORDER = 4, 1.2
#: Lists that a query scans at least and at most, and how much farther than the nearest centroid's the others may be.
LEAST_LISTS, LISTS, RATIO = 16, 128, 1.6
#: Graph: links per centroid, entries, and the least length of the list of candidates.
LINKS, ENTRIES, BEAM = 24, 32, 24
#: Rows of a list that a task holds at once.
BLOCK_ROWS = 4096


@dataclass(frozen=True)
class CentroidGraph:
    """Centroids, each linked to near ones; the search starts from entries spread over all clusters."""

    centroids: np.ndarray
    links: np.ndarray
    entries: np.ndarray

    @staticmethod
    def build(centroids: np.ndarray) -> CentroidGraph:
        n = len(centroids)
        square = (centroids**2).sum(1)
        apart = square[:, None] + square[None] - 2 * centroids @ centroids.T
        near = np.argsort(apart, axis=1, kind="stable")[:, : LINKS + 1]
        entries = np.unique(np.linspace(0, n - 1, min(n, ENTRIES)).astype(int))
        return CentroidGraph(centroids, near, entries)

    def search(self, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """About the ``k`` nearest centroids of each row, nearest first: numbers and distances.

        Best-first: the nearest centroid not yet looked at shows its links, for all
        rows at once, until every candidate has been looked at.
        """
        found, far = [], []
        for first in range(0, len(rows), 512):
            a, b = self._search(rows[first : first + 512], min(k, len(self.centroids)))
            found.append(a)
            far.append(b)
        if not found:
            return np.zeros((0, k), int), np.zeros((0, k))
        return np.concatenate(found), np.concatenate(far)

    def _search(self, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        n, width = len(rows), max(BEAM, k + k // 4)
        at = np.arange(n)[:, None]
        seen = np.zeros((n, len(self.centroids) + 1), bool)
        ids = np.broadcast_to(self.entries, (n, len(self.entries)))
        seen[at, ids] = True
        apart, open_ = self._apart(rows, ids), np.ones(ids.shape, bool)
        while True:
            waiting = np.where(open_, apart, np.inf)
            next_ = waiting.argmin(1)
            live = np.isfinite(waiting[at[:, 0], next_])
            if not live.any():
                break
            open_[at[:, 0], next_] = False
            shown = self.links[ids[at[:, 0], next_]]
            fresh = ~seen[at, shown] & live[:, None]
            seen[at, shown] |= live[:, None]
            reach = np.where(fresh, self._apart(rows, shown), np.inf)
            ids, apart, open_ = np.hstack([ids, shown]), np.hstack([apart, reach]), np.hstack([open_, fresh])
            if ids.shape[1] > width:
                keep = np.argpartition(apart, width - 1, axis=1)[:, :width]
                ids, apart, open_ = ids[at, keep], apart[at, keep], open_[at, keep]
        best = np.argsort(apart, axis=1, kind="stable")[:, :k]
        return ids[at, best], np.sqrt(np.maximum(apart[at, best], 0))

    def _apart(self, rows: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return ((rows[:, None, :] - self.centroids[ids]) ** 2).sum(2)

    def lists_of_row(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(row, list)`` pairs: the nearest centroid, and up to ``COPIES`` within ``BORDER`` of its distance."""
        ids, apart = self.search(rows, COPIES)
        row, j = np.nonzero(np.isfinite(apart) & (apart <= BORDER * apart[:, :1]))
        return row, ids[row, j]

    def lists_of_query(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(row, list)`` pairs to scan: the nearest centroids, and others within ``RATIO`` of the nearest one's distance."""
        ids, apart = self.search(rows, LISTS)
        chosen = (apart <= RATIO * apart[:, :1]) | (np.arange(apart.shape[1]) < LEAST_LISTS)
        row, j = np.nonzero(np.isfinite(apart) & chosen)
        return row, ids[row, j]


def balanced_centroids(rows: np.ndarray, per_centroid: int = PER_CENTROID) -> np.ndarray:
    """Means of clusters of equal size (at most ``per_centroid`` rows), neighbours next to each other."""
    if len(rows) <= per_centroid:
        return rows.mean(0, keepdims=True)
    centred = rows - rows.mean(0)
    direction = centred[np.argmax((centred**2).sum(1))]
    for _ in range(6):  # power steps towards the widest direction
        direction = centred.T @ (centred @ direction)
        norm = np.linalg.norm(direction)
        if norm == 0:
            break
        direction = direction / norm
    order = np.argsort(centred @ direction, kind="stable")
    half = len(rows) // 2
    return np.concatenate([balanced_centroids(rows[order[:half]], per_centroid), balanced_centroids(rows[order[half:]], per_centroid)])


def usable_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(vec_id, vector)`` of the rows that take part.

    Out are vectors that are null, zero, or hold null or non-finite entries, rows
    without a vec_id, and vectors of another length than most. Of several
    rows with one vec_id the smallest vector counts.
    """
    v = F.col("vector")
    rows = df.select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").alias("vector"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))
    length = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.where(F.size("vector") == (length["n"] if length else 0))
    return rows.groupBy("vec_id").agg(F.min("vector").alias("vector"))


def fit_graph(rows: DataFrame) -> CentroidGraph:
    """Centroids from a bounded sample, in one task; the driver gets them (at most SAMPLE / 16 rows)."""
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE)

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("vec_id")
        found = balanced_centroids(np.stack(part["vector"]).astype(float))
        return pd.DataFrame({"number": np.arange(len(found)), "centroid": list(found)})

    found = sample.groupBy().applyInPandas(fit, "number int, centroid array<double>").collect()
    return CentroidGraph.build(np.array([r.centroid for r in sorted(found, key=lambda r: r.number)]))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def in_lists(rows: DataFrame, graph: CentroidGraph, queries: bool) -> DataFrame:
    """``(list, vec_id, vector)``: each row once for every list it is in, or each query for every list it scans."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            matrix = _matrix(batch.column("vector")).astype(float)
            row, list_ = (graph.lists_of_query if queries else graph.lists_of_row)(matrix)
            taken = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(list_, pa.int32()), *taken.columns], names=["list", "vec_id", "vector"])

    kind = rows.schema["vector"].dataType.simpleString()
    return rows.select("vec_id", "vector").mapInArrow(place, f"list int, vec_id long, vector {kind}")


def _nearest(batch_ids: np.ndarray, batch: np.ndarray, ids: np.ndarray, block: np.ndarray, k: int):
    """The ``k`` nearest block rows of each query other than itself: query ids, ids, distances."""
    step = max(1, (1 << 21) // max(block.size, 1))
    out: list[tuple] = []
    for first in range(0, len(batch), step):
        own = batch_ids[first : first + step]
        apart = np.sqrt(((batch[first : first + step, None, :] - block[None]) ** 2).sum(2))
        apart[own[:, None] == ids[None]] = np.inf
        for q, row in zip(own, apart):
            reach = np.partition(row, k - 1)[k - 1] if len(row) > k else np.inf
            near = np.flatnonzero((row <= reach) & np.isfinite(row))
            near = near[np.lexsort((ids[near], row[near]))[:k]]
            out.append((np.full(len(near), q), ids[near], row[near]))
    if not out:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*out))


def scan(postings: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``(query_id, vec_id, score)``: the ``k`` nearest of each query in each block of each list it scans.

    ``postings`` and ``queries`` have ``list, vec_id, vector``. A task holds one
    block of a list; the queries of the list pass by in batches.
    """
    counts = postings.groupBy("list").agg(F.count(F.lit(1)).alias("n"))
    # at most one row per centroid
    blocks = F.broadcast(counts.select("list", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks")))
    held = postings.join(blocks, "list").select(
        "list", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("kind"), "vec_id", "vector"
    )
    asked = queries.join(blocks, "list").select(
        "list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("kind"), "vec_id", "vector"
    )
    rows = held.unionByName(asked)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple | None = None
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            list_, block, kind, ids = (batch.column(c).to_numpy() for c in ("list", "block", "kind", "vec_id"))
            matrix = _matrix(batch.column("vector")).astype(float)
            edge = np.flatnonzero((np.diff(list_) != 0) | (np.diff(block) != 0) | (np.diff(kind) != 0)) + 1
            bounds = [0, *edge.tolist(), batch.num_rows]
            for a, b in zip(bounds[:-1], bounds[1:]):
                if at != (list_[a], block[a]):
                    at, parts = (list_[a], block[a]), []
                if kind[a] == 0:
                    parts.append((ids[a:b], matrix[a:b]))
                elif parts:
                    if len(parts) > 1:
                        parts = [tuple(np.concatenate(c) for c in zip(*parts))]
                    found = _nearest(ids[a:b], matrix[a:b], *parts[0], k)
                    kinds = (pa.int64(), pa.int64(), pa.float64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(found, kinds)], names=["query_id", "vec_id", "score"]
                    )

    dealt = rows.repartition("list", "block").sortWithinPartitions("list", "block", "kind")
    return dealt.mapInArrow(compare, "query_id long, vec_id long, score double")


def _best(found: DataFrame, k: int) -> DataFrame:
    own = Window.partitionBy("query_id").orderBy("score", "vec_id")
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)


def nearest_neighbours(df: DataFrame, is_query, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows found for each query, by Euclidean distance in double precision.

    ``is_query`` is a condition on ``vec_id``; a query's own row is no candidate.
    Ties go to the smaller vec_id. Of equal vectors only the ``k + 1`` smallest
    vec_ids are indexed: no other can be among the nearest. A query whose lists
    hold fewer than ``k`` candidates is compared with all rows instead, in
    blocks. See ``usable_vectors`` for the rows that take part. Extra
    columns are ignored; no rows give no rows.
    """
    rows = write_once(usable_vectors(df, key, vector), "vectors")
    same = Window.partitionBy("vector").orderBy("vec_id")
    distinct = write_once(rows.withColumn("__n", F.row_number().over(same)).where(F.col("__n") <= k + 1).drop("__n"), "distinct-vectors")
    queries = rows.where(is_query)
    n = distinct.count()
    if not n:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).where("false")
    graph = fit_graph(distinct)
    postings = write_once(in_lists(distinct, graph, queries=False), "postings")
    found = write_once(_best(scan(postings, in_lists(queries, graph, queries=True), k), k), "neighbours")
    full = found.groupBy("query_id").count().where(F.col("count") >= min(k, n - 1)).select(F.col("query_id").alias("vec_id"))
    short = write_once(queries.join(full, "vec_id", "left_anti"), "short-queries")
    if short.count():
        one = lambda rows: rows.select(F.lit(0).alias("list"), "vec_id", "vector")
        rest = _best(scan(one(distinct), one(short), k), k)
        found = found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(rest)
    return found.select("query_id", "rank", "vec_id", "score")
