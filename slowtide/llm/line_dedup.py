"""Line dedup against levelled sorted runs of line hashes.

Documents arrive in batches. The store holds runs: Parquet tables of
``(key, keeper, docs)``, hash-partitioned and sorted by key. A batch is reduced
to its own keys, anti-joined against the runs by sort-merge joins to find the
keys it is the first to hold, and added as a new run of level 0. When a level
has ``fan`` runs they are merged into one run of the next level, so a key is
rewritten a logarithmic number of times.

Batches come with falling doc_id, so a key's first batch holds the document
that keeps its line, and later batches only add to the number of documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slowtide.session import write_once

MIN_CHARS = 40
MIN_DOCS = 5
BATCHES = 4
FAN = 4
SPACES = b" \t\n\x0b\x0c\r"


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The 16-byte hash of a line's key, or None if the key is too short to count.

    ``bytes.lower`` changes A-Z only, and ``strip`` takes the six ASCII spaces only.
    """
    key = line.strip(SPACES)
    if len(key) < min_chars or (not key.isascii() and len(key.decode()) < min_chars):
        return None
    return hashlib.blake2b(key.lower(), digest_size=16).digest()


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``(doc_id, key)`` for every counted line of ``(doc_id, text)``, once per document row."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                own = {k for line in (text or "").encode().split(b"\n") if (k := line_key(line, min_chars))}
                ids += [doc_id] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.binary())], names=["doc_id", "key"])

    return docs.mapInArrow(keys, "doc_id long, key binary")


@dataclass
class LineRuns:
    """The levels of runs and the next free run numbers."""

    spark: SparkSession
    fan: int = FAN
    levels: list[list[DataFrame]] = field(default_factory=list)

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, lines: DataFrame) -> None:
        """Add a batch of ``(doc_id, key)``: merge-anti-join the runs, then store the batch as a run.

        A key that no run holds gets the batch's largest doc_id as keeper;
        a known key only adds its number of documents.
        """
        own = lines.groupBy("key").agg(
            F.max("doc_id").alias("keeper"), (F.count_distinct("doc_id") + F.max(F.col("doc_id").isNull().cast("int"))).alias("docs")
        )
        own = write_once(own, "line-batch")
        fresh = own
        for run in self.runs():
            fresh = fresh.hint("merge").join(run.select("key"), "key", "left_anti")
        known = own.select("key", F.lit(None).cast("long").alias("keeper"), "docs", F.lit(False).alias("opens"))
        if self.runs():
            fresh = fresh.withColumn("opens", F.lit(True))
            # one entry per key: what the anti-join kept opens the key
            entries = fresh.unionByName(known).groupBy("key").agg(
                F.max("keeper").alias("keeper"), F.max("docs").alias("docs"), F.max("opens").alias("opens")
            )
        else:
            entries = fresh.withColumn("opens", F.lit(True))
        self._store(entries, 0)

    def _store(self, entries: DataFrame, level: int) -> None:
        run = write_once(entries.sortWithinPartitions("key"), f"line-run-{level}")
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fan:
            merged = self._merge(self.levels[level])
            self.levels[level] = []
            self._store(merged, level + 1)

    def _merge(self, runs: list[DataFrame]) -> DataFrame:
        rows = runs[0]
        for run in runs[1:]:
            rows = rows.unionByName(run)
        return rows.groupBy("key").agg(F.max("keeper").alias("keeper"), F.sum("docs").alias("docs"), F.max("opens").alias("opens"))

    def entries(self) -> DataFrame:
        """One row per key over all runs."""
        return self._merge(self.runs())


def batch_bounds(docs: DataFrame, batches: int) -> list[int]:
    """Doc_ids that divide the documents into about equal batches, largest first."""
    at = [i / batches for i in range(1, batches)]
    found = docs.agg(F.percentile_approx("doc_id", at, 1000).alias("p")).first()["p"] if at else None
    return sorted(set(found or []), reverse=True)


def line_runs(docs: DataFrame, min_chars: int = MIN_CHARS, batches: int = BATCHES, fan: int = FAN) -> LineRuns:
    """The store after all documents, in batches of falling doc_id (null doc_ids last)."""
    store, high = LineRuns(docs.sparkSession, fan), None
    for low in [*batch_bounds(docs, batches), None]:
        part = docs if high is None else docs.where((F.col("doc_id") < high) | F.col("doc_id").isNull())
        part = part if low is None else part.where(F.col("doc_id") >= low)
        store.add(line_keys(part, min_chars))
        high = low
    return store


def dedup_lines(
    df: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fan: int = FAN
) -> DataFrame:
    """``df`` with repeated lines removed from ``text``, plus ``n_lines`` and ``n_dropped`` (longs).

    A line's key is the line without ASCII white space at both ends and with A-Z
    in lower case. Keys of at least ``min_chars`` code points in at least
    ``min_docs`` documents lose all their lines except in the largest doc_id that
    holds it (all of its lines stay there). The other lines stay, joined by \\n.
    A null text counts as one empty line and becomes empty. Rows that share a
    doc_id count as one document, and so do all rows without one, which come
    before every number. Extra columns are kept; columns named like the two
    added ones are replaced.
    """
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    repeated = line_runs(docs, min_chars, batches, fan).entries().where(F.col("docs") >= min_docs)
    repeated = write_once(repeated.select("key", "keeper"), "line-repeats")
    lost = line_keys(docs, min_chars).join(repeated, "key").where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    lost = lost.groupBy("doc_id").agg(F.collect_set("key").alias("__lost")).withColumnRenamed("doc_id", "__doc")
    rows = df.drop("n_lines", "n_dropped", "__doc", "__lost").join(
        lost.hint("shuffle_hash"), F.col("doc_id").cast("long").eqNullSafe(F.col("__doc")), "left"
    )
    kept = rows.drop("__doc")
    schema = kept.drop("__lost").withColumns({"n_lines": F.lit(0).cast("long"), "n_dropped": F.lit(0).cast("long")}).schema
    at = kept.drop("__lost").columns.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, total, dropped = [], [], []
            for text, keys in zip(batch.column("text").to_pylist(), batch.column("__lost").to_pylist()):
                lines = (text or "").encode().split(b"\n")
                if keys:
                    gone = set(keys)
                    left = [line for line in lines if line_key(line, min_chars) not in gone]
                    texts.append(b"\n".join(left).decode())
                else:
                    left = lines
                    texts.append(text or "")
                total.append(len(lines))
                dropped.append(len(lines) - len(left))
            columns = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "__lost"]
            columns[at] = pa.array(texts, pa.string())
            names = [n for n in batch.schema.names if n != "__lost"] + ["n_lines", "n_dropped"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(dropped, pa.int64())], names=names)

    return kept.mapInArrow(cut, schema)
