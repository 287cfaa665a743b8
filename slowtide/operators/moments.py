"""Distributed means and covariance matrices of vectors and of their differences."""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from slowtide.operators.skew import spread_work

VALUES, DIFFERENCES = "x", "dx"
# Partial matrices a task holds before it emits them, and the size of a batch
HELD_BYTES = 128 << 20
SENT_BYTES = 16 << 20
# Matrix rows merged together: one block for small matrices, several tasks for large
BLOCK_ROWS = 64


def matrix_of(column: pa.Array) -> np.ndarray:
    """An Arrow list column without nulls as a rows × dims matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if len(column) and len(flat) % len(column):
        raise ValueError("vectors of different length in one series")
    return flat.reshape(len(column), -1)


class Partial:
    """Rows and moments of one series: rows as they are while they are few, else count, mean and scatter.

    ``start`` and ``size`` name the rows of the scatter matrix that are kept. A
    matrix takes as much room as its dimension in rows, so a partial of fewer
    than ``limit`` rows stays rows wherever it is held or sent.
    """

    def __init__(self, start: int = 0, size: int | None = None, limit: int = BLOCK_ROWS):
        self.start, self.size, self.limit = start, size, limit
        self.rows: list[np.ndarray] = []
        self.waiting = 0
        self.n, self.mean, self.scatter = 0, None, None

    @property
    def nbytes(self) -> int:
        return sum(r.nbytes for r in self.rows) + (0 if self.scatter is None else self.scatter.nbytes)

    def add_rows(self, x: np.ndarray) -> None:
        if (self.rows or self.mean is not None) and self.width != x.shape[1]:
            raise ValueError(f"vectors of different length in one series: {self.width}, {x.shape[1]}")
        self.rows.append(x)
        self.waiting += len(x)
        if self.waiting >= self.limit:
            self.fold()

    def fold(self) -> None:
        """Turn the waiting rows into moments."""
        if not self.rows:
            return
        x = np.concatenate(self.rows)
        self.rows, self.waiting = [], 0
        mean = x.mean(axis=0)
        centred = x - mean
        part = centred if self.size is None else centred[:, self.start : self.start + self.size]
        self.add_moments(len(x), mean, part.T @ centred)

    def add_moments(self, n: int, mean: np.ndarray, scatter: np.ndarray) -> None:
        """The pairwise update, without cancellation."""
        if self.mean is None:
            self.n, self.mean, self.scatter = n, mean.copy(), scatter.copy()
            return
        if len(mean) != len(self.mean):
            raise ValueError(f"vectors of different length in one series: {len(self.mean)}, {len(mean)}")
        shift, total = mean - self.mean, self.n + n
        part = shift[self.start : self.start + len(self.scatter)]
        self.scatter += scatter + np.outer(part, shift) * (self.n * n / total)
        self.mean += shift * (n / total)
        self.n = total

    def covariance(self) -> np.ndarray:
        """Sample covariance; a single row has none."""
        self.fold()
        return self.scatter / (self.n - 1) if self.n > 1 else np.zeros_like(self.scatter)

    @property
    def width(self) -> int:
        return self.rows[0].shape[1] if self.rows else len(self.mean)

    def blocks(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """``(first matrix row, n, mean, numbers)`` to be merged elsewhere; rows have no mean."""
        if self.mean is not None:
            self.fold()
        first, last = (0, self.width) if self.size is None else (self.start, self.start + 1)
        for at in range(first, last, BLOCK_ROWS):
            if self.mean is None:
                yield at, self.waiting, np.zeros(0), np.concatenate(self.rows).ravel()
            else:
                own = self.scatter[at : at + BLOCK_ROWS] if self.size is None else self.scatter
                yield at, self.n, self.mean, own.ravel()


def _partial_moments(keys: list[str], columns: list[str], schema: pa.Schema):
    """Task-side part: rows or moments of each series and kind seen by the task."""

    def rows_of(state: dict) -> Iterator[pa.RecordBatch]:
        ready, size = [], 0
        for (values, kind), partial in state.items():
            for block, n, mean, part in partial.blocks():
                ready.append((*values, kind, block, n, mean, part))
                size += part.nbytes
                if size > SENT_BYTES:
                    yield _batch_of(ready, schema)
                    ready, size = [], 0
        if ready:
            yield _batch_of(ready, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, held = {}, 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            codes = np.zeros(batch.num_rows, dtype=np.int64)
            for i in range(len(keys)):
                encoded = batch.column(i).dictionary_encode(null_encoding="encode")
                codes = codes * len(encoded.dictionary) + encoded.indices.to_numpy()
            _, first, group = np.unique(codes, return_index=True, return_inverse=True)
            names = [tuple(batch.column(i)[int(at)].as_py() for i in range(len(keys))) for at in first]
            for position, kind in enumerate(columns):
                column = batch.column(len(keys) + position)
                present = column.is_valid().to_numpy(zero_copy_only=False)
                if not present.any():
                    continue
                member = group[present]
                order = np.argsort(member, kind="stable")
                cuts = np.flatnonzero(np.diff(member[order])) + 1
                vectors = column.filter(pa.array(present)).take(pa.array(order))
                widths = np.diff(vectors.offsets.to_numpy())
                for at, until in zip(np.r_[0, cuts], np.r_[cuts, len(order)]):
                    # each series has its own vector length
                    name = names[member[order[at]]]
                    if (widths[at:until] != widths[at]).any():
                        raise ValueError(f"vectors of different length in series {name}")
                    own = vectors.slice(at, until - at)
                    if own.flatten().null_count:
                        raise ValueError(f"a vector with a null entry in series {name}")
                    partial = state.setdefault((name, kind), Partial())
                    before = partial.nbytes
                    partial.add_rows(matrix_of(own))
                    held += partial.nbytes - before
            if held > HELD_BYTES:
                yield from rows_of(state)
                state, held = {}, 0
        yield from rows_of(state)

    return run


def _batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, field.type) for c, field in zip(zip(*rows), schema)], schema=schema)


def _merge(batches: Iterator[pa.RecordBatch], key_count: int, schema: pa.Schema, final: bool) -> Iterator[pa.RecordBatch]:
    """Merge the partials of one (series, kind, block of matrix rows), one batch at a time.

    Gives one partial again, or the block's rows of the covariance matrix if ``final``.
    """
    head, partial = None, None
    for batch in batches:
        if head is None:
            head = [batch.column(i)[0].as_py() for i in range(key_count + 2)]
            partial = Partial(head[-1], BLOCK_ROWS)
        counts, means, parts = (batch.column(key_count + i) for i in (2, 3, 4))
        for n, mean, part in zip(counts.to_pylist(), means, parts):
            mean, part = (v.values.to_numpy(zero_copy_only=False) for v in (mean, part))
            if len(mean):
                partial.add_moments(n, mean, part.reshape(-1, len(mean)))
            else:
                partial.add_rows(part.reshape(n, -1))
    if head is None:
        return
    if not final:
        yield _batch_of([(*head[:-1], at, n, mean, part) for at, n, mean, part in partial.blocks()], schema)
        return
    covariance = partial.covariance()
    yield _batch_of([(*head[:-1], head[-1] + i, partial.n, partial.mean, row) for i, row in enumerate(covariance)], schema)


def plain_arrow_schema(schema: T.StructType) -> pa.Schema:
    """Arrow types of a Spark schema, with plain, nullable list elements."""

    def plain(kind: pa.DataType) -> pa.DataType:
        return pa.list_(plain(kind.value_type)) if pa.types.is_list(kind) else kind

    return pa.schema([pa.field(f.name, plain(f.type), True) for f in to_arrow_schema(schema)])


def _moment_schema(df: DataFrame, series: list[str]) -> T.StructType:
    row = T.ArrayType(T.DoubleType())
    return T.StructType(
        [df.schema[c] for c in series]
        + [
            T.StructField("kind", T.StringType()),
            T.StructField("i", T.IntegerType()),
            T.StructField("n", T.LongType()),
            T.StructField("mean", row),
            T.StructField("covariance", row),
        ]
    )


def moments(
    df: DataFrame,
    series: list[str] = ("series",),
    vector: str = "embedding",
    diff: str | None = None,
) -> DataFrame:
    """Per series: count, mean and sample covariance matrix, one matrix row per row.

    ``series.., kind, i, n, mean, covariance`` with kind ``x`` for the vectors
    and ``dx`` for the differences (if ``diff`` names their column).

    One pass: each task reduces its rows to one matrix per series, or sends
    them on while they are fewer than a matrix takes. Partials are merged in two
    steps, first over parts of the tasks and then over those, so that a series
    seen by every task is no heavier than others; blocks of matrix rows are
    merged apart, and nothing reaches the driver. Matrices are centred when they are
    formed and merged by the pairwise update, never as a difference of large sums.
    """
    series = list(series)
    spark_schema = _moment_schema(df, series)
    arrow_schema = plain_arrow_schema(spark_schema)
    columns = {VALUES: vector} | ({DIFFERENCES: diff} if diff else {})
    vectors = [F.col(c).cast("array<double>").alias(k) for k, c in columns.items()]
    partials = df.select(*series, *vectors).mapInArrow(
        _partial_moments(series, list(columns), arrow_schema), spark_schema
    )
    key_count = len(series)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _merge(batches, key_count, arrow_schema, final=False)

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _merge(batches, key_count, arrow_schema, final=True)

    keys = [*series, "kind", "i"]
    parts = math.isqrt(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if parts > 1:
        # which task a partial comes from is as good as any other way to divide them
        dealt = partials.withColumn("__part", F.pmod(F.spark_partition_id(), F.lit(parts)))
        partials = dealt.groupBy(*keys, "__part").applyInArrow(merged, spark_schema)
    return spread_work(partials, keys).groupBy(*keys).applyInArrow(finished, spark_schema)


def covariance_entries(moment_rows: DataFrame, series: list[str] = ("series",)) -> DataFrame:
    """The matrices in long form: ``series.., kind, i, j, n, covariance``."""
    return moment_rows.select(*series, "kind", "i", "n", F.posexplode("covariance").alias("j", "covariance"))
