"""Rows at both ends of each component."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from slowtide.operators.moments import plain_arrow_schema
from slowtide.operators.skew import join_null_safe

SIDES = ("high", "low")


class Heaps:
    """The best k rows at either end of every component of one series, as far as seen."""

    def __init__(self, k: int, ties: list[str]):
        self.k, self.ties = k, ties
        self.best: dict[tuple[int, int], pa.Table] = {}
        #: scores that a row must reach to matter, per side and component; high scores count negative
        self.bar = np.zeros((2, 0))

    def add(self, ids: pa.Table, scores: np.ndarray) -> None:
        """Add rows with their scores (rows × components); nan entries take no part."""
        width = scores.shape[1]
        if width > self.bar.shape[1]:
            self.bar = np.concatenate([self.bar, np.full((2, width - self.bar.shape[1]), np.inf)], axis=1)
        for side in range(2):
            signed = -scores if side == 0 else scores
            for component in np.flatnonzero((signed <= self.bar[side, :width]).any(axis=0)):
                at = np.flatnonzero(signed[:, component] <= self.bar[side, component])
                if len(at) > self.k:
                    # ties of the last place stay, to be settled by the other columns
                    last = np.partition(signed[at, component], self.k - 1)[self.k - 1]
                    at = at[signed[at, component] <= last]
                own = ids.take(pa.array(at)).append_column("__signed", pa.array(signed[at, component]))
                held = self.best.get((side, component))
                own = own if held is None else pa.concat_tables([held, own])
                if own.num_rows > self.k:
                    own = own.take(pc.sort_indices(own, [("__signed", "ascending"), *[(c, "ascending") for c in self.ties]])[: self.k])
                self.best[side, component] = own
                if own.num_rows == self.k:
                    self.bar[side, component] = pc.max(own["__signed"]).as_py()


def _keep_extremes(series: list[str], ids: list[str], ties: list[str], k: int, schema: pa.Schema):
    """Task-side part: k rows at most per series, component and side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, Heaps] = {}
        for batch in batches:
            table = pa.Table.from_batches([batch]).filter(pc.is_valid(batch.column("__scores")))
            if not table.num_rows:
                continue
            codes = np.zeros(table.num_rows, np.int64)
            for c in series:
                encoded = table[c].combine_chunks().dictionary_encode(null_encoding="encode")
                codes = codes * len(encoded.dictionary) + encoded.indices.to_numpy(zero_copy_only=False)
            widths = pc.list_value_length(table["__scores"]).to_numpy()
            # rows of one series and one vector length together
            groups = np.stack([codes, widths], axis=1)
            _, first, member = np.unique(groups, axis=0, return_index=True, return_inverse=True)
            for number, at in enumerate(first):
                own = table.take(pa.array(np.flatnonzero(member.reshape(-1) == number)))
                flat = pc.fill_null(own["__scores"].combine_chunks().flatten(), np.nan).to_numpy(zero_copy_only=False)
                name = tuple(table[c][int(at)].as_py() for c in series)
                heaps = found.setdefault(name, Heaps(k, ties))
                heaps.add(own.select(ids), flat.reshape(own.num_rows, -1))
        for heaps in found.values():
            for (side, component), rows in heaps.best.items():
                n, signed = rows.num_rows, rows["__signed"]
                score = pc.negate(signed) if side == 0 else signed
                fixed = [pa.array([int(component)] * n, pa.int32()), pa.array([SIDES[side]] * n, pa.string()), score]
                yield from pa.Table.from_arrays([*[rows[c] for c in ids], *fixed], schema=schema).combine_chunks().to_batches()

    return run


def extreme_rows(
    df: DataFrame,
    components: str,
    k: int,
    tie_break: list[str],
    keep: list[str],
    series: list[str] = (),
    n_components: int | None = None,
) -> DataFrame:
    """The k largest and k smallest rows of every entry of a vector column.

    ``series.., component, side ('high'/'low'), rank, score, keep..``. Series and
    ``tie_break`` columns together must name a row. One pass over the vectors: a task
    holds and sends k rows per series, component and side, however many rows a
    series has, and these are ranked. Other kept columns are joined to the winners
    only. Null vectors and entries that are null or not a number take no part.
    """
    ties, ids = list(tie_break), list(dict.fromkeys([*series, *tie_break]))
    scores = F.col(components) if n_components is None else F.slice(components, 1, n_components)
    fields = [df.schema[c] for c in ids] + [
        T.StructField("component", T.IntegerType()), T.StructField("side", T.StringType()), T.StructField("score", T.DoubleType())
    ]
    schema = T.StructType(fields)
    vectors = df.select(*ids, scores.cast("array<double>").alias("__scores"))
    best = vectors.mapInArrow(_keep_extremes(list(series), ids, ties, k, plain_arrow_schema(schema)), schema)
    signed = F.when(F.col("side") == SIDES[0], -F.col("score")).otherwise(F.col("score"))
    order = W.partitionBy(*series, "component", "side").orderBy(signed, *ties)
    both = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    rest = [c for c in dict.fromkeys(keep) if c not in ids]
    if rest:
        # the texts of the winners: at most 2 · k rows per component
        both = join_null_safe(both, df.select(*ids, *rest), ids)
    return both.select(*dict.fromkeys([*series, "component", "side", "rank", "score", *keep]))
