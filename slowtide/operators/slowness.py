"""How slowly a vector series changes, over time scales and label sets."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slowtide.functions.spectra import slowest
from slowtide.operators.models import fit_sfa, fit_windowed_sfa, series_moments
from slowtide.operators.moments import DIFFERENCES, VALUES
from slowtide.operators.skew import spread_work
from slowtide.operators.windows import time_scale_means

WHITE_NOISE = 2.0


def slowness(
    df: DataFrame,
    dims: int = 1,
    keep: float | int | None = 0.99,
    order: list[str] = ("window_start",),
    series: list[str] = ("series",),
    vector: str = "embedding",
    bounded: bool = False,
) -> DataFrame:
    """Sum of the ``dims`` smallest slowness values of each series: ``series.., n, delta``.

    A series with too few rows, or that never changes, has none: null.
    """
    if bounded:
        models = fit_windowed_sfa(df, dims, keep, order=order, series=series, vector=vector)
    else:
        models = fit_sfa(series_moments(df, order, series, vector), dims, keep, series=series)
    total = F.aggregate(F.slice("deltas", 1, dims), F.lit(0.0), lambda acc, x: acc + x)
    defined = (F.col("n_nontrivial") > 0) & (F.col("n") > 2)
    return models.select(*series, "n", F.when(defined, total).alias("delta"))


def slowness_by_time_scale(
    df: DataFrame,
    max_days: int = 30,
    series: list[str] = ("series",),
    time: str = "date",
    vector: str = "embedding",
) -> DataFrame:
    """Slowness of each series when pooled in windows of 1 .. ``max_days`` days.

    ``series.., days, n, delta``. One job over day sums serves all time scales.
    """
    pooled = time_scale_means(df, max_days, series, time, vector)
    # windows of whole days: the calendar limits a series
    return slowness(pooled, series=[*series, "days"], vector=vector, bounded=True)


def _order_key(iteration, label_idx, seed: int):
    return F.md5(F.concat_ws(":", F.lit(str(seed)), iteration.cast("string"), label_idx.cast("string")))


def with_label_order(df: DataFrame, n_labels: int, seed: int = 0) -> DataFrame:
    """Add ``label_order``, a seeded random order of the labels for each ``iteration``.

    Labels are sorted by a hash of (seed, iteration, label), so the orders do
    not depend on how the work is partitioned.
    """
    ids = F.sequence(F.lit(0), F.lit(n_labels - 1))
    keyed = F.transform(ids, lambda i: F.struct(_order_key(F.col("iteration"), i, seed).alias("h"), i.alias("i")))
    return df.withColumn("label_order", F.transform(F.array_sort(keyed), lambda s: s["i"]))


def label_orders(spark, n_iterations: int, n_labels: int, seed: int = 0) -> DataFrame:
    """Orders of the labels for so many iterations: ``iteration, label_order``."""
    return with_label_order(spark.range(n_iterations).select(F.col("id").alias("iteration")), n_labels, seed)


def prefix_gains(c: np.ndarray, d: np.ndarray, n: int, orders: np.ndarray, keep: float = 0.99) -> np.ndarray:
    """Drop in slowness as each label joins; one row per order of the labels.

    Label sets need only parts of the two covariance matrices, and all orders
    of one task take their next label together; a set that several orders have reached is
    solved once. A label that never changes adds nothing; a set of such labels has
    no slowness of its own and keeps the previous one, which is white noise's at first.
    """
    gains = np.zeros(orders.shape)
    moving = np.diag(c)[orders] > 0
    own = orders[moving].reshape(len(orders), -1)
    found = np.empty(own.shape)
    before = np.full(len(orders), WHITE_NOISE)
    for size in range(1, own.shape[1] + 1):
        chosen, which = own[:, :size], np.arange(len(own))
        if size == 1 or size > own.shape[1] - 3:
            # nearly all labels, or one: few sets
            chosen, which = np.unique(np.sort(chosen, axis=1), axis=0, return_inverse=True)
        rows, columns = chosen[:, :, None], chosen[:, None, :]
        delta = slowest(c[rows, columns], d[rows, columns], n, keep)[which.reshape(-1)]
        delta = np.where(np.isnan(delta), before, delta)
        found[:, size - 1] = before - delta
        before = delta
    gains[moving] = found.ravel()
    return gains


def label_gains(
    df: DataFrame,
    n_labels: int,
    n_iterations: int = 1000,
    seed: int = 0,
    order: list[str] = ("window_start",),
    series: list[str] = ("series",),
    vector: str = "embedding",
    iterations_per_task: int = 125,
    bounded: bool = False,
) -> DataFrame:
    """Slowness gain of every label in every iteration.

    ``series.., iteration, label_idx, delta_diff``. Each series is reduced to
    its two matrices once; iterations then run in parallel on copies of them.
    """
    series = list(series)
    flat = series_moments(df, order, series, vector, bounded).groupBy(*series).agg(
        F.max("n").alias("n"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == VALUES, F.struct("i", "covariance")))).alias("c"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == DIFFERENCES, F.struct("i", "covariance")))).alias("d"),
    )
    last_chunk = (n_iterations - 1) // iterations_per_task
    work = flat.select(
        *series, "n", F.col("c.covariance").alias("c"), F.col("d.covariance").alias("d"),
        F.explode(F.sequence(F.lit(0), F.lit(last_chunk))).alias("chunk"),
    )
    in_chunk = F.sequence(
        F.col("chunk") * iterations_per_task,
        F.least((F.col("chunk") + 1) * iterations_per_task, F.lit(n_iterations)) - 1,
    )
    ids = F.sequence(F.lit(0), F.lit(n_labels - 1))
    orders = F.transform(
        in_chunk,
        lambda it: F.transform(
            F.array_sort(
                F.transform(
                    ids, lambda i: F.struct(_order_key(it.cast("long"), i, seed).alias("h"), i.alias("i"))
                )
            ),
            lambda s: s["i"],
        ),
    )
    spread = spread_work(work, [*series, "chunk"]).withColumn("orders", orders)
    schema = T.StructType(
        [df.schema[c] for c in series]
        + [
            T.StructField("iteration", T.LongType()),
            T.StructField("label_idx", T.IntegerType()),
            T.StructField("delta_diff", T.DoubleType()),
        ]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                c, d = (np.vstack(row[m]) if len(row[m]) else np.zeros((n_labels, n_labels)) for m in ("c", "d"))
                chosen = np.vstack(row["orders"])
                first = row["chunk"] * iterations_per_task
                yield pd.DataFrame(
                    {name: [row[name]] * chosen.size for name in series}
                    | {
                        "iteration": np.repeat(np.arange(first, first + len(chosen)), n_labels),
                        "label_idx": chosen.ravel().astype("int32"),
                        "delta_diff": prefix_gains(c, d, int(row["n"]), chosen).ravel(),
                    }
                )

    return spread.mapInPandas(run, schema)


def mean_label_gains(gains: DataFrame, labels: DataFrame, series: list[str] = ("series",)) -> DataFrame:
    """Mean gain per label over all iterations, with the label's text: ``series.., label_idx, label, mean_delta_diff``."""
    means = gains.groupBy(*series, "label_idx").agg(F.avg("delta_diff").alias("mean_delta_diff"))
    return means.join(labels, "label_idx").select(*series, "label_idx", "label", "mean_delta_diff")
