"""Operators on ordered rows: first rows, previous row, differences."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from slowtide.functions.vectors import subtract, vector_variance
from slowtide.operators.skew import join_null_safe
from slowtide.session import write_once

MAX_SERIES_ROWS = 5_000_000
#: Rows worth a run of their own while there are fewer runs than shuffle partitions; rows may hold texts.
RUN_ROWS = 10_000


def first_rows(df: DataFrame, k: int, order: list[str], series: list[str] = ("series",)) -> DataFrame:
    """The first k rows of each series; each task forwards at most k rows per series."""
    rank = F.row_number().over(W.partitionBy(*series).orderBy(*order))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= k).drop("__rank")


def sorted_runs(df: DataFrame, order: list[str], n_runs: int) -> DataFrame:
    """Cut rows into ``n_runs`` runs: all rows of run i sort before those of run i + 1.

    Runs come from range partitioning on the whole sort key, so they are about
    equal in size even if one series, or one moment, holds most rows. Range
    bounds are sampled, hence the run numbers are stored before use.
    """
    ranged = df.repartitionByRange(n_runs, *order).withColumn("run", F.spark_partition_id())
    return write_once(ranged, "runs")


def _sizes(df: DataFrame, series: list[str]) -> tuple[int, int]:
    """Number of rows in all, and in the longest series."""
    counts = df.groupBy(*series).agg(F.count(F.lit(1)).alias("rows"))
    total, longest = counts.agg(F.sum("rows"), F.max("rows")).first()
    return total or 0, longest or 0


def with_previous(
    df: DataFrame,
    values: dict[str, str],
    order: list[str],
    series: list[str] = ("series",),
    bounded: bool = False,
    max_series_rows: int = MAX_SERIES_ROWS,
) -> DataFrame:
    """Add columns with the value of the previous row of the series (null in its first row).

    ``values`` maps new names to column names. ``bounded`` says that a series
    cannot be long, as after windowing, where the calendar limits it. Otherwise
    the longest series is counted; if it is too long for one task, rows are cut
    into sorted runs, each run looks back within itself, and the last row of a
    run is handed to the first row of the next.
    """
    series, order = list(series), list(order)

    def look_back(within: list[str]) -> dict[str, Column]:
        frame = W.partitionBy(*within).orderBy(*order)
        return {name: F.lag(column).over(frame) for name, column in values.items()}

    if bounded:
        return df.withColumns(look_back(series))
    rows, longest = _sizes(df, series)
    if longest <= max_series_rows:
        return df.withColumns(look_back(series))

    runs = sorted_runs(df, [*series, *order], -(-rows // max_series_rows))
    keys = [*series, "run"]
    ends = runs.groupBy(*keys).agg(
        F.max_by(F.struct(*[F.col(c) for c in values.values()]), F.struct(*order)).alias("__end")
    )
    # one row per (series, run): as many as there are partitions, at most
    handed = ends.select(*keys, F.lag("__end").over(W.partitionBy(*series).orderBy("run")).alias("__handed"))
    frame = W.partitionBy(*keys).orderBy(*order)
    looked = runs.withColumns(look_back(keys)).withColumn("__first", F.row_number().over(frame) == 1)
    joined = join_null_safe(looked, handed, keys)
    return joined.withColumns(
        {
            name: F.when(F.col("__first"), F.col("__handed").getField(column)).otherwise(F.col(name))
            for name, column in values.items()
        }
    ).drop("run", "__first", "__handed")


def consecutive_differences(
    df: DataFrame,
    order: list[str],
    series: list[str] = ("series",),
    vector: str = "embedding",
    target: str = "diff",
    bounded: bool = False,
    max_series_rows: int = MAX_SERIES_ROWS,
) -> DataFrame:
    """Add the difference to the previous row's vector (null in the first row of a series)."""
    looked = with_previous(df, {"__previous": vector}, order, series, bounded, max_series_rows)
    return looked.withColumn(target, subtract(F.col(vector), F.col("__previous"))).drop("__previous")


def dimension_slowness(
    df: DataFrame, series: list[str] = ("series",), vector: str = "embedding", diff: str = "diff"
) -> DataFrame:
    """Per dimension: variance of the differences over the variance of the values.

    ``series.., dim, delta``; null where a dimension never changes.
    """
    # a first row has no difference: weight zero leaves it out
    has_diff = F.when(F.col(diff).isNull(), 0.0).otherwise(1.0)
    no_change = F.transform(F.col(vector), lambda x: F.lit(0.0))
    spread = df.groupBy(*series).agg(
        vector_variance(F.col(vector)).alias("var_x"),
        vector_variance(F.coalesce(F.col(diff), no_change), has_diff).alias("var_d"),
    )
    pairs = F.posexplode(F.arrays_zip("var_x", "var_d")).alias("dim", "v")
    return spread.select(*series, pairs).select(
        *series, "dim", (F.col("v.var_d") / F.nullif(F.col("v.var_x"), F.lit(0.0))).alias("delta")
    )


def dimension_variance(df: DataFrame, series: list[str] = ("series",), vector: str = "embedding") -> DataFrame:
    """Population variance of each vector dimension: ``series.., dim, variance``."""
    spread = df.groupBy(*series).agg(
        vector_variance(F.col(vector)).alias("v"), F.count(F.lit(1)).alias("n")
    )
    return spread.select(*series, "n", F.posexplode("v").alias("dim", "v")).select(
        *series, "dim", (F.col("v") * (F.col("n") - 1) / F.col("n")).alias("variance")
    )


def row_index(
    df: DataFrame, order: list[str], series: list[str] = ("series",), max_run_rows: int = MAX_SERIES_ROWS
) -> DataFrame:
    """Add the position ``idx`` (from 0) of each row in its series and the series' length ``n``.

    Rows without a series form a series of their own.
    """
    found = running_total(df.withColumn("__one", F.lit(1).cast("long")), "__one", order, series, max_run_rows)
    return found.withColumnsRenamed({"before": "idx", "total": "n"}).drop("__one")


def running_total(
    df: DataFrame, value: str, order: list[str], series: list[str] = ("series",), max_run_rows: int = MAX_SERIES_ROWS
) -> DataFrame:
    """Add ``before``, the sum of ``value`` over the earlier rows of the series, and its ``total``.

    Sums are formed within sorted runs and shifted by the sums of earlier
    runs: no task holds a series, and rows without a series are one of their own.
    """
    series, keys = list(series), [*series, "run"]
    rows, _ = _sizes(df, series)
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_runs = max(1, -(-rows // max_run_rows), min(tasks, -(-rows // RUN_ROWS)))
    runs = sorted_runs(df, [*series, *order], n_runs)
    sizes = runs.groupBy(*keys).agg(F.sum(value).alias("__sum"))
    by_series = W.partitionBy(*series)
    starts = sizes.select(
        *keys,
        (F.sum("__sum").over(by_series.orderBy("run")) - F.col("__sum")).alias("__start"),
        F.sum("__sum").over(by_series).alias("total"),
    )
    frame = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    looked = runs.withColumn("__through", F.sum(value).over(frame))
    before = F.col("__start") + F.col("__through") - F.col(value)
    return join_null_safe(looked, starts, keys).withColumn("before", before).drop("run", "__start", "__through")
