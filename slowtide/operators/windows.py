"""Pooling of vectors and texts in time windows."""

import math
import re
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from slowtide.functions.vectors import check_dims, vector_sum
from slowtide.operators.ordered import running_total
from slowtide.operators.skew import lookup_join
from slowtide.session import write_once

UNITS = {
    "us": timedelta(microseconds=1),
    "ms": timedelta(milliseconds=1),
    "s": timedelta(seconds=1),
    "m": timedelta(minutes=1),
    "h": timedelta(hours=1),
    "d": timedelta(days=1),
    "w": timedelta(weeks=1),
}
MAX_TEXT_BYTES = 64 << 20


class Span:
    """A window length such as ``1d``, ``1w`` or ``36h``."""

    def __init__(self, text: str):
        found = re.fullmatch(r"(\d+)(us|ms|s|m|h|d|w)", text)
        if not found or int(found[1]) == 0:
            raise ValueError(f"not a duration: {text!r}")
        self.length = int(found[1]) * UNITS[found[2]]
        # Weeks start on Monday; day 0 of the epoch is a Thursday.
        self.offset = timedelta(days=4) if found[2] == "w" else timedelta(0)

    @property
    def micros(self) -> int:
        return self.length // timedelta(microseconds=1)

    @staticmethod
    def of_micros(micros: int, offset: timedelta) -> "Span":
        """A span that no text names."""
        span = Span("1us")
        span.length, span.offset = timedelta(microseconds=micros), offset
        return span

    @property
    def sql(self) -> str:
        return f"{self.micros} microseconds"

    def start_of(self, ts: Column) -> Column:
        """Start of the tumbling window that holds ``ts``."""
        offset = f"{self.offset // timedelta(microseconds=1)} microseconds"
        return F.window(ts, self.sql, self.sql, offset).getField("start")


def _interval(micros: Column) -> Column:
    seconds = (micros.cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)")
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def _steps(rows: DataFrame, every: Span, period: Span, time: str) -> tuple[DataFrame, Column]:
    """Add ``__step``, the start of the finest step that tiles all windows, and ``__last``, the latest
    window start at or before it; and an expression for the starts of all windows that hold a step."""
    step = Span.of_micros(math.gcd(every.micros, period.micros), every.offset)
    cut = rows.withColumn("__step", step.start_of(F.col(time))).withColumn("__last", every.start_of(F.col(time)))
    # windows start at __last, __last - every, .. as long as they reach the end of the step
    since = F.expr("timestampdiff(MICROSECOND, __last, __step)")
    n = F.floor((F.lit(period.micros - step.micros) - since) / F.lit(every.micros)).cast("int") + 1
    back = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.col("__last") - _interval(i * F.lit(every.micros)))
    return cut, F.when(n > 0, back).otherwise(F.array().cast("array<timestamp_ntz>"))


def _open_windows(steps: DataFrame, firsts: DataFrame, starts: Column, series: list[str]) -> DataFrame:
    """Copy steps to their windows ``window_start``, without windows that start before the first step of their series.

    The first window of a series opens at its first row's step, the least ``__last`` in ``firsts``. Only
    one row per series is joined: no task holds a series' windows.
    """
    opened = lambda rows: rows.withColumn("window_start", F.explode(F.filter(starts, lambda s: s >= F.col("__first")))).drop("__first")
    if not series:
        return opened(steps.crossJoin(F.broadcast(firsts.agg(F.min("__last").alias("__first")))))
    # a struct of nulls equals itself: rows without a series are one of their own
    key = F.struct(*series)
    first = write_once(firsts.groupBy(*series).agg(F.min("__last").alias("__first")).select(key.alias("__series"), "__first"), "first-steps")
    size = first.agg(F.coalesce(F.sum(F.octet_length(F.to_json("__series")) + 64), F.lit(0))).first()[0]
    return opened(lookup_join(steps.withColumn("__series", key), first, ["__series"], ["__step"], dim_bytes=size).drop("__series"))


def _mean(total: str, n: str) -> Column:
    return F.transform(total, lambda x: x / F.col(n)).cast("array<float>")


def pool_windows(
    df: DataFrame,
    every: str,
    period: str | None = None,
    series: list[str] = ("series",),
    time: str = "date",
    vector: str = "embedding",
    dims: int | None = None,
) -> DataFrame:
    """Mean vector per time window: ``series.., window_start, n, embedding``.

    With ``dims`` a vector of another length is an error that names its row.

    Windows are [start, start + period), on the grid of ``every``; windows
    without rows are absent. Rows without a vector are left out. Sums form
    before the shuffle, so a series with most of the rows costs no more than
    another; overlapping windows copy the sums of the finest step that tiles
    them, never rows.
    """
    series = list(series)
    step, length = Span(every), Span(period or every)
    rows = df.select(*series, time, vector).where(F.col(vector).isNotNull())
    if dims is not None:
        rows = rows.withColumn(vector, check_dims(F.col(vector), dims, F.concat_ws(" ", *[F.col(c).cast("string") for c in [*series, time]])))
    total, count = vector_sum(F.col(vector)).alias("total"), F.count(F.lit(1)).alias("n")
    if length.micros == step.micros:
        sums = rows.withColumn("window_start", step.start_of(F.col(time))).groupBy(*series, "window_start").agg(total, count)
    else:
        cut, starts = _steps(rows, step, length, time)
        steps = write_once(cut.groupBy(*series, "__step", "__last").agg(total, count), "step-sums")
        copied = _open_windows(steps, steps, starts, series)
        sums = copied.groupBy(*series, "window_start").agg(vector_sum(F.col("total")).alias("total"), F.sum("n").alias("n"))
    return sums.select(*series, "window_start", "n", _mean("total", "n").alias(vector))


def join_texts(
    df: DataFrame,
    every: str,
    period: str | None = None,
    series: list[str] = ("series",),
    time: str = "date",
    text: str = "msg",
    order: list[str] = ("msg_id",),
    max_bytes: int = MAX_TEXT_BYTES,
) -> DataFrame:
    """Texts of each window in time order: ``series.., window_start, part, msg``.

    Texts are separated by one blank; null texts are left out. A window's text
    comes in parts whose concatenation in the order of ``part`` (with a blank) is
    the whole: a new part begins when the window's own bytes so far pass a
    multiple of ``max_bytes``, so a window below it is one row, part 0, whatever
    the other windows hold. Texts are joined per step first; overlapping windows
    copy the steps' texts.
    """
    series, order = list(series), list(order)
    step, length = Span(every), Span(period or every)
    rows = df.select(*series, time, *[c for c in order if c != time], text).where(F.col(text).isNotNull())
    cut, starts = _steps(rows, step, length, time)
    keys = [*series, "__step", "__last"]
    sized = running_total(cut.withColumn("__bytes", (F.octet_length(text) + 1).cast("long")), "__bytes", [time, *order], keys)
    by = ", ".join(f"`{c}`" for c in [time, *order])
    joined = F.expr(f"listagg(`{text}`, ' ') within group (order by {by})").alias(text)
    steps = (
        sized.withColumn("part", F.expr(f"before div {int(max_bytes)}"))
        .groupBy(*keys, "part")
        .agg(joined, F.sum("__bytes").alias("__bytes"))
    )
    if length.micros == step.micros:
        return _numbered(steps.withColumnRenamed("__step", "window_start"), [*series, "window_start"], text)
    opened = _open_windows(steps, sized, starts, series)
    window = [*series, "window_start"]
    # a window's steps and their parts: a few rows
    before = F.sum("__bytes").over(W.partitionBy(*window).orderBy("__step", "part")) - F.col("__bytes")
    joined = F.expr(f"listagg(`{text}`, ' ') within group (order by __step, __nth)").alias(text)
    placed = opened.withColumn("__before", before).withColumnRenamed("part", "__nth")
    parts = placed.withColumn("part", F.expr(f"__before div {int(max_bytes)}")).groupBy(*window, "part").agg(joined)
    return _numbered(parts, window, text)


def _numbered(parts: DataFrame, window: list[str], text: str) -> DataFrame:
    """Parts of each window numbered from 0 without gaps."""
    number = F.row_number().over(W.partitionBy(*window).orderBy("part")) - 1
    return parts.select(*window, number.alias("part"), text)


def time_scale_means(
    df: DataFrame,
    max_days: int = 30,
    series: list[str] = ("series",),
    time: str = "date",
    vector: str = "embedding",
) -> DataFrame:
    """Mean vectors in windows of 1, 2, .. ``max_days`` days, all at once.

    ``series.., days, window_start (epoch day), n, embedding``. Rows are summed
    per day first; only day sums are copied to the ``max_days`` grids.
    """
    series = list(series)
    daily = (
        df.where(F.col(vector).isNotNull())
        .withColumn("__day", F.unix_date(F.col(time).cast("date")))
        .groupBy(*series, "__day")
        .agg(vector_sum(F.col(vector)).alias("total"), F.count(F.lit(1)).alias("n"))
    )
    grids = daily.withColumn("days", F.explode(F.sequence(F.lit(1), F.lit(max_days))))
    start = (F.floor(F.col("__day") / F.col("days")) * F.col("days")).cast("int")
    return (
        grids.withColumn("window_start", start)
        .groupBy(*series, "days", "window_start")
        .agg(vector_sum(F.col("total")).alias("total"), F.sum("n").alias("n"))
        .select(
            *series, "days", "window_start", "n",
            _mean("total", "n").alias(vector),
        )
    )
