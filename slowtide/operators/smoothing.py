"""Gaussian-process smoothing of many series of any length.

The squared-exponential kernel of a series on a stretch of time is, to machine
precision, a sum over m sine waves of a wider stretch, m being proportional to
the stretch over the smallest length scale. In that form a series of n
rows is known to every length scale and amplitude by one m × m matrix, one vector of
m sums and two numbers: sums over rows, which tasks form for their part and add
up. Series of at most m rows are solved on their own n × n kernel instead; both
forms give the same numbers.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slowtide.functions.text import epoch_days
from slowtide.operators.moments import plain_arrow_schema
from slowtide.operators.skew import join_null_safe, spread_work
from slowtide.session import write_once

AMPLITUDES = tuple(float(a) for a in np.logspace(-3, 3, 61))
#: The highest frequency in units of 1 / length scale, and the margin on either side in units of the largest
#: length scale: what is left out is below exp(-37) of the kernel, what is mirrored in below exp(-40).
HIGHEST, MARGIN = 8.6, 4.5
#: Length scales tried first, evenly in their logarithm, and golden-section steps around the best of them.
FIRST, STEPS = 9, 18
#: Rows of a long series that one task sums up or places on its curve.
PART_ROWS = 100_000


def likelihoods(t: np.ndarray, y: np.ndarray, length_scale: float, noise: float) -> np.ndarray:
    """Log marginal likelihood for each of ``AMPLITUDES``, from the kernel of the rows."""
    values, _, along = _spectrum(t, y, length_scale)
    total = np.array(AMPLITUDES)[:, None] * values + noise
    return -0.5 * ((along**2 / total).sum(1) + np.log(total).sum(1) + len(y) * np.log(2 * np.pi))


def _spectrum(t: np.ndarray, y: np.ndarray, length_scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues and axes of the kernel at ``t``, and ``y`` along the axes."""
    gaps = (t[:, None] - t[None, :]) / length_scale
    values, axes = np.linalg.eigh(np.exp(-0.5 * gaps * gaps))
    return np.clip(values, 0.0, None), axes, axes.T @ y


def posterior_at(
    t: np.ndarray, y: np.ndarray, length_scale: float, amplitude: float, noise: float
) -> tuple[np.ndarray, np.ndarray]:
    """Posterior mean and deviation of the latent curve at ``t``."""
    values, axes, along = _spectrum(t, y, length_scale)
    signal = amplitude * values
    mean = axes @ (signal / (signal + noise) * along)
    # variance of the latent curve: signal · noise / (signal + noise) along each axis
    variance = (axes**2) @ (signal * noise / (signal + noise))
    return mean, np.sqrt(np.clip(variance, 0.0, None))


def best_fit(fits: Callable[[float], np.ndarray], bounds: tuple[float, float]) -> tuple[float, float]:
    """Length scale within bounds and amplitude of largest likelihood; ``fits`` gives one per amplitude.

    The length scale is continuous: a golden-section search around the best of
    ``FIRST`` values. Ties go to what was tried first, that is the smaller one.
    """
    tried: dict[float, tuple[float, int]] = {}

    def profile(x: float) -> float:
        found = fits(math.exp(x))
        at = int(np.argmax(found))
        tried[x] = float(found[at]), at
        return tried[x][0]

    low, high = math.log(bounds[0]), math.log(bounds[1])
    first = np.linspace(low, high, FIRST if high > low else 1).tolist()
    values = [profile(x) for x in first]
    top = int(np.argmax(values))
    a, b = first[max(top - 1, 0)], first[min(top + 1, len(first) - 1)]
    ratio = (math.sqrt(5) - 1) / 2
    if b > a:
        x1, x2 = b - ratio * (b - a), a + ratio * (b - a)
        y1, y2 = profile(x1), profile(x2)
        for _ in range(STEPS):
            if y1 >= y2:
                b, x2, y2 = x2, x1, y1
                x1 = b - ratio * (b - a)
                y1 = profile(x1)
            else:
                a, x1, y1 = x1, x2, y2
                x2 = a + ratio * (b - a)
                y2 = profile(x2)
    best = max(tried, key=lambda x: tried[x][0])
    # a fixed length scale stays as given
    scale = bounds[0] if best == low else bounds[1] if best == high else math.exp(best)
    return scale, AMPLITUDES[tried[best][1]]


class Waves:
    """Sine waves on the stretch from ``low`` to ``high`` days with margins, for length scales within bounds."""

    def __init__(self, low: float, high: float, bounds: tuple[float, float]):
        self.half = (high - low) / 2 + MARGIN * bounds[1]
        self.start = (low + high) / 2 - self.half
        self.count = math.ceil(HIGHEST / bounds[0] * 2 * self.half / math.pi)
        self.frequency = np.arange(1, self.count + 1) * (math.pi / (2 * self.half))

    def at(self, t: np.ndarray, count: int | None = None) -> np.ndarray:
        """n × m values of the waves."""
        return np.sin((t - self.start)[:, None] * self.frequency[None, :count]) / math.sqrt(self.half)

    def weights(self, length_scale: float) -> np.ndarray:
        """Square roots of the kernel's share of each wave; only those that count at this length scale."""
        x = self.frequency * length_scale
        x = x[x <= HIGHEST] if (x <= HIGHEST).any() else x[:1]
        return np.sqrt(length_scale * math.sqrt(2 * math.pi)) * np.exp(-0.25 * x * x)


class Sums:
    """What a series of any length is to its fits: sums over its rows."""

    def __init__(self, n: int, square: float, along: np.ndarray, gram: np.ndarray):
        self.n, self.square, self.along, self.gram = n, square, along, gram

    @classmethod
    def of_rows(cls, waves: Waves, t: np.ndarray, y: np.ndarray) -> Sums:
        total = cls(0, 0.0, np.zeros(waves.count), np.zeros((waves.count, waves.count)))
        for first in range(0, len(t), 4096):
            values, own = waves.at(t[first : first + 4096]), y[first : first + 4096]
            total += cls(len(own), float(own @ own), values.T @ own, values.T @ values)
        return total

    def __add__(self, other: Sums) -> Sums:
        return Sums(self.n + other.n, self.square + other.square, self.along + other.along, self.gram + other.gram)

    def _spectrum(self, waves: Waves, length_scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        weights = waves.weights(length_scale)
        m = len(weights)
        values, axes = np.linalg.eigh(weights[:, None] * self.gram[:m, :m] * weights)
        return weights, np.clip(values, 0.0, None), axes, axes.T @ (weights * self.along[:m])

    def likelihoods(self, waves: Waves, length_scale: float, noise: float) -> np.ndarray:
        """As ``likelihoods`` of the rows."""
        _, values, _, along = self._spectrum(waves, length_scale)
        amplitude = np.array(AMPLITUDES)[:, None]
        total = amplitude * values + noise
        squares = (self.square - (amplitude * along**2 / total).sum(1)) / noise
        logs = np.log(total / noise).sum(1) + self.n * np.log(2 * np.pi * noise)
        return -0.5 * (squares + logs)

    def curve(self, waves: Waves, length_scale: float, amplitude: float, noise: float) -> tuple[np.ndarray, np.ndarray]:
        """Coefficients of the posterior mean, and a matrix whose product with the waves has the deviation as length."""
        weights, values, axes, along = self._spectrum(waves, length_scale)
        total = amplitude * values + noise
        mean = weights * (axes @ (amplitude * along / total))
        return mean, weights[:, None] * axes * np.sqrt(noise * amplitude / total)


def wave_count(low: Column, high: Column, bounds: tuple[float, float]) -> Column:
    """``Waves.count`` as a column."""
    return F.ceil(HIGHEST / bounds[0] * (high - low + 2 * MARGIN * bounds[1]) / math.pi)


def smooth(
    df: DataFrame,
    value: str,
    time: str = "window_start",
    series: list[str] = ("series",),
    bounds: tuple[float, float] = (10.0, 100.0),
    noise: float = 1.0,
) -> DataFrame:
    """Smooth each series with an RBF process: ``series.., day, length_scale, mean, lower, upper``.

    The length scale (in days, anywhere within ``bounds``) and amplitude (ten per decade)
    of largest marginal likelihood are taken; lower and upper are mean ∓ 1.96
    deviations. One rule at every length: a series is solved on its rows while these are
    fewer than the waves of its stretch of time, else on sums over its rows, with equal
    results. Work and memory of a fit depend on the calendar (days over the
    smallest length scale), not on the number of rows. Rows without a value are left
    out; rows without a series are one of their own.
    """
    series, bounds = list(series), (float(bounds[0]), float(bounds[1]))
    rows = df.where(F.col(value).isNotNull()).select(
        *series, epoch_days(F.col(time)).alias("day"), F.col(value).cast("double").alias("y")
    )
    rows = write_once(rows, "smoothing-rows")
    spans = rows.groupBy(*series).agg(F.count(F.lit(1)).alias("__n"), F.min("day").alias("__low"), F.max("day").alias("__high"))
    spans = spans.withColumn("__long", F.col("__n") > wave_count(F.col("__low"), F.col("__high"), bounds))
    placed = write_once(join_null_safe(rows, spans, series), "smoothing-spans")
    keyed = [df.schema[c] for c in series]
    result = T.StructType([*keyed, *[T.StructField(c, T.DoubleType()) for c in ("day", "length_scale", "mean", "lower", "upper")]])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["day", "y"])
        t, y = pdf["day"].to_numpy(), pdf["y"].to_numpy()
        scale, amplitude = best_fit(lambda s: likelihoods(t, y, s, noise), bounds)
        return _curve(pdf[[*series, "day"]], scale, *posterior_at(t, y, scale, amplitude, noise))

    short = spread_work(placed.where(~F.col("__long")).select(*series, "day", "y"), series)
    solved = short.groupBy(*series).applyInPandas(solve, result)
    return solved.unionByName(_smooth_long(placed.where("__long"), series, keyed, result, bounds, noise))


def _curve(rows: pd.DataFrame, scale: float, mean: np.ndarray, deviation: np.ndarray) -> pd.DataFrame:
    reach = 1.96 * deviation
    return rows.assign(length_scale=scale, mean=mean, lower=mean - reach, upper=mean + reach)


def _smooth_long(
    rows: DataFrame, series: list[str], keyed: list[T.StructField], result: T.StructType, bounds: tuple[float, float], noise: float
) -> DataFrame:
    """The series with more rows than waves: sums by parts of rows, one fit per series, curves by parts."""
    parts = F.ceil(F.col("__n") / PART_ROWS)
    rows = rows.withColumns({"__parts": parts, "__part": F.pmod(F.xxhash64("day", "y"), parts)})
    numbers = T.ArrayType(T.DoubleType())
    one = [T.StructField(c, T.DoubleType()) for c in ("__low", "__high")]
    summed = T.StructType(
        [*keyed, *one, T.StructField("parts", T.LongType()), T.StructField("n", T.LongType()), T.StructField("square", T.DoubleType())]
        + [T.StructField("along", numbers), T.StructField("gram", numbers)]
    )
    fitted = T.StructType(
        [*keyed, *one, T.StructField("parts", T.LongType()), T.StructField("length_scale", T.DoubleType())]
        + [T.StructField("along", numbers), T.StructField("gram", numbers)]
    )
    sent, kept = plain_arrow_schema(summed), plain_arrow_schema(fitted)
    columns = [*series, "__part", "__parts", "__low", "__high", "day", "y"]

    def waves_of(batch: pa.RecordBatch | pa.Table) -> Waves:
        return Waves(batch.column("__low")[0].as_py(), batch.column("__high")[0].as_py(), bounds)

    def add(table: pa.Table) -> pa.Table:
        table = table.sort_by([("day", "ascending"), ("y", "ascending")])
        own = Sums.of_rows(waves_of(table), table["day"].to_numpy(), table["y"].to_numpy())
        head = [table[c][0].as_py() for c in (*series, "__low", "__high", "__parts")]
        row = [*head, own.n, own.square, own.along, own.gram.ravel()]
        return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip(row, sent)], schema=sent)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = waves = total = None
        for batch in batches:
            head = head or [batch.column(c)[0].as_py() for c in (*series, "__low", "__high", "parts")]
            waves = waves or waves_of(batch)
            for i in range(batch.num_rows):
                along, gram = (np.array(batch.column(c)[i].values) for c in ("along", "gram"))
                own = Sums(batch.column("n")[i].as_py(), batch.column("square")[i].as_py(), along, gram.reshape(waves.count, -1))
                total = own if total is None else total + own
        scale, amplitude = best_fit(lambda s: total.likelihoods(waves, s, noise), bounds)
        mean, root = total.curve(waves, scale, amplitude, noise)
        row = [*head, scale, mean, root.ravel()]
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, kept)], schema=kept)

    def place(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        model = right.iloc[0]
        waves, mean = Waves(model["__low"], model["__high"], bounds), np.asarray(model["along"])
        root, t = np.asarray(model["gram"]).reshape(len(mean), -1), left["day"].to_numpy()
        found = []
        for first in range(0, len(t), 4096):
            values = waves.at(t[first : first + 4096], len(mean))
            found.append((values @ mean, np.sqrt(((values @ root) ** 2).sum(1))))
        means, deviations = (np.concatenate(c) for c in zip(*found))
        return _curve(left[[*series, "day"]], model["length_scale"], means, deviations)

    sums = rows.select(*columns).groupBy(*series, "__part").applyInArrow(add, summed)
    models = write_once(spread_work(sums, series).groupBy(*series).applyInArrow(fit, fitted), "smoothing-models")
    # a model goes to each part of its series: one row per part, not per row of data
    dealt = models.withColumn("__for", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    dealt = dealt.select(*[F.col(c).alias(f"__model_{c}") for c in series], "__for", "__low", "__high", "length_scale", "along", "gram")
    points = rows.select(*series, "__part", "day")
    return points.groupBy(*series, "__part").cogroup(dealt.groupBy(*[f"__model_{c}" for c in series], "__for")).applyInPandas(place, result)
