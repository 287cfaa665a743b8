"""Amplitude spectra of ordered scalar series."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slowtide.functions.text import period_of_frequency
from slowtide.operators.ordered import row_index
from slowtide.operators.skew import join_null_safe

MAX_FFT_ROWS = 1 << 20


def _four_step(rows: DataFrame, series: list[str], pairs: list[tuple[str, str]]) -> DataFrame:
    """Fourier transforms of length n1 · n2, from ``series.., n, n1, n2, idx`` and (real, imaginary) columns.

    Positions without a row are zero. Index i1 · n2 + i2 is transformed along i1
    for each i2, turned, and then along i2 for each k1, which gives the
    coefficients k1 + n1 · k2. No task holds more than one such line.
    """
    values = [name for pair in pairs for name in pair]
    long, double = T.LongType(), T.DoubleType()
    keyed = [rows.schema[c] for c in series]
    schema = T.StructType(
        [*keyed, *[T.StructField(c, long) for c in ("n", "n1", "n2", "idx", "line")], *[T.StructField(c, double) for c in values]]
    )

    def line(key: tuple, pdf: pd.DataFrame, first: bool) -> pd.DataFrame:
        n, n1, n2, own = (int(pdf[c].iloc[0]) for c in ("n", "n1", "n2", "line"))
        size = n1 if first else n2
        k = np.arange(size)
        found = {c: np.full(size, pdf[c].iloc[0], dtype=object) for c in series}
        found |= {"n": n, "n1": n1, "n2": n2, "idx": k if first else own + n1 * k, "line": k if first else 0}
        if first:
            found["idx"] = np.full(size, own)
        for re, im in pairs:
            v = np.zeros(size, complex)
            v[pdf["idx"].to_numpy()] = pdf[re].to_numpy() + 1j * pdf[im].to_numpy()
            v = np.fft.fft(v)
            if first:
                v = v * np.exp(-2j * np.pi * ((k * own) % (n1 * n2)) / (n1 * n2))
            found[re], found[im] = v.real, v.imag
        return pd.DataFrame(found)

    keys = [*series, "line"]
    by_column = rows.withColumns({"line": F.col("idx") % F.col("n2"), "idx": F.expr("idx div n2")})
    half = by_column.groupBy(*keys).applyInPandas(lambda key, pdf: line(key, pdf, True), schema)
    return half.groupBy(*keys).applyInPandas(lambda key, pdf: line(key, pdf, False), schema).drop("line")


def _long(df: DataFrame, value: str, order: list[str], series: list[str]) -> DataFrame:
    """Transforms of series that no task could hold: a convolution with a chirp, for any length.

    The coefficients of length n are the convolution of the turned values with
    exp(πi j²/n), up to a turn that does not change amplitudes. Convolutions
    become products after transforms of a power of two of at least 2n.
    """
    indexed = row_index(df.select(*series, *order, F.col(value).cast("double").alias("v")), order, series).where("n >= 2")
    bits = F.ceil(F.log2(F.col("n").cast("double"))).cast("int") + 1
    sized = indexed.withColumn("__bits", bits).select(
        *series, "n", "idx", "v",
        F.expr("shiftleft(cast(1 as bigint), __bits div 2)").alias("n1"),
        F.expr("shiftleft(cast(1 as bigint), __bits - __bits div 2)").alias("n2"),
    )
    angle = F.lit(math.pi) * ((F.col("idx") * F.col("idx")) % (2 * F.col("n"))) / F.col("n")
    turned = sized.select(
        *series, "n", "n1", "n2", "idx",
        (F.col("v") * F.cos(angle)).alias("a_re"), (-F.col("v") * F.sin(angle)).alias("a_im"),
        F.cos(angle).alias("b_re"), F.sin(angle).alias("b_im"),
    )
    zero = F.lit(0.0)
    mirrored = turned.where("idx > 0").withColumns({"idx": F.expr("n1 * n2 - idx"), "a_re": zero, "a_im": zero})
    both = _four_step(turned.unionByName(mirrored), series, [("a_re", "a_im"), ("b_re", "b_im")])
    # the inverse transform is the conjugate of the transform of the conjugate
    product = both.select(
        *series, "n", "n1", "n2", "idx",
        F.expr("a_re * b_re - a_im * b_im").alias("re"), F.expr("-(a_re * b_im + a_im * b_re)").alias("im"),
    )
    found = _four_step(product, series, [("re", "im")]).where("idx < n div 2")
    size = F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")) / (F.col("n1") * F.col("n2"))
    return found.select(
        *series, F.col("idx").cast("int").alias("k"), (F.col("idx") / F.col("n")).alias("frequency"),
        (size * 2 / F.col("n")).alias("amplitude"),
    )


def _fast(df: DataFrame, value: str, order: list[str], series: list[str]) -> DataFrame:
    """One fast transform per series."""
    schema = T.StructType(
        [df.schema[c] for c in series]
        + [
            T.StructField("k", T.IntegerType()),
            T.StructField("frequency", T.DoubleType()),
            T.StructField("amplitude", T.DoubleType()),
        ]
    )

    def transform(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values(order)[value].to_numpy(dtype=float)
        half = len(y) // 2
        k = np.arange(half)
        found = {name: np.full(half, v, dtype=object) for name, v in zip(series, key)}
        amplitude = 2.0 / len(y) * np.abs(np.fft.rfft(y)[:half])
        return pd.DataFrame(found | {"k": k.astype("int32"), "frequency": k / len(y), "amplitude": amplitude})

    slim = df.select(*dict.fromkeys([*series, *order]), F.col(value).cast("double").alias(value))
    return slim.groupBy(*series).applyInPandas(transform, schema)


def amplitude_spectrum(
    df: DataFrame,
    value: str,
    order: list[str] = ("window_start",),
    series: list[str] = ("series",),
    max_fft_rows: int = MAX_FFT_ROWS,
) -> DataFrame:
    """2/N · |Fourier coefficient| for the frequencies k/N below 1/2, rows one unit apart.

    ``series.., k, frequency, period, amplitude``. Meant for windowed series,
    whose length the calendar limits. Lengths are counted first: a series too
    long for one task takes a transform in two steps of lines instead, whose work
    grows with N log N and which holds no series anywhere. Both give the same
    rows. Rows without a series are one of their own.
    """
    series, order = list(series), list(order)
    rows = df.where(F.col(value).isNotNull())
    sizes = rows.groupBy(*series).agg(F.count(F.lit(1)).alias("__n"))
    longest = sizes.agg(F.max("__n")).first()[0] or 0
    if longest <= max_fft_rows:
        found = _fast(rows, value, order, series)
    else:
        counted = join_null_safe(rows, sizes, series)
        short, long = (counted.where(c).drop("__n") for c in (f"__n <= {max_fft_rows}", f"__n > {max_fft_rows}"))
        found = _fast(short, value, order, series).unionByName(_long(long, value, order, series))
    return found.withColumn("period", period_of_frequency(F.col("frequency")))
