"""Column expressions and aggregates over vector (array) columns."""

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slowtide.functions.text import bind


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays, summed as doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, p: acc + p)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x - y)


def scale(a: Column, factor: Column) -> Column:
    return F.transform(a, lambda x: x * factor)


def affine(v: Column, matrix: Column, centre: Column) -> Column:
    """matrix · (v − centre), with the matrix as an array of rows."""
    shifted = subtract(v, centre)
    return F.transform(matrix, lambda row: dot(row, shifted))


def map_vector(
    df: DataFrame,
    column: str,
    f,
    target: str | None = None,
    split: int | None = None,
) -> DataFrame:
    """Apply ``f`` (Column -> array Column) to a vector column.

    The result replaces the column, or goes to ``target``; with ``split=k`` its
    first k entries become the columns ``target_0 .. target_{k-1}`` instead.
    """
    target = target or column
    if split is None:
        return df.withColumn(target, f(F.col(column)))
    held = f"__{target}"
    return (
        df.withColumn(held, f(F.col(column)))
        .withColumns({f"{target}_{i}": F.get(F.col(held), F.lit(i)) for i in range(split)})
        .drop(held)
    )


def check_dims(v: Column, dims: int, row_key: Column) -> Column:
    """The vector itself; an error naming the row if it has another length."""
    complaint = F.concat(F.lit(f"vector length is not {dims} in row "), row_key.cast("string"))
    return F.when(v.isNull() | (F.size(v) == dims), v).otherwise(F.raise_error(complaint).cast("array<float>"))


def whole(v: Column) -> Column:
    """The vector as doubles; an error if one of its entries is null."""
    no_entry = F.raise_error(F.lit("a vector has a null entry")).cast("array<double>")
    return F.when(F.exists(v, lambda x: x.isNull()), no_entry).otherwise(doubles(v))


def _vec(v: Column) -> Column:
    return array_to_vector(whole(v))


def vector_sum(v: Column) -> Column:
    """Element-wise sum; partial sums are formed before the shuffle.

    ``Summarizer`` derives its sums from running means, whose rounding depends
    on the order of rows. Its L1 norm is a plain sum of magnitudes: taken of the
    positive and the negative parts it gives sums of doubles. They are exact, and
    so the same under any partitioning, as long as the entries are floats whose
    magnitudes times the number of rows span less than 2**29; beyond, the last
    bits may differ.
    """
    v = whole(v)
    part = lambda sign: F.transform(v, lambda x: F.greatest(x * sign, F.lit(0.0)))
    norms = vector_to_array(Summarizer.normL1(array_to_vector(F.concat(part(1), part(-1)))))
    half = lambda n: (F.size(n) / 2).cast("int")
    return bind(
        norms, lambda n: F.zip_with(F.slice(n, 1, half(n)), F.slice(n, half(n) + 1, half(n)), lambda p, q: p - q)
    )


def vector_mean(v: Column, weight: Column | None = None) -> Column:
    """Element-wise mean; partial means are formed before the shuffle."""
    return vector_to_array(Summarizer.mean(_vec(v), weight))


def vector_variance(v: Column, weight: Column | None = None) -> Column:
    """Element-wise sample variance."""
    return vector_to_array(Summarizer.variance(_vec(v), weight))
