"""Principal components and slow features: fitting from moments, applying to tables."""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slowtide.functions.spectra import Factors, fix_signs, retained_count
from slowtide.functions.vectors import affine, map_vector
from slowtide.operators.moments import BLOCK_ROWS, DIFFERENCES, VALUES, Partial, matrix_of, moments, plain_arrow_schema
from slowtide.operators.ordered import consecutive_differences
from slowtide.operators.skew import BROADCAST_BYTES, lookup_join, spread_work

VECTOR = T.ArrayType(T.DoubleType())
MATRIX = T.ArrayType(VECTOR)
Fit = Callable[[Factors], dict]
#: Numbers of a model from which batches are multiplied as matrices.
WIDE = 4096


def _matrices(table: pa.Table) -> dict[str, np.ndarray]:
    """The covariance matrix of each kind, made symmetric."""
    kinds, places = np.array(table["kind"].to_pylist()), table["i"].to_numpy()
    rows = matrix_of(table["covariance"].combine_chunks())
    found = {}
    for kind in (VALUES, DIFFERENCES):
        own = kinds == kind
        m = rows[own][np.argsort(places[own])]
        found[kind] = (m + m.T) / 2 if own.any() else np.zeros((rows.shape[1], rows.shape[1]))
    return found


def _per_series(moment_rows: DataFrame, series: list[str], fit: Fit, fields: list[T.StructField]) -> DataFrame:
    """Run ``fit`` once per series on its matrix rows (2·d of them at most)."""
    schema = T.StructType([moment_rows.schema[c] for c in series] + fields)
    arrow = plain_arrow_schema(schema)

    def run(table: pa.Table) -> pa.Table:
        first = table["kind"].to_pylist().index(VALUES)
        found = _matrices(table)
        n, mean = table["n"][first].as_py(), np.array(table["mean"][first].as_py())
        values = [table[c][0].as_py() for c in series]
        row = values + list(fit(Factors.of_matrices(n, mean, found[VALUES], found[DIFFERENCES])).values())
        return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip(row, arrow)], schema=arrow)

    return spread_work(moment_rows, series).groupBy(*series).applyInArrow(run, schema)


def _factors_of(batches: Iterator[pa.RecordBatch], series: list[str]) -> tuple[list, Factors]:
    """A series' values and factors from its rows ``series.., x, dx``, one batch at a time.

    What is held is fewer than d rows, or two d × d matrices once there are more.
    """
    head, partials = None, {}
    for batch in batches:
        head = head or [batch.column(i)[0].as_py() for i in range(len(series))]
        for kind in (VALUES, DIFFERENCES):
            column = batch.column(kind).drop_null()
            if not len(column):
                continue
            if column.flatten().null_count:
                raise ValueError(f"a vector with a null entry in series {head}")
            rows = matrix_of(column)
            partials.setdefault(kind, Partial(limit=max(rows.shape[1], BLOCK_ROWS))).add_rows(rows)
    x = partials[VALUES]
    dx = partials.get(DIFFERENCES)
    if x.mean is None and x.waiting < x.width:
        return head, Factors.of_rows(np.concatenate(x.rows), np.concatenate(dx.rows) if dx else np.zeros((0, x.width)))
    c = x.covariance()
    d = dx.covariance() if dx else np.zeros_like(c)
    return head, Factors.of_matrices(x.n, x.mean, (c + c.T) / 2, (d + d.T) / 2)


def _per_windowed_series(
    df: DataFrame, order: list[str], series: list[str], vector: str, fit: Fit, fields: list[T.StructField]
) -> DataFrame:
    """Run ``fit`` once per series on its ordered rows, which the calendar limits.

    One shuffle by series serves the differences and the fit. No matrix is shuffled,
    and a series of fewer rows than dimensions forms none.
    """
    schema = T.StructType([df.schema[c] for c in series] + fields)
    arrow = plain_arrow_schema(schema)
    rows = df.where(F.col(vector).isNotNull()).select(*dict.fromkeys([*series, *order]), F.col(vector).cast(VECTOR).alias(VALUES))
    spread = consecutive_differences(spread_work(rows, series), order, series, VALUES, DIFFERENCES, bounded=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, factors = _factors_of(batches, series)
        row = values + list(fit(factors).values())
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, arrow)], schema=arrow)

    return spread.select(*series, VALUES, DIFFERENCES).groupBy(*series).applyInArrow(run, schema)


def fit_pca(moment_rows: DataFrame, keep: float | int | None = None, series: list[str] = ("series",)) -> DataFrame:
    """Principal components per series, the full spectrum and the reduced basis from one fit.

    ``series.., n, mean, variances, ratios, n_retained, components``; the first
    two arrays have d entries. Nothing is retained beyond the rank of the series, so a
    series without variance (one row, or equal rows) has ratios 0 and retains nothing.
    ``components`` has ``n_retained`` rows, or if ``keep`` is a count, that many (d at
    most), zeros after the retained ones.
    """

    def fit(own: Factors) -> dict:
        variances = own.spectrum
        kept = retained_count(variances, keep, own.n)
        total = variances.sum()
        rows = kept if keep is None or isinstance(keep, float) else min(int(keep), len(variances))
        components = np.zeros((rows, len(variances)))
        components[:kept] = fix_signs(own.axes[:kept])
        return {
            "n": own.n,
            "mean": own.mean.tolist(),
            "variances": variances.tolist(),
            "ratios": (variances / total if total > 0 else variances).tolist(),
            "n_retained": kept,
            "components": components.tolist(),
        }

    fields = [
        T.StructField("n", T.LongType()),
        T.StructField("mean", VECTOR),
        T.StructField("variances", VECTOR),
        T.StructField("ratios", VECTOR),
        T.StructField("n_retained", T.IntegerType()),
        T.StructField("components", MATRIX),
    ]
    return _per_series(moment_rows, list(series), fit, fields)


def _slow_fit(n_components: int, keep: float | int | None, cutoff: float, cutoff_mode: str) -> tuple[Fit, list[T.StructField]]:
    def fit(own: Factors) -> dict:
        deltas, weights, whitening = own.slow_directions(keep, cutoff, cutoff_mode)
        found = min(n_components, len(deltas))
        filled = np.zeros((n_components, len(own.mean)))
        filled[:found] = weights[:found]
        return {
            "n": own.n,
            "mean": own.mean.tolist(),
            "deltas": np.r_[deltas[:found], np.zeros(n_components - found)].tolist(),
            "components": filled.tolist(),
            "n_nontrivial": len(deltas),
            "whitening": whitening.tolist(),
            "variances": own.spectrum.tolist(),
        }

    return fit, [
        T.StructField("n", T.LongType()),
        T.StructField("mean", VECTOR),
        T.StructField("deltas", VECTOR),
        T.StructField("components", MATRIX),
        T.StructField("n_nontrivial", T.IntegerType()),
        T.StructField("whitening", MATRIX),
        T.StructField("variances", VECTOR),
    ]


def fit_sfa(
    moment_rows: DataFrame,
    n_components: int,
    keep: float | int | None = None,
    cutoff: float = 1e-15,
    cutoff_mode: str = "absolute",
    series: list[str] = ("series",),
) -> DataFrame:
    """Slow features per series, from the covariances of its vectors and differences.

    The slowness of a feature is the variance of its differences while its own
    variance is 1; white noise has 2. ``keep`` reduces to leading principal
    components first. Components beyond the non-trivial ones are filled with
    zeros (weights and slowness alike).

    ``series.., n, mean, deltas, components, n_nontrivial, whitening, variances``.
    """
    return _per_series(moment_rows, list(series), *_slow_fit(n_components, keep, cutoff, cutoff_mode))


def fit_windowed_sfa(
    df: DataFrame,
    n_components: int,
    keep: float | int | None = None,
    cutoff: float = 1e-15,
    cutoff_mode: str = "absolute",
    order: list[str] = ("window_start",),
    series: list[str] = ("series",),
    vector: str = "embedding",
) -> DataFrame:
    """``fit_sfa`` straight from the ordered rows of windowed series.

    Each series is one task's, so it must be bounded, as windows are by the calendar. A
    series of n rows in d > n dimensions is fitted in the n directions it spans.
    """
    return _per_windowed_series(df, list(order), list(series), vector, *_slow_fit(n_components, keep, cutoff, cutoff_mode))


def series_moments(
    df: DataFrame,
    order: list[str] = ("window_start",),
    series: list[str] = ("series",),
    vector: str = "embedding",
    bounded: bool = False,
) -> DataFrame:
    """Moments of an ordered series and of its differences (``bounded`` as in ``with_previous``)."""
    rows = df.where(F.col(vector).isNotNull())
    diffs = consecutive_differences(rows, list(order), list(series), vector, "__diff", bounded)
    return moments(diffs, series, vector, "__diff")


def apply_model(
    df: DataFrame,
    models: DataFrame,
    spread_by: list[str],
    series: list[str] = ("series",),
    vector: str = "embedding",
    target: str | None = None,
    split: int | None = None,
    matrix: str = "components",
) -> DataFrame:
    """Map each vector by its series' model: matrix · (vector − mean).

    ``models`` should be a stored table: its size is measured first. It is
    broadcast when small, else joined with hot series salted by ``spread_by``. Small tables
    of wide models (``WIDE`` numbers and more) multiply whole batches of rows at
    once instead of one row at a time; sums may differ in their last bits.
    ``matrix`` may be ``whitening`` to get the whitened axes instead of the slow
    features. Rows of series without a model are left out.
    """
    series = list(series)
    slim = models.select(*series, F.col(matrix).alias("__matrix"), F.col("mean").alias("__mean"))
    numbers = (F.size("__matrix") + 1) * F.size("__mean")
    total, widest = slim.agg(F.sum(numbers), F.max(numbers)).first()
    if widest and widest >= WIDE and 8 * total <= BROADCAST_BYTES:
        return map_vector(_multiplied(df, slim, series, vector), "__mapped", lambda v: v, target or vector, split).drop("__mapped")
    joined = lookup_join(df, slim, series, list(spread_by), dim_bytes=8 * (total or 0))
    mapped = map_vector(
        joined, vector, lambda v: affine(v, F.col("__matrix"), F.col("__mean")), target=target, split=split
    )
    return mapped.drop("__matrix", "__mean")


def _multiplied(df: DataFrame, slim: DataFrame, series: list[str], vector: str) -> DataFrame:
    """Add ``__mapped``, one matrix product per batch and series; the models, few by measure, go with the tasks."""
    found = {
        tuple(row[c] for c in series): (np.array([list(r) for r in row["__matrix"]]), np.array(row["__mean"]))
        for row in slim.collect()
        if all(row[c] is not None for c in series)
    }
    schema = T.StructType([*df.schema.fields, T.StructField("__mapped", VECTOR)])
    names = schema.names
    at = df.columns.index(vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = list(zip(*[batch.column(df_names.index(c)).to_pylist() for c in series]))
            number = {key: i for i, key in enumerate(dict.fromkeys(keys))}
            group = np.fromiter((number[key] for key in keys), np.int64, len(keys))
            present = batch.column(at).is_valid().to_numpy(zero_copy_only=False)
            mapped = np.empty(len(keys), object)
            for key, i in number.items():
                if key not in found:
                    continue
                own, mean = found[key]
                for row in np.flatnonzero((group == i) & ~present):
                    mapped[row] = [None] * len(own)
                rows = np.flatnonzero((group == i) & present)
                if len(rows):
                    x = matrix_of(batch.column(at).take(pa.array(rows)))
                    product = (x - mean) @ own.reshape(-1, len(mean)).T
                    for row, values in zip(rows.tolist(), product):
                        mapped[row] = values
            stay = pa.array(np.fromiter((key in found for key in keys), bool, len(keys)))
            columns = [*batch.columns, pa.array(list(mapped), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(stay)

    df_names = df.columns
    return df.mapInArrow(run, schema)
