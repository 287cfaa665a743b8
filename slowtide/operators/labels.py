"""What the entries of fitted models say about labels; long tables throughout."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from slowtide.functions.vectors import norm, scale

WHITE_NOISE = 2.0


def weights(models: DataFrame, series: list[str] = ("series",), matrix: str = "components") -> DataFrame:
    """Matrix entries: ``series.., component, label_idx, weight``.

    Principal components beyond the retained ones are zeros and have no entries here, so
    a series without variance has none.
    """
    rows = models.select("*", F.posexplode(matrix).alias("component", "__row"))
    if "n_retained" in models.columns and matrix == "components":
        rows = rows.where(F.col("component") < F.col("n_retained"))
    return rows.select(*series, "component", F.posexplode("__row").alias("label_idx", "weight"))


def ordered_weights(long: DataFrame, labels: DataFrame, series: list[str] = ("series",)) -> DataFrame:
    """Weights with label texts and each label's position in ascending order of weight."""
    place = F.row_number().over(W.partitionBy(*series, "component").orderBy("weight", "label_idx"))
    placed = long.withColumn("position", place)
    return placed.join(labels, "label_idx").select(*series, "component", "position", "label_idx", "label", "weight")


def multiply(left: DataFrame, right: DataFrame, series: list[str] = ("series",)) -> DataFrame:
    """Product of two long matrices: left's columns meet right's rows."""
    a = left.select(*series, "component", F.col("label_idx").alias("__inner"), F.col("weight").alias("__a"))
    b = right.select(*series, F.col("component").alias("__inner"), "label_idx", F.col("weight").alias("__b"))
    return (
        a.join(b, [*series, "__inner"])
        .groupBy(*series, "component", "label_idx")
        .agg(F.sum(F.col("__a") * F.col("__b")).alias("weight"))
    )


def slow_label_weights(sfa: DataFrame, pca: DataFrame, series: list[str] = ("series",)) -> DataFrame:
    """Label weights of slow features that were fitted on principal components."""
    return multiply(weights(sfa, series), weights(pca, series), series)


def whitening_axes(sfa: DataFrame, series: list[str] = ("series",)) -> DataFrame:
    """Unit-length principal axes inside a slow-feature model, as long weights."""
    unit = F.transform("whitening", lambda row: scale(row, 1 / norm(row)))
    return weights(sfa.withColumn("whitening", unit), series, "whitening")


def importance(long: DataFrame, ratios: DataFrame, series: list[str] = ("series",)) -> DataFrame:
    """Largest |sqrt(variance ratio) · weight| of each label over the components.

    ``ratios``: ``series.., component, ratio``. A series without weights has no rows.
    """
    weighted = F.abs(F.sqrt("ratio") * F.col("weight"))
    return (
        long.join(ratios, [*series, "component"])
        .groupBy(*series, "label_idx")
        .agg(F.max(weighted).alias("importance"))
    )


def temporal_importance(
    long: DataFrame, deltas: DataFrame, variances: DataFrame, series: list[str] = ("series",)
) -> DataFrame:
    """Largest weight of each label over the slow features, slower features counting more.

    Each feature's weights are scaled to length 1 and multiplied by what its
    slowness lies below white noise's. ``deltas``: ``series.., component, delta``;
    ``variances``: ``series.., dim, variance``. A feature filled with zeros
    has no weight.
    """
    length = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(W.partitionBy(*series, "component")))
    unit = long.withColumn("__unit", F.coalesce(F.col("weight") / F.nullif(length, F.lit(0.0)), F.lit(0.0)))
    below = F.greatest(F.lit(WHITE_NOISE) - F.col("delta"), F.lit(0.0))
    ranked = (
        unit.join(deltas, [*series, "component"])
        .groupBy(*series, "label_idx")
        .agg(F.max(F.abs(F.col("__unit") * below)).alias("importance"))
    )
    return ranked.join(variances.withColumnRenamed("dim", "label_idx"), [*series, "label_idx"])


def component_values(models: DataFrame, array: str, name: str, series: list[str] = ("series",)) -> DataFrame:
    """An array of a model in long form: ``series.., component, <name>``."""
    return models.select(*series, F.posexplode(array).alias("component", name))


def explained_variance(pca: DataFrame, series: list[str] = ("series",)) -> DataFrame:
    """Variance share of each principal component and whether it was kept.

    A series without variance has shares 0, none kept.
    """
    long = pca.select(*series, "n_retained", F.posexplode("ratios").alias("component", "ratio"))
    return long.select(*series, "component", "ratio", (F.col("component") < F.col("n_retained")).alias("retained"))


def explained_variance_of_sfa(sfa: DataFrame, series: list[str] = ("series",)) -> DataFrame:
    """Variance along each whitening axis and whether it was non-trivial."""
    long = sfa.select(*series, "n_nontrivial", F.posexplode("variances").alias("component", "variance"))
    return long.select(*series, "component", "variance", (F.col("component") < F.col("n_nontrivial")).alias("retained"))
