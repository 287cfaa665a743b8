"""Joins that stay balanced when one key holds a large share of the rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_PER_SALT = 1_000_000
MAX_HOT_KEYS = 10_000
BROADCAST_BYTES = 32 << 20


def hot_keys(
    counts: DataFrame, keys: list[str], rows: str, rows_per_salt: int, max_hot: int = MAX_HOT_KEYS
) -> DataFrame:
    """Keys with more rows than one salt should hold, and the number of salts each gets.

    A salt holds ``rows_per_salt`` rows, or 1/max_hot of all rows if that is more.
    Fewer than ``max_hot`` keys can exceed that share, so the list is bounded by
    arithmetic: no key is left out, and there are no ties to break.
    """
    share = F.greatest(F.lit(rows_per_salt).cast("double"), counts.agg(F.sum(rows)).scalar() / F.lit(max_hot))
    return counts.where(F.col(rows) > share).select(*keys, F.ceil(F.col(rows) / share).cast("int").alias("__salts"))


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join by name in which a null key equals a null key; the keys appear once."""
    named = right.select(*[F.col(f"`{c}`").alias(f"__right_{c}" if c in keys else c) for c in right.columns])
    on = F.lit(True)
    for key in keys:
        on = on & F.col(f"`{key}`").eqNullSafe(F.col(f"`__right_{key}`"))
    return left.join(named, on, how).drop(*[f"__right_{key}" for key in keys])


def salted_join(
    facts: DataFrame,
    dim: DataFrame,
    keys: list[str],
    spread_by: list[str],
    how: str = "left",
    counts: DataFrame | None = None,
    rows_per_salt: int = ROWS_PER_SALT,
) -> DataFrame:
    """Equi-join of a large table to a table with one row per key.

    Rows of a hot key are spread over several tasks by a hash of ``spread_by``;
    the matching row of ``dim`` is repeated once per salt. The list of hot keys
    is bounded (see ``hot_keys``), hence broadcast. ``counts`` may pass rows per
    key (columns ``keys`` and ``rows``) if the caller has them already.
    """
    if counts is None:
        counts = facts.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    hot = F.broadcast(hot_keys(counts, keys, "rows", rows_per_salt))
    spread = F.xxhash64(*spread_by)
    no_key = F.greatest(*[F.col(k).isNull() for k in keys]) if len(keys) > 1 else F.col(keys[0]).isNull()
    salted = facts.join(hot, keys, "left").withColumn(
        "__salt",
        # rows without a key match nothing; any salt spreads them
        F.when(no_key, spread)
        .when(F.col("__salts").isNotNull(), F.pmod(spread, F.col("__salts").cast("long")))
        .otherwise(F.lit(0).cast("long")),
    )
    copies = (
        dim.join(hot, keys, "left")
        .withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("__salts"), F.lit(1)).cast("long") - 1)))
        .drop("__salts")
    )
    return salted.drop("__salts").join(copies, [*keys, "__salt"], how).drop("__salt")


def lookup_join(
    facts: DataFrame,
    dim: DataFrame,
    keys: list[str],
    spread_by: list[str],
    dim_bytes: int,
    how: str = "inner",
    rows_per_salt: int = ROWS_PER_SALT,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join to a table of measured size: broadcast if it is small, salted if not."""
    if dim_bytes <= broadcast_bytes:
        return facts.join(F.broadcast(dim), keys, how)
    return salted_join(facts, dim, keys, spread_by, how, rows_per_salt=rows_per_salt)


def spread_work(df: DataFrame, keys: list[str]) -> DataFrame:
    """Hash rows by key over all shuffle partitions, for groups that are small but costly.

    Adaptive execution sizes partitions by bytes and would merge them into one
    task; a fixed number is left alone. Grouping by ``keys`` then needs no
    further shuffle.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
