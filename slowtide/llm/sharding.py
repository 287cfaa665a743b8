"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Every record draws one number per shard from a hash of its key and the shard's
name; the shard with the best weighted draw gets it. A new shard only takes the
records for which its own draw wins, and raising a weight only takes records
into that shard. All of it is DataFrame expressions.
"""

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Numbered parts of each shard while slots are dealt: no task sorts a whole shard.
SLOT_PARTS = 1024


def _draw(key: Column, shard: Column) -> Column:
    """A uniform number in (0, 1) from 52 bits of the hash of (key, shard)."""
    bits = F.shiftrightunsigned(F.xxhash64(key, shard), 12)
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def rendezvous(key: Column, weights: Mapping[int, float]) -> Column:
    """The shard (an int) of a record's key.

    A shard's share of the records is its weight over the sum of weights:
    ``ln(draw) / weight`` is largest with that probability. Ties go to the
    smaller number, a null key hashes like any other, and a shard of weight
    zero gets nothing.
    """
    shards = [(int(s), float(w)) for s, w in sorted(weights.items()) if w > 0]
    if not shards:
        raise ValueError("no shard has a positive weight")
    scores = [F.struct((F.log(_draw(key, F.lit(s))) / F.lit(w)).alias("s"), F.lit(-s).alias("n")) for s, w in shards]
    best = scores[0] if len(scores) == 1 else F.greatest(*scores)
    return (-best["n"]).cast("int")


def with_shards(df: DataFrame, key: str, weights: Mapping[int, float], target: str = "shard") -> DataFrame:
    """Add every row's shard: no shuffle, no state. A column named like ``target`` is replaced."""
    return df.withColumn(target, rendezvous(F.col(f"`{key}`"), weights))


def with_slots(df: DataFrame, shard: str = "shard", target: str = "slot", parts: int = SLOT_PARTS) -> DataFrame:
    """Add a gapless number from 0 within each shard, the same at every run.

    Rows are counted per content first (equal rows cannot be told apart, and a
    row repeated a million times is one row here), numbered within hashed parts
    of a shard, and shifted by the sizes of the parts before. Only the counts of
    shards x parts are summed in order. Use narrow rows: keys and digests.
    """
    columns = [f"`{c}`" for c in df.columns]
    counted = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("__n"))
    counted = counted.withColumn("__part", F.pmod(F.xxhash64(*[F.col(c) for c in columns]), F.lit(parts)))
    within = Window.partitionBy(f"`{shard}`", "__part").orderBy(*columns)
    numbered = counted.withColumn("__to", F.sum("__n").over(within))
    sizes = counted.groupBy(f"`{shard}`", "__part").agg(F.sum("__n").alias("__size"))
    before = Window.partitionBy(f"`{shard}`").orderBy("__part")
    sizes = sizes.select(
        F.col(f"`{shard}`").alias("__shard"),
        F.col("__part").alias("__at"),
        (F.sum("__size").over(before) - F.col("__size")).alias("__before"),
    )
    placed = numbered.join(sizes, F.col(f"`{shard}`").eqNullSafe(F.col("__shard")) & (F.col("__part") == F.col("__at")))
    first = F.col("__before") + F.col("__to") - F.col("__n")
    slots = F.explode(F.sequence(first, first + F.col("__n") - 1)).alias(target)
    return placed.select(*[c for c in columns if c != f"`{target}`"], slots)


def shard_documents(df: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Digest rows of all documents with their shard, slot and the shard if there were one more.

    ``size`` is the text's UTF-8 bytes plus 16. Null texts count as empty; rows
    with equal or null keys share a shard; extra columns are ignored; no rows
    give no rows.
    """
    grown = {i: 1.0 for i in range(shards + 1)}
    plain = {i: 1.0 for i in range(shards)}
    digest = df.select(
        F.col(f"`{key}`").alias("doc_id"),
        (F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).cast("long") + 16).alias("size"),
        F.crc32(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    placed = digest.withColumns({"shard": rendezvous(F.col("doc_id"), plain), "grown_shard": rendezvous(F.col("doc_id"), grown)})
    return with_slots(placed, "shard").select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
