"""Connected components of a graph given as edges, without moving the graph anywhere as a whole."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slowtide.session import write_once


def _with_least(pairs: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` with the least of a and all its partners; partial minima are taken before the shuffle."""
    least = pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return pairs.join(least, "a")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _with_least(both).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    falling = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    linked = _with_least(falling)
    return linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(linked.select("a", F.col("m").alias("b")))


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of all nodes that differ from their component's least node.

    ``edges`` has the long columns a and b; loops and repeated edges do not matter.
    Alternates large and small stars, each a grouping and a join, until the
    edges stay the same; the number of rounds grows with the logarithm of the
    longest chain. Every round is stored, so a lost executor repeats one round.
    """

    def state(rows: DataFrame) -> tuple:
        return tuple(rows.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())

    edges = write_once(edges.where(F.col("a") != F.col("b")).select("a", "b").distinct(), "edges")
    before = state(edges)
    while before[0]:
        edges = write_once(_small_star(_large_star(edges)).where(F.col("a") != F.col("b")).distinct(), "edges")
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
