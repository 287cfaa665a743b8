"""Scoring jobs: embed texts, score text × label, and never score a pair twice."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slowtide.functions.scorers import Encoder, PairScorer
from slowtide.operators.skew import salted_join
from slowtide.session import fresh_path, write_once
from slowtide.sources.score_table import ScoreTable, VectorTable


def text_key(text: Column) -> Column:
    """A 32-byte digest that stands for the text in joins and tables."""
    return F.unhex(F.sha2(text, 256))


def add_embeddings(df: DataFrame, encoder: Encoder, text: str = "msg", target: str = "embedding") -> DataFrame:
    """Add the vector of each row's text."""
    return df.withColumn(target, encoder.encode(F.col(text)))


def text_vectors(df: DataFrame, encoder: Encoder, text: str = "msg", target: str = "embedding") -> DataFrame:
    """Rows that have a text, with its vector.

    The vector is declared non-null, so null checks further on cost nothing;
    otherwise Catalyst would push them down and run the encoder for them too.
    """
    return _with_vector(df, encoder.encode(F.col(text)), text, target)


def label_text_vectors(
    df: DataFrame, scorer: PairScorer, labels: list[str], text: str = "msg", target: str = "embedding"
) -> DataFrame:
    """Rows that have a text, with its label scores as a non-null vector."""
    return _with_vector(df, scorer.scores(F.col(text), labels), text, target)


def _with_vector(df: DataFrame, vector: Column, text: str, target: str) -> DataFrame:
    never_null = F.coalesce(vector, F.array().cast("array<float>"))
    return df.where(F.col(text).isNotNull()).withColumn(target, never_null)


def add_label_vectors(
    df: DataFrame, scorer: PairScorer, labels: list[str], text: str = "msg", target: str = "embedding"
) -> DataFrame:
    """Add one score per label, ordered by label position, without joins or shuffles."""
    return df.withColumn(target, scorer.scores(F.col(text), labels))


def pair_with_labels(texts: DataFrame, labels: list[str]) -> DataFrame:
    """Every text with every label: adds ``label_idx`` and ``label``."""
    return texts.select(*texts.columns, F.posexplode(F.array(*[F.lit(x) for x in labels])).alias("label_idx", "label"))


def score_pairs(df: DataFrame, scorer: PairScorer, labels: list[str], text: str = "msg") -> DataFrame:
    """Long score table: every row with ``label_idx, label, score``; null texts give no row."""
    # exploded directly: from a column, Catalyst would infer filters that score again
    each = F.posexplode(scorer.scores(F.col(text), labels)).alias("label_idx", "score")
    long = df.where(F.col(text).isNotNull()).select(*df.columns, each)
    names = F.array(*[F.lit(x) for x in labels])
    return long.withColumn("label", F.get(names, F.col("label_idx")))


def cache_hits(pairs: DataFrame, cache: DataFrame, spread_by: list[str]) -> DataFrame:
    """Pairs (``text_key, label``) that the cache holds, with their scores; input multiplicity kept.

    ``spread_by`` names columns that tell rows with the same pair apart.
    """
    return salted_join(pairs, cache, ["text_key", "label"], spread_by, how="inner")


def cache_misses(pairs: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct pairs the cache does not hold."""
    return pairs.select("text_key", "label").distinct().join(cache, ["text_key", "label"], "left_anti")


def attach_scores(pairs: DataFrame, hits: DataFrame, fresh: DataFrame, spread_by: list[str]) -> DataFrame:
    """Give each input pair, duplicates included, its cached or fresh score."""
    known = hits.select("text_key", "label", "score").unionByName(fresh.select("text_key", "label", "score"))
    return salted_join(pairs, known, ["text_key", "label"], spread_by)


def distinct_texts(df: DataFrame, text: str = "msg") -> DataFrame:
    """``(text_key, text)`` of the texts that occur, grouped by the 32-byte key alone."""
    keyed = df.where(F.col(text).isNotNull()).select(text_key(F.col(text)).alias("text_key"), F.col(text).alias("text"))
    return keyed.groupBy("text_key").agg(F.any_value("text").alias("text"))


def fill_scores(
    texts: DataFrame,
    scorer: PairScorer,
    labels: list[str],
    table: ScoreTable,
    model: str,
    run_id: str,
    text: str = "msg",
) -> int:
    """Score the (text, label) pairs the table lacks and append them; returns how many.

    Texts are deduplicated before anything expensive. A text is joined once, to
    the set of its known labels, not once per label. The texts left to score
    are stored, so that a lost executor repeats their scoring only.
    """
    distinct = write_once(distinct_texts(texts, text), "texts")
    names = list(dict.fromkeys(labels))
    # only the labels of the texts at hand
    stored = table.entries(model, names, distinct)
    known = stored.groupBy("text_key").agg(F.collect_set("label").alias("known"))
    incomplete = F.col("known").isNull() | (F.size("known") < len(names))
    todo = to_score(distinct.join(known, "text_key", "left").where(incomplete))
    if todo.isEmpty():
        return 0
    # new texts take all labels at once; texts with some labels stored, the others one by one
    new = todo.where(F.col("known").isNull()).select(
        "text_key", F.posexplode(scorer.scores(F.col("text"), names)).alias("__at", "score")
    )
    wanted = F.array(*[F.lit(x) for x in names])
    partial = todo.where(F.col("known").isNotNull()).select(
        "text_key", "text", F.explode(F.array_except(wanted, F.col("known"))).alias("label")
    )
    fresh = new.select("text_key", F.get(wanted, F.col("__at")).alias("label"), "score").unionByName(
        partial.select("text_key", "label", scorer.score(F.col("text"), F.col("label")).alias("score"))
    )
    return table.append(fresh, model, run_id)


def to_score(texts: DataFrame) -> DataFrame:
    """Texts stored before the model sees them, balanced over tasks by their digests, which are uniform."""
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return write_once(texts.repartition(parts, "text_key"), "todo")


def label_vectors(table: ScoreTable, model: str, labels: list[str], texts: DataFrame | None = None) -> DataFrame:
    """Stored scores as one vector per text (all, or the given ones): ``text_key, embedding``, ordered by label position.

    A label listed twice takes its score in both places.
    """
    by_label = (
        table.latest(model, list(dict.fromkeys(labels)), texts)
        .groupBy("text_key")
        .agg(F.map_from_entries(F.collect_list(F.struct("label", "score"))).alias("scores"))
    )
    vector = F.array(*[F.try_element_at("scores", F.lit(x)) for x in labels])
    return by_label.select("text_key", vector.alias("embedding"))


def memoised_label_vectors(
    df: DataFrame,
    scorer: PairScorer,
    labels: list[str],
    table: ScoreTable,
    model: str,
    run_id: str,
    spread_by: list[str],
    text: str = "msg",
) -> DataFrame:
    """Add label vectors through the score table: score what is missing, then read everything back.

    Reading from storage keeps a lost executor from scoring anything again.
    Texts that occur in many rows are salted by ``spread_by``.
    """
    fill_scores(df, scorer, labels, table, model, run_id, text)
    keyed = df.withColumn("text_key", text_key(F.col(text)))
    return salted_join(keyed, label_vectors(table, model, labels), ["text_key"], spread_by).drop("text_key")


def memoised_embeddings(
    df: DataFrame,
    encoder: Encoder,
    table: VectorTable,
    model: str,
    run_id: str,
    spread_by: list[str],
    text: str = "msg",
) -> DataFrame:
    """Add embeddings through the vector table: each text is encoded once, ever."""
    distinct = write_once(distinct_texts(df, text), "texts")
    todo = to_score(distinct.join(table.entries(model, distinct).select("text_key"), "text_key", "left_anti"))
    if not todo.isEmpty():
        table.append(todo.select("text_key", encoder.encode(F.col("text")).alias("embedding")), model, run_id)
    keyed = df.withColumn("text_key", text_key(F.col(text)))
    return salted_join(keyed, table.latest(model), ["text_key"], spread_by).drop("text_key")


@dataclass
class Memo:
    """Stored results of one model, by which the analyses score every text once, ever.

    ``path`` holds the vector table and the score table; ``run_id`` marks what a
    run stored. Without a path the tables live below the session's shared folder
    for as long as that does, which still removes repeats within a run.
    """

    spark: SparkSession
    path: str | None = None
    model: str = "model"
    run_id: str = "run"
    vectors: VectorTable = field(init=False)
    scores: ScoreTable = field(init=False)

    def __post_init__(self):
        self.path = self.path or fresh_path(self.spark, "memo")
        self.vectors = VectorTable(self.spark, f"{self.path}/vectors")
        self.scores = ScoreTable(self.spark, f"{self.path}/scores")

    def text_vectors(self, df: DataFrame, encoder: Encoder, spread_by: list[str], text: str = "msg") -> DataFrame:
        """Rows that have a text, with its vector as ``embedding``."""
        rows = df.where(F.col(text).isNotNull())
        return memoised_embeddings(rows, encoder, self.vectors, self.model, self.run_id, spread_by, text)

    def label_text_vectors(
        self, df: DataFrame, scorer: PairScorer, labels: list[str], spread_by: list[str], text: str = "msg"
    ) -> DataFrame:
        """Rows that have a text, with its label scores as ``embedding``."""
        rows = df.where(F.col(text).isNotNull())
        return memoised_label_vectors(rows, scorer, labels, self.scores, self.model, self.run_id, spread_by, text)


def memo_for(spark: SparkSession, model, memo: Memo | None) -> Memo | None:
    """The memo to use: the given one, or a new one for a model that is not an expression of its own."""
    return memo if memo is not None or getattr(model, "native", False) else Memo(spark)


def vectors_of(df: DataFrame, encoder: Encoder, memo: Memo | None, spread_by: list[str]) -> DataFrame:
    """Rows that have a text, with its vector; each text is encoded once if the encoder is a model."""
    memo = memo_for(df.sparkSession, encoder, memo)
    return text_vectors(df, encoder) if memo is None else memo.text_vectors(df, encoder, spread_by)


def label_vectors_of(df: DataFrame, scorer: PairScorer, labels: list[str], memo: Memo | None, spread_by: list[str]) -> DataFrame:
    """Rows that have a text, with its label scores; each pair is scored once if the scorer is a model."""
    memo = memo_for(df.sparkSession, scorer, memo)
    return label_text_vectors(df, scorer, labels) if memo is None else memo.label_text_vectors(df, scorer, labels, spread_by)
