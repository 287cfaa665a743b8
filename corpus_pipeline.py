"""A cleaning pipeline over documents: toxicity, line dedup, near duplicates, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the
last return the columns of ``docs``. What a stage returns is stored and read
again by the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slowtide.llm import line_dedup, ngram_join, packing, toxicity
from slowtide.llm.queries import CATEGORIES, WORD_TOKENIZER, labels
from slowtide.session import write_once


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain, fitted on the labelled ones among them, finds toxic go.

    Null texts count as empty and stay. Columns are left as they are.
    """
    chain = toxicity.fit_toxicity(docs, labels(spark, sf_dir), CATEGORIES)
    scored = toxicity.score_toxicity(docs, chain, prefix="__p_")
    return scored.where(F.col(f"__p_{CATEGORIES[-1]}") < float(chain.thresholds[-1])).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in the largest doc_id only; ``n_chars`` counts what is left.

    Null texts become empty; documents that lose all their lines stay, empty.
    """
    kept = line_dedup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the row of the least doc_id stays.

    Every row is compared under a number of its own, so different texts of one doc_id and
    rows without doc_id are judged by their own text and no two rows are taken for each
    other. Of a class, rows with a doc_id come first, and one of equal rows stays. Rows
    without words stay, all of them. The numbers are stored with the rows before use.
    """
    named = write_once(docs.withColumn("__id", F.monotonically_increasing_id()), "pipeline-numbered")
    classes = ngram_join.near_duplicates(named, key="__id").select(F.col("doc_id").alias("__id"), "class_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__id")).alias("first")
    stay = classes.join(named.select("__id", "doc_id"), "__id").groupBy("class_id").agg(first).select("first.__id")
    return named.join(stay.hint("shuffle_hash"), "__id", "left_semi").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every kept document in sequences of 2048 tokens, one row per piece."""
    return packing.pack_documents(docs, WORD_TOKENIZER)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", drop_near_duplicates),
    ("packing", pack),
]
#: Classifiers and tokenizers are not SQL; tests/llm compares every stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each on what the one before stored."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_once(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
