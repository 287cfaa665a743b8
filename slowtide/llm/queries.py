"""The operators of this subpackage as queries over the whole test tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slowtide.llm import (
    fingerprints, licenses, line_dedup, neighbours, ngram_join, packing, periodic_runs, quality, sentencepiece_viterbi, sharding,
    token_alignment, token_counts, toxicity,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
SHARDS = 40
#: The chain's categories in order; the last decides.
CATEGORIES = ("junk", "toxic")


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return rows.select("doc_id", (1 - F.col("quality")).alias("junk"), "toxic")


@query
def op1_sentencepiece(spark, sf_dir):
    """All documents encoded, and decoded again."""
    encoded = sentencepiece_viterbi.encode_documents(documents(spark, sf_dir), PIECE_MODEL, keep=["doc_id"])
    rows = sentencepiece_viterbi.decode_documents(encoded, PIECE_MODEL)
    digest = F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", digest)


@query
def op2_sharding(spark, sf_dir):
    """All documents in 40 shards of equal weight by doc_id."""
    return sharding.shard_documents(documents(spark, sf_dir), SHARDS)


@query
def op3_ngram_join(spark, sf_dir):
    """All documents with their class of near duplicates and number of links."""
    return ngram_join.near_duplicates(documents(spark, sf_dir))


@query
def op4_toxicity(spark, sf_dir):
    """All documents with the probabilities of both categories and the decision."""
    rows = toxicity.document_toxicity(documents(spark, sf_dir), labels(spark, sf_dir), CATEGORIES, ["doc_id"])
    return rows.select("doc_id", "p_junk", "p_toxic", "is_toxic")


@query
def op5_fingerprints(spark, sf_dir):
    """All documents and their edited texts."""
    return fingerprints.fingerprint_edits(documents(spark, sf_dir))


@query
def op6_token_counts(spark, sf_dir):
    """All documents' numbers of tokens and scores."""
    return token_counts.count_tokens(documents(spark, sf_dir), PIECE_MODEL, keep=["doc_id"])


@query
def op7_packing(spark, sf_dir):
    """All documents in sequences of 2048 tokens."""
    return packing.pack_documents(documents(spark, sf_dir), WORD_TOKENIZER)


@query
def op8_neighbours(spark, sf_dir):
    """Ten nearest rows of every hundredth embedding."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return neighbours.nearest_neighbours(rows, F.col("vec_id") % 100 == 0)


@query
def op9_line_dedup(spark, sf_dir):
    """All documents without repeated long lines: counts and the digest of what stays."""
    rows = line_dedup.dedup_lines(documents(spark, sf_dir))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query
def op10_licenses(spark, sf_dir):
    """All documents with the licence sentences and licences they hold."""
    rows = licenses.scan_licences(documents(spark, sf_dir))
    return rows.select(
        "doc_id",
        F.size("sentence_ids").cast("long").alias("n_sentences"),
        F.concat_ws(",", "sentence_ids").alias("sentence_ids"),
        F.concat_ws(",", "licences").alias("licences"),
    )


@query
def op11_periodic_runs(spark, sf_dir):
    """All documents' runs of words, a tenth of them with words repeated first: the strongest run and digests."""
    hashed = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    number = F.when(F.pmod(hashed, F.lit(10)) == 0, F.floor(hashed / 10))
    docs = documents(spark, sf_dir).select("doc_id", periodic_runs.repeat_words(F.col("text"), number, F.pmod(number, F.lit(8))).alias("text"))
    rows = periodic_runs.collapse_runs(docs, keep=["doc_id"]).withColumn("best", periodic_runs.strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.floor(F.expr("1000 * best.length div best.period")).cast("long").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


@query
def op12_quality(spark, sf_dir):
    """All documents' quality by a discriminant learnt from the labelled rows that are not held out."""
    rows = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return quality.document_quality(documents(spark, sf_dir), rows)


@query
def op13_token_alignment(spark, sf_dir):
    """All documents' tokens by a byte-level and a piece vocabulary, aligned."""
    rows = token_alignment.align_tokens(documents(spark, sf_dir), *token_alignment.tokenizer_paths(), keep=["doc_id"], digest=True)
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
