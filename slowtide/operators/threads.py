"""Who started each thread, and what thread authors wrote in their own threads."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slowtide.operators.skew import ROWS_PER_SALT, salted_join

#: Logarithm of the number of counters in a sketch of distinct authors.
SKETCH_SIZE = 12
PRACTICE_LOGS = "PracticeLogs"


def thread_authors(messages: DataFrame, strict: bool = False) -> DataFrame:
    """One row per thread: ``thread_id, thread_author``.

    Of several first messages the one with the largest ``msg_id`` counts,
    whatever its category. With ``strict`` every thread must have one: a thread
    without raises an error that names it. A huge thread shrinks to one row per
    task before any shuffle.
    """
    firsts = messages.where("is_first_in_thread")
    authors = firsts.groupBy("thread_id").agg(F.max_by("author", "msg_id").alias("thread_author"))
    if not strict:
        return authors
    complaint = F.concat(F.lit("no first message in thread "), F.col("thread_id").cast("string"))
    return (
        messages.select("thread_id")
        .distinct()
        .join(authors.withColumn("__known", F.lit(True)), "thread_id", "left")
        .select(
            "thread_id",
            F.when(F.col("__known"), F.col("thread_author"))
            .otherwise(F.raise_error(complaint).cast("string"))
            .alias("thread_author"),
        )
    )


def threads_without_author(messages: DataFrame) -> DataFrame:
    """Audit for the strict rule: threads that have messages but no first message."""
    return messages.groupBy("thread_id").agg(
        F.count(F.lit(1)).alias("num_messages"),
        F.max(F.coalesce(F.col("is_first_in_thread"), F.lit(False))).alias("__has_first"),
    ).where("not __has_first").drop("__has_first")


def with_thread_author(
    messages: DataFrame, missing: str | None = None, rows_per_salt: int = ROWS_PER_SALT
) -> DataFrame:
    """Add ``thread_author`` to every message.

    ``missing`` is the value for threads without a first message; with None
    such a thread is an error. Hot threads are salted.
    """
    authors = thread_authors(messages, strict=missing is None)
    joined = salted_join(messages, authors, ["thread_id"], ["msg_id"], rows_per_salt=rows_per_salt)
    if missing is None:
        return joined
    return joined.withColumn("thread_author", F.coalesce("thread_author", F.lit(missing)))


def by_thread_author(
    messages: DataFrame, strict: bool = False, where=None, rows_per_salt: int = ROWS_PER_SALT
) -> DataFrame:
    """Messages written by the author of their thread.

    ``where`` filters the messages that are returned (say, on category) before
    they are shuffled; the threads' authors are still found among all messages.
    The join key is (thread, author): a thread with many writers spreads by
    writer, and a hot pair is salted.
    """
    owners = thread_authors(messages, strict).withColumnRenamed("thread_author", "author")
    wanted = messages if where is None else messages.where(where)
    return salted_join(
        wanted, owners, ["thread_id", "author"], ["msg_id"], how="inner", rows_per_salt=rows_per_salt
    ).select(*messages.columns)


def practice_logs(messages: DataFrame, author: str | None = None, strict: bool = False) -> DataFrame:
    """What thread authors wrote in their own threads of the practice-log category."""
    where = F.col("category") == PRACTICE_LOGS
    if author is not None:
        where = where & (F.col("author") == author)
    return by_thread_author(messages, strict, where)


def own_thread_summary(messages: DataFrame, category: str = PRACTICE_LOGS, strict: bool = False) -> DataFrame:
    """Per author: posts in own threads of a category, first and last day.

    Messages are reduced per (thread, author) before they meet the threads'
    authors, so the join and both shuffles carry summaries only.
    """
    owners = thread_authors(messages, strict).withColumnRenamed("thread_author", "author")
    per_thread = (
        messages.where(F.col("category") == category)
        .groupBy("thread_id", "author")
        .agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))
    )
    return (
        per_thread.join(owners, ["thread_id", "author"], "left_semi")
        .groupBy("author")
        .agg(
            F.sum("n").alias("num_posts"),
            F.min("first").cast("date").alias("first_date"),
            F.max("last").cast("date").alias("last_date"),
        )
    )


def top_authors(counts: DataFrame, by: str = "num_posts", k: int = 10) -> DataFrame:
    """The k authors with the largest counts; ties by name."""
    return counts.orderBy(F.desc(by), "author").limit(k)


def collection_profile(messages: DataFrame, author: str, category: str = PRACTICE_LOGS) -> DataFrame:
    """One row: message count, category count, its distinct authors, one author's posts in own threads."""
    in_category = F.col("category") == category
    owners = thread_authors(messages).withColumnRenamed("thread_author", "author")
    # (author) summaries first: the distinct count then runs over few rows
    per_author = messages.groupBy("author").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(in_category).alias("n_category")
    )
    totals = per_author.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("num_rows"),
        F.coalesce(F.sum("n_category"), F.lit(0)).alias("num_category_rows"),
        F.count_if((F.col("n_category") > 0) & F.col("author").isNotNull()).alias("num_category_authors"),
    )
    own = (
        messages.where(in_category & (F.col("author") == author))
        .groupBy("thread_id", "author")
        .agg(F.count(F.lit(1)).alias("n"))
        .join(owners, ["thread_id", "author"], "left_semi")
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    )
    return totals.withColumn("num_own_thread_posts", own.scalar())


def category_author_counts(messages: DataFrame, category: str = PRACTICE_LOGS) -> DataFrame:
    """Messages per author in a category, other people's threads included."""
    return messages.where(F.col("category") == category).groupBy("author").agg(F.count(F.lit(1)).alias("num_posts"))


def author_sketches(messages: DataFrame, keys: list[str], size: int = SKETCH_SIZE) -> DataFrame:
    """A mergeable sketch of the distinct authors of each group: ``keys.., authors`` (binary), to be stored.

    A sketch has at most 2**size small counters, whatever it has seen; sketches of days
    add up to those of weeks, and of categories to the whole, without the messages.
    """
    return messages.groupBy(*keys).agg(F.hll_sketch_agg("author", F.lit(size)).alias("authors"))


def distinct_authors(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Estimated number of distinct authors of each group of stored sketches: ``keys.., num_authors``.

    The standard error is 1.04 / sqrt(2**size), 1.6 % for the default size; up to about a
    hundred authors counts are exact. ``collection_profile`` counts exactly.
    """
    merged = sketches.groupBy(*keys).agg(F.hll_union_agg("authors").alias("authors"))
    return merged.select(*keys, F.hll_sketch_estimate("authors").alias("num_authors"))
