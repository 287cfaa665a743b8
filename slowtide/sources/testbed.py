"""Message and vector tables derived from the bundled test tables, and word lists for scoring their invented texts."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Word lists for the lexical scorer on the test texts, which are invented prose
# around the function words of four languages.
LEXICON = {
    "article": ["the", "a", "an"],
    "preposition": ["of", "to", "for", "on", "with", "by", "at", "from"],
    "conjunction": ["and", "or", "than", "when"],
    "being": ["is", "was", "are", "be", "were"],
    "pointing": ["this", "that", "it", "he"],
    "romance article": ["la", "le", "el", "les", "los", "las", "un", "une"],
    "romance link": ["de", "des", "del", "que", "et", "y"],
    "german article": ["der", "die", "das", "den"],
    "german link": ["und", "von", "zu", "mit", "ist"],
    "shared": ["in", "en", "es", "se"],
}
LEXICON_LABELS = list(LEXICON)


def generated_lexicon(labels: list[str]) -> dict[str, list[str]]:
    """A test lexicon: three words of the lists above for each label, by its position.

    The texts are invented, so the lists say nothing about the labels; they only make
    as many scores as the analysis has labels, which SQL can compute too.
    """
    pool = list(dict.fromkeys(w for listed in LEXICON.values() for w in listed))
    pick = lambda i: [pool[(i * step + at) % len(pool)] for at, step in ((0, 1), (7, 3), (19, 5))]
    return {label: sorted(set(pick(i))) for i, label in enumerate(labels)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation turn as a forum message, with a message without text after about one turn in 29."""
    turns = table(spark, sf_dir, "conversations").selectExpr(
        "conv_id", "role", "turn", "text", "explode(case when (conv_id + turn) % 29 = 0 then array(false, true) else array(false) end) as added"
    )
    return turns.selectExpr(
        "conv_id * 1000 + turn + case when added then 500 else 0 end as msg_id",
        "conv_id as thread_id",
        "timestamp_ntz '2024-01-01 00:00:00' + conv_id * interval '1' day + turn * interval '1' hour as date",
        "turn = 0 and not added as is_first_in_thread",
        "case when conv_id % 3 = 0 then 'Other' else 'PracticeLogs' end as category",
        "concat(role, '_', cast(conv_id % 7 as string)) as author",
        "concat('Thread ', cast(conv_id as string)) as title",
        "case when not added then text end as msg",
    )


def vector_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stored embedding as a row of one of three series, six hours apart with gaps."""
    return table(spark, sf_dir, "embeddings").selectExpr(
        "vec_id as row_id",
        "cast(label % 3 as bigint) as series",
        "timestamp_ntz '2024-01-01 00:00:00' + vec_id * interval '6' hour"
        " + cast(floor(vec_id / 50) as bigint) * interval '3' day as date",
        "embedding",
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream as a dated series per event type."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("msg_id"),
        F.col("event_type").alias("series"),
        F.col("ts").alias("date"),
        F.col("user_id"),
        F.col("value"),
        F.col("props").alias("msg"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")
