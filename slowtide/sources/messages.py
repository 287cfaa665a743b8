"""Reading the message collection from newline-delimited JSON."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slowtide.functions.text import parse_timestamp
from slowtide.operators.threads import with_thread_author

# As stored: the date is text.
STORED = T.StructType(
    [
        T.StructField("msg_id", T.LongType()),
        T.StructField("thread_id", T.LongType()),
        T.StructField("date", T.StringType()),
        T.StructField("is_first_in_thread", T.BooleanType()),
        T.StructField("category", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("msg", T.StringType()),
    ]
)

TYPED_NAMES = {
    "msg_id": "msgId",
    "thread_id": "threadId",
    "is_first_in_thread": "isFirstInThread",
    "thread_author": "threadAuthor",
}


def read_messages(spark: SparkSession, path: str, strict_dates: bool = True) -> DataFrame:
    """The collection with parsed dates.

    The schema is declared, never inferred, so nothing is read before the query
    runs and unused columns are skipped. Blank lines are skipped; a malformed
    line is an error.
    """
    stored = spark.read.schema(STORED).option("mode", "FAILFAST").json(path)
    return stored.withColumn("date", parse_timestamp(F.col("date"), strict=strict_dates))


def read_typed_messages(spark: SparkSession, path: str) -> DataFrame:
    """The collection under camel-case names, with the thread's author ("n/a" if unknown).

    Dates stay text here.
    """
    stored = spark.read.schema(STORED).option("mode", "FAILFAST").json(path)
    return with_thread_author(stored, missing="n/a").withColumnsRenamed(TYPED_NAMES)


def write_messages(messages: DataFrame, path: str) -> None:
    """Store messages as newline-delimited JSON in the layout ``read_messages`` expects."""
    # a plain cast: date formatting would go through the session's time zone
    date = F.replace(F.col("date").cast("string"), F.lit(" "), F.lit("T"))
    messages.withColumn("date", date).select(*STORED.fieldNames()).write.option("ignoreNullFields", "false").json(path)
