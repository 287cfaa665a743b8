"""Messages to sentences."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slowtide.functions.text import split_sentences


def explode_sentences(
    messages: DataFrame,
    text: str = "msg",
    abbreviations: tuple[str, ...] = (),
) -> DataFrame:
    """One row per sentence, the other columns repeated, with its position ``sentence_idx``.

    Messages without text, or without any sentence, give no row.
    """
    others = [c for c in messages.columns if c != text]
    return messages.select(
        *others, F.posexplode(split_sentences(F.col(text), abbreviations)).alias("sentence_idx", text)
    )
