import pytest

LONG = "word%d " * 30_000 % tuple(range(30_000)) + "\nthe last line of a very long text"


def make_docs(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, shard string, ids string, n_lines string, node string"
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "x", "x", "x") for i, t in rows], schema)


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and very long texts, ties and repeated rows, a missing doc_id."""
    return [
        (1, None),
        (2, ""),
        (3, " \n\t"),
        (4, "one two"),
        (5, "one two"),
        (6, LONG),
        (7, "日本語 naïve ▁ don't 😀\n\nsecond paragraph here"),
        (8, "same row again and again"),
        (8, "same row again and again"),
        (9, "one"),
        (None, "no id"),
    ]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return make_docs(spark, edge_rows)


@pytest.fixture(scope="session")
def no_docs(spark):
    return make_docs(spark, [])
