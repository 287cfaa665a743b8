import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from slowtide.functions import text as X
from slowtide.functions.scorers import LexicalEncoder, LexicalPairScorer, mock_vector
from slowtide.operators.sentences import explode_sentences


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    "text, sentences",
    [
        ('Hello there. "How are you?" Fine!  Ok', ["Hello there.", '"How are you?"', "Fine!", "Ok"]),
        ("no end", ["no end"]),
        ("One.Two three.", ["One.Two three."]),
        ("Wait... what?!\nYes.", ["Wait...", "what?!", "Yes."]),
        ("", []),
        ("   ", []),
        ("\n\t \r\n", []),
        ("\nA 0.\tB 1\n", ["A 0.", "B 1"]),
    ],
)
def test_split_sentences(spark, text, sentences):
    assert one(spark, text, X.split_sentences) == sentences


def test_abbreviations(spark):
    split = lambda c: X.split_sentences(c, ("Dr.", "e.g.", "g."))
    assert one(spark, "Dr. No came, e.g. here. Odd. Bye", split) == ["Dr. No came, e.g. here.", "Odd.", "Bye"]
    # only whole words count
    assert one(spark, "She saw XDr. Then left", split) == ["She saw XDr.", "Then left"]


def test_explode_drops_texts_without_sentences(spark):
    rows = spark.createDataFrame([(1, "A. B."), (2, None), (3, ""), (4, "  ")], "msg_id int, msg string")
    found = [tuple(r) for r in explode_sentences(rows).orderBy("sentence_idx").collect()]
    assert found == [(1, 0, "A."), (1, 1, "B.")]


def test_softmax(spark):
    found = one(spark, [1000.0, 1001.0, -5.0], X.softmax, "array<double>")
    e = math.exp(-1)
    assert found == pytest.approx([e / (1 + e), 1 / (1 + e), 0.0])


@pytest.mark.parametrize("e, c, score", [(0.0, 0.0, 0.5), (3.0, 1.0, 1 / (1 + math.exp(-2))), (-800.0, 800.0, 0.0), (800.0, -800.0, 1.0)])
def test_entailment(spark, e, c, score):
    row = spark.createDataFrame([(e, c)], "e double, c double").select(X.entailment_score(F.col("e"), F.col("c")))
    assert row.first()[0] == pytest.approx(score, abs=1e-7)


def test_scalars(spark):
    assert one(spark, "calmness", X.hypothesis) == "This example is calmness."
    assert one(spark, 0.25, X.period_of_frequency, "double") == 4.0
    assert one(spark, 0.0, X.period_of_frequency, "double") == math.inf
    days = spark.sql("select timestamp_ntz '1970-01-02 12:00:00.000001' t").select(X.epoch_days(F.col("t")), X.epoch_micros(F.col("t")))
    assert tuple(days.first()) == (pytest.approx(1.5, abs=1e-10), 129_600_000_001)
    before = spark.sql("select timestamp_ntz '1969-12-31 23:59:59' t").select(X.epoch_micros(F.col("t")))
    assert before.first()[0] == -1_000_000


WORDS = {"a": ["the", "of"], "b": ["cat"]}


def test_lexical_scores(spark):
    scorer = LexicalPairScorer(WORDS)
    rows = spark.createDataFrame([("The cat of the house",), ("",), (None,)], "v string")
    found = rows.select(scorer.scores(F.col("v"), ["b", "a", "b"]), scorer.score(F.col("v"), F.lit("a"))).collect()
    logistic = lambda share: 1 / (1 + math.exp(4 * (1 - 2 * share)))
    assert found[0][0] == pytest.approx([logistic(0.2), logistic(0.6), logistic(0.2)], abs=1e-6)
    assert found[0][1] == pytest.approx(logistic(0.6), abs=1e-6)
    assert found[1][0] == pytest.approx([logistic(0)] * 3, abs=1e-6)
    assert found[2][0] is None and found[2][1] is None


def test_lexical_encoder(spark):
    rows = spark.createDataFrame([("b a b",), ("?!",), (None,)], "v string")
    found = [r[0] for r in rows.select(LexicalEncoder(8, F.ascii).encode(F.col("v"))).collect()]
    expected = [0.0] * 8
    expected[ord("a") % 8], expected[ord("b") % 8] = 1 / math.sqrt(5), 2 / math.sqrt(5)
    assert found[0] == pytest.approx(expected, abs=1e-6)
    assert found[1] == [0.0] * 8 and found[2] is None


def test_mock_vectors_do_not_depend_on_partitions(spark):
    vectors = lambda n: dict(
        spark.range(500).repartition(n).select("id", mock_vector(F.col("id"), 10, seed=3)).collect()
    )
    one_part = vectors(1)
    assert one_part == vectors(16)
    values = [x for v in one_part.values() for x in v]
    assert all(0 <= x < 1 for x in values) and abs(sum(values) / len(values) - 0.5) < 0.02


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab .!?\n\"')", max_size=30), min_size=1, max_size=20))
def test_sentences_keep_all_words(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "msg_id int, msg string")
    found = {}
    for r in explode_sentences(rows).orderBy("msg_id", "sentence_idx").collect():
        found.setdefault(r["msg_id"], []).append(r["msg"])
    for i, text in enumerate(texts):
        assert "".join(" ".join(found.get(i, [])).split()) == "".join(text.split())


def test_control_characters_do_not_split(spark):
    row = spark.createDataFrame([("a\u0001b etc.\u0002 c. D",)], "t string")
    found = row.select(X.split_sentences(F.col("t"), ("etc.",)).alias("s")).first()["s"]
    assert found == ["a b etc.  c.", "D"]
