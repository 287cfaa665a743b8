import datetime as dt
import sys
import uuid

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from slowtide.functions.scorers import BatchClassifier, BatchEncoder, BatchPairScorer, LexicalEncoder, LexicalPairScorer, length_batches, padding_share
from slowtide.operators import scoring
from slowtide.plans import analyses
from slowtide.session import fresh_path
from slowtide.sources.score_table import ScoreTable, VectorTable

# The workers get this module's model loaders with their tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
WORDS = {"x": ["the"], "y": ["cat", "dog"]}


@pytest.fixture
def texts(spark):
    # one text in a third of the rows
    return spark.createDataFrame([(i, "the cat" if i % 3 == 0 else None if i == 7 else f"dog {'a' * (i % 4)}") for i in range(12)], "id int, msg string")


def test_second_run_scores_nothing(spark, texts):
    table = ScoreTable(spark, fresh_path(spark, "scores"))
    fill = lambda labels, model, run: scoring.fill_scores(texts, LexicalPairScorer(WORDS), labels, table, model, run)
    distinct = texts.where("msg is not null").select("msg").distinct().count()
    assert fill(["x"], "m", "1") == distinct
    assert fill(["x", "y"], "m", "2") == distinct
    assert fill(["y", "x", "y"], "m", "3") == 0
    # another model has its own scores
    assert fill(["x"], "other", "4") == distinct


def test_every_row_gets_its_vector(spark, texts):
    table = ScoreTable(spark, fresh_path(spark, "scores"))
    scorer = LexicalPairScorer(WORDS)
    labels = ["y", "x", "y"]
    found = scoring.memoised_label_vectors(texts, scorer, labels, table, "m", "1", ["id"])
    direct = scoring.add_label_vectors(texts, scorer, labels)
    as_dict = lambda df: {r["id"]: r["embedding"] for r in df.collect()}
    assert as_dict(found) == as_dict(direct) and found.count() == texts.count()
    assert as_dict(found)[7] is None


def test_memoised_embeddings(spark, texts):
    table = VectorTable(spark, fresh_path(spark, "vectors"))
    encoder = LexicalEncoder(4)
    for run in ("1", "2"):
        found = scoring.memoised_embeddings(texts, encoder, table, "m", run, ["id"])
    assert {r["id"]: r["embedding"] for r in found.collect()} == {r["id"]: r["embedding"] for r in scoring.add_embeddings(texts, encoder).collect()}
    assert table.entries("m").count() == texts.where("msg is not null").select("msg").distinct().count()


def test_pairs_hits_misses_reattach(spark):
    pairs = spark.createDataFrame([(1, b"a", "x"), (2, b"a", "x"), (3, b"b", "x"), (4, b"b", "y"), (5, b"b", "y")], "id int, text_key binary, label string")
    cache = spark.createDataFrame([(b"a", "x", 0.5), (b"b", "z", 0.1)], "text_key binary, label string, score float")
    hits, misses = scoring.cache_hits(pairs, cache, ["id"]), scoring.cache_misses(pairs, cache)
    assert sorted(r["id"] for r in hits.collect()) == [1, 2]
    assert sorted((bytes(r["text_key"]), r["label"]) for r in misses.collect()) == [(b"b", "x"), (b"b", "y")]
    fresh = misses.withColumn("score", F.lit(0.25).cast("float"))
    known = cache.join(pairs.select("text_key", "label").distinct(), ["text_key", "label"], "left_semi")
    found = scoring.attach_scores(pairs, known, fresh, ["id"])
    assert {r["id"]: r["score"] for r in found.collect()} == {1: 0.5, 2: 0.5, 3: 0.25, 4: 0.25, 5: 0.25}


def test_every_text_with_every_label(spark, texts):
    found = scoring.pair_with_labels(texts, ["p", "q", "p"])
    assert found.count() == 36 and {(r["label_idx"], r["label"]) for r in found.collect()} == {(0, "p"), (1, "q"), (2, "p")}


def test_long_scores(spark, texts):
    found = scoring.score_pairs(texts, LexicalPairScorer(WORDS), ["x", "y"])
    assert found.count() == 22 and found.columns == ["id", "msg", "label_idx", "score", "label"]


def load_lengths():
    """Stands for a model: three numbers per text."""

    def predict(texts):
        return np.array([[len(t), t.count(" "), 1] for t in texts], dtype=np.float32)

    return predict


def load_pairs():
    def predict(texts, hypotheses):
        # contradiction, neutral, entailment
        return np.array([[0, 9, 1 if h.split()[-1].strip(".") in t else -1] for t, h in zip(texts, hypotheses)], dtype=np.float32)

    return predict


def test_plugged_in_models(spark, texts):
    encoded = scoring.add_embeddings(texts, BatchEncoder(load_lengths, 5)).collect()
    assert {r["id"]: r["embedding"] for r in encoded}[0] == [7.0, 1.0, 1.0]
    assert {r["id"]: r["embedding"] for r in encoded}[7] is None
    classes = scoring.add_embeddings(texts, BatchClassifier(load_lengths, 5)).where("msg is not null").collect()
    assert all(sum(r["embedding"]) == pytest.approx(1, abs=1e-5) for r in classes)
    scorer = BatchPairScorer(load_pairs, entailment_index=2, contradiction_index=0, batch_size=3)
    scored = scoring.add_label_vectors(texts, scorer, ["cat", "dog"]).collect()
    yes, no = 1 / (1 + np.exp(-1)), 1 / (1 + np.exp(1))
    assert {r["id"]: r["embedding"] for r in scored}[0] == pytest.approx([yes, no])
    table = ScoreTable(spark, fresh_path(spark, "scores"))
    memo = scoring.memoised_label_vectors(texts, scorer, ["cat", "dog"], table, "nli", "1", ["id"]).collect()
    assert {r["id"]: r["embedding"] for r in memo} == {r["id"]: r["embedding"] for r in scored}


def test_batches_hold_texts_of_similar_length():
    lengths = np.random.default_rng(0).lognormal(5, 1.2, 3000).astype(int)
    for size, budget in ((100, 1 << 18), (7, 4000), (1000, 1), (1, 1 << 18)):
        found = length_batches(lengths, size, budget)
        assert sorted(np.concatenate(found).tolist()) == list(range(3000))
        assert all(len(b) == 1 or (len(b) <= size and len(b) * lengths[b].max() <= budget) for b in found)
    arriving = [np.arange(a, a + 100) for a in range(0, 3000, 100)]
    assert padding_share(lengths, arriving) > 0.8 > 0.2 > padding_share(lengths, length_batches(lengths, 100, 1 << 18))
    assert length_batches(np.zeros(0, int), 5, 5) == [] and padding_share(np.zeros(3, int), [np.arange(3)]) == 0


def test_batching_does_not_change_vectors(spark):
    texts = spark.range(700).select("id", F.expr("if(id % 13 = 0, null, repeat(concat('ab', id), cast(1 + id % 57 as int)))").alias("msg"))

    def load():
        return lambda batch: np.array([[len(t), t.count("1"), len(set(map(len, batch))) > 0] for t in batch], np.float32)

    plain = {r["id"]: r["msg"] for r in texts.collect()}
    for size, budget in ((100, 1 << 18), (3, 50)):
        for row in scoring.add_embeddings(texts.repartition(3), BatchEncoder(load, size, budget)).collect():
            text = plain[row["id"]]
            assert row["embedding"] == (None if text is None else [len(text), text.count("1"), 1])


def test_model_runs_once_per_row(spark, texts):
    """Null checks after a model call must not repeat the call."""
    calls = spark.sparkContext.accumulator(0)

    def load():
        def predict(batch):
            calls.add(len(batch))
            return np.ones((len(batch), 2), dtype=np.float32)

        return predict

    from slowtide.operators.windows import pool_windows

    dated = texts.select("id", "msg", F.lit("s").alias("series"), F.expr("timestamp_ntz '2024-01-01' + id * interval '1' hour").alias("date"))
    pool_windows(scoring.text_vectors(dated, BatchEncoder(load)), "1d").collect()
    assert calls.value == 11


def _counted(folder):
    def load():
        def predict(texts):
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as file:
                file.write("\n".join(texts))
            return np.array([[len(t), t.count("a")] for t in texts], np.float32)

        return predict

    return load


def test_analyses_call_a_model_once_per_text(spark, tmp_path):
    """Repeated texts and repeated analyses: each distinct text reaches the model once."""
    rows = [(i, i % 40, dt.datetime(2024, 1, 1 + i % 25), i < 40, "PracticeLogs", "me", "t", f"text {'a' * (i % 5)}") for i in range(120)]
    schema = "msg_id long, thread_id long, date timestamp_ntz, is_first_in_thread boolean, category string, author string, title string, msg string"
    messages = spark.createDataFrame(rows, schema)
    memo = scoring.Memo(spark, str(tmp_path / "memo"), "m", "1")
    encoder = BatchEncoder(_counted(str(tmp_path)), 10)
    for _ in range(2):
        analyses.author_slowness(messages, encoder, memo=memo).collect()
        analyses.slowness_over_time_scales(messages, encoder, 3, memo=memo).collect()
    called = [t for name in tmp_path.iterdir() if name.is_file() for t in name.read_text().split("\n")]
    assert sorted(called) == sorted({r[-1] for r in rows})
    # without a memo a model still sees each text once per run
    analyses.author_slowness(messages, encoder).collect()
    called = [t for name in tmp_path.iterdir() if name.is_file() for t in name.read_text().split("\n")]
    assert len(called) == 2 * len({r[-1] for r in rows})


def test_later_runs_replace_earlier_ones(spark):
    table = ScoreTable(spark, fresh_path(spark, "scores"))
    for run in range(1, 12):
        fresh = spark.createDataFrame([(b"k", "x", float(20 - run))], "text_key binary, label string, score float")
        table.append(fresh, "m", f"run-{run}")
    assert [r["score"] for r in table.latest("m", ["x"]).collect()] == [9.0]
