"""Classifier chains: held-out accuracy, the chain's use of earlier categories, edges."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from slowtide.llm import toxicity
from slowtide.llm.toxicity import document_toxicity, fit_chain, fit_toxicity, text_features

CATEGORIES = ("junk", "toxic")


def labelled(spark, folder):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    return labels.selectExpr("doc_id", "1 - quality as junk", "toxic")


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    labels = labelled(spark, folder)
    fit, held = labels.where("doc_id % 4 <> 0"), labels.where("doc_id % 4 = 0")
    rows = document_toxicity(docs, fit, CATEGORIES).join(held, "doc_id").collect()
    toxic, clean = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    assert len(toxic) > 50
    # with 3,000 labelled rows; with the 10,000 of a large table 0.99 and none
    assert sum(r.is_toxic for r in toxic) >= 0.8 * len(toxic)
    assert sum(r.is_toxic for r in clean) <= 0.01 * len(clean)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(n))


def test_later_category_uses_the_earlier_one():
    rng, texts, labels = random.Random(4), [], []
    for _ in range(1500):
        first, second = rng.random() < 0.5, rng.random() < 0.3
        texts.append(words(rng, 20) + (" alphaword" if first else "") + (" betaword" if second else ""))
        labels.append((int(first), int(second and not first)))
    chain = fit_chain(texts[:1200], np.array(labels)[:1200], ("first", "both"))
    assert chain.links[1, 0] < 0
    found = chain.probabilities(texts[1200:]) >= chain.thresholds[:, None]
    assert (found.T.astype(int) == np.array(labels)[1200:]).mean() > 0.97


def test_features_do_not_depend_on_the_block():
    texts = ["Some words !!", "", "日本語 mixed Words, words", "x" * 3000]
    together, bounds = text_features(texts)
    for text, a, b in zip(texts, bounds[:-1], bounds[1:]):
        assert text_features([text])[0].tolist() == together[a:b].tolist()


@pytest.mark.parametrize("labels", [[], [(1, 0, 0)], [(4, 1, None), (None, 1, 1), (99, 0, 1)], [(4, 0, 1), (4, 0, 0), (6, 0, 1)]])
def test_edges(spark, edge_docs, no_docs, labels):
    table = spark.createDataFrame(labels, "doc_id long, junk int, toxic int")
    rows = document_toxicity(edge_docs, table, CATEGORIES).collect()
    assert len(rows) == edge_docs.count() and all(0 <= r.p_toxic <= 1 for r in rows)
    if not any(t for _, _, t in labels):
        assert not any(r.is_toxic for r in rows)
    assert document_toxicity(no_docs, table, CATEGORIES).count() == 0


def marked_texts(n):
    """Texts of which each third is junk, and half of those toxic, by words of their own."""
    rng, rows = random.Random(7), []
    for i in range(n):
        junk, toxic = int(i % 3 == 0), int(i % 6 == 0)
        rows.append((i, words(rng, 12) + (" junkword" if junk else "") + (" vileword" if toxic else ""), junk, toxic))
    return rows


def tables(spark, rows):
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(r[0], *r[2:]) for r in rows], "doc_id long, junk int, toxic int")


def same(a, b):
    assert np.array_equal(a.features, b.features) and len(a.features)
    for x, y in ((a.weights, b.weights), (a.links, b.links), (a.bias, b.bias), (a.thresholds, b.thresholds)):
        assert np.allclose(x, y, rtol=1e-9, atol=1e-12)


def test_fit_in_spark_equals_the_local_one(spark):
    rows = marked_texts(600)
    rows += [(1000 + i, *rows[i][1:]) for i in range(0, 100, 7)] + [(2000, "", 0, 0), (2001, " ", 1, 0)]
    docs, labels = tables(spark, rows)
    same(fit_toxicity(docs, labels, CATEGORIES), fit_chain([r[1] for r in rows], np.array([r[2:] for r in rows]), CATEGORIES))


def test_one_very_long_labelled_text_costs_no_other_row(spark):
    rows = marked_texts(300)
    docs, labels = tables(spark, rows)
    ids = spark.createDataFrame([(r[0],) for r in rows], "doc_id long")
    first = ids.orderBy(F.xxhash64("doc_id"), "doc_id").first().doc_id
    text = "plain words " * 2_100_000  # more than 25 million code points
    long = F.when(F.col("doc_id") == first, F.repeat(F.lit("plain words "), 2_100_000)).otherwise(F.col("text"))
    chain = fit_toxicity(docs.withColumn("text", long), labels, CATEGORIES)
    same(chain, fit_chain([text if r[0] == first else r[1] for r in rows], np.array([r[2:] for r in rows]), CATEGORIES))
    assert (chain.probabilities(["some vileword junkword", "some words"])[1] >= chain.thresholds[1]).tolist() == [True, False]


def test_labels_without_a_text_do_not_fill_the_sample(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE", 300)
    rows = marked_texts(300)
    docs, labels = tables(spark, rows)
    docs = docs.unionByName(spark.createDataFrame([(i, None) for i in range(1000, 1300)], docs.schema))
    more = spark.createDataFrame([(i, 1, 1) for i in range(1000, 1600)], labels.schema)
    same(fit_toxicity(docs, labels.unionByName(more), CATEGORIES), fit_chain([r[1] for r in rows], np.array([r[2:] for r in rows]), CATEGORIES))
