import zlib

import numpy as np
import pytest

from slowtide.llm import quality
from slowtide.llm.queries import QUERIES
from tests.llm.conftest import make_docs


def number_of(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4


def plain_scores(texts, labels, towards_joint, towards_identity):
    """Dense densities of two classes, written out with determinants and inverses."""
    x = {i: quality.statistics([t or ""])[0] for i, t in texts.items()}
    learnt = [i for i in labels if i in x and number_of(i) != 2]
    rows, y = np.array([x[i] for i in learnt]), np.array([labels[i] for i in learnt])
    centre, scale = rows.mean(0), rows.std(0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = (rows - centre) / scale
    own = [np.cov(z[y == c].T, bias=True) for c in (0, 1)]
    joint = sum(np.cov(z[y == c].T, bias=True) * (y == c).sum() for c in (0, 1)) / len(y)
    density = []
    for c in (0, 1):
        s = (1 - towards_joint) * own[c] + towards_joint * joint
        s = (1 - towards_identity) * s + towards_identity * np.trace(s) / len(s) * np.eye(len(s))
        gap = (np.array([x[i] for i in texts]) - centre) / scale - z[y == c].mean(0)
        density.append(np.log((y == c).mean()) - 0.5 * np.einsum("ij,jk,ik->i", gap, np.linalg.inv(s), gap) - 0.5 * np.linalg.slogdet(s)[1])
    return dict(zip(texts, 1 / (1 + np.exp(-np.clip(density[1] - density[0], -700, 700)))))


def plain_statistics(text):
    """A few statistics of one text, word by word."""
    words = text.split()
    lines = [line for line in text.split("\n") if line]
    passages = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    share = lambda a, b: np.arcsin(np.sqrt(a / max(b, 1)))
    return {
        "words": np.log1p(len(words)),
        "variety": np.log1p(len(set(words))) - np.log1p(len(words)),
        "passages_repeated": share(len(passages) - len(set(passages)), len(passages)),
        "words_doubled": share(sum(a == b for a, b in zip(words, words[1:])), len(words) - 1),
        "lines_repeated": share(len(lines) - len(set(lines)), len(lines)),
        "commonest": share(max(map(words.count, set(words)), default=0), len(words)),
        "capitals": share(sum(c.isupper() for c in text), sum(c.isalpha() for c in text)),
        "digits": share(sum(c.isdigit() for c in text), sum(not c.isspace() for c in text)),
    }


@pytest.fixture(scope="module")
def tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    return docs, labels, {r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r.quality for r in labels.collect()}


def test_statistics_equal_plain_counts_in_any_block(tables):
    texts = [t[:4000] for t in list(tables[2].values())[:60]] + ["", " \n", "a a a a a a\n\na a", "ÄÖ 12 !? 日本 ||", "x\n" * 9]
    found = quality.statistics(texts)
    for row, text in zip(found, texts):
        np.testing.assert_allclose(row, quality.statistics([text])[0])
        for name, value in plain_statistics(text).items():
            assert abs(row[quality.STATISTICS.index(name)] - value) < 1e-9, (name, text[:50])
    assert not found[60].any() and quality.statistics([]).shape == (0, len(quality.STATISTICS))


def test_scores_equal_a_dense_discriminant(spark, tables, sf):
    docs, labels, texts, marks = tables
    found = {r.doc_id: r for r in QUERIES["op12_quality"](spark, sf).collect()}
    assert found.keys() == texts.keys()
    fits = [plain_scores(texts, marks, a, b) for a in quality.TOWARDS_JOINT for b in quality.TOWARDS_IDENTITY]
    assert any(max(abs(fit[i] - found[i].score) for i in texts) < 1e-6 for fit in fits)
    for i, row in found.items():
        assert row.held_out == (number_of(i) == 2) and row.predicted == (row.score >= 0.7) and 0 <= row.score <= 1


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    scored = QUERIES["op12_quality"](spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    good = [r.predicted for r in scored if r.quality == 1]
    poor = [r.predicted for r in scored if r.quality == 0]
    assert np.mean(good) >= 0.99 and np.mean(poor) <= 0.05
    assert min(len(good), len(poor)) > 20


def test_labels_of_held_out_rows_do_not_matter(spark, tables):
    docs, labels, texts, marks = tables
    turned = labels.withColumn("quality", quality.F.expr("if(pmod(crc32(cast(doc_id as string)), 4) = 2, 1 - quality, quality)"))
    scores = [{r.doc_id: r.score for r in quality.document_quality(docs, own).collect()} for own in (labels, turned)]
    assert all(abs(scores[0][i] - scores[1][i]) < 1e-9 for i in texts)


def test_edge_documents(spark, tables, edge_docs, edge_rows, no_docs):
    docs, labels, _, _ = tables
    both = make_docs(spark, [tuple(r) for r in docs.collect()]).unionByName(edge_docs).withColumnRenamed("node", "statistics")
    found = quality.document_quality(both, labels)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"] and found.count() == docs.count() + len(edge_rows)
    missing = [r for r in found.collect() if r.doc_id is None]
    assert len(missing) == 1 and not missing[0].held_out
    assert quality.document_quality(no_docs, labels).count() == 0


def test_without_both_classes_nothing_is_known(spark, edge_docs, edge_rows):
    some = spark.createDataFrame([(4, 1), (5, 1), (5, None), (4, 0), (None, 0), (99, 0)], "doc_id long, quality int")
    rows = quality.document_quality(edge_docs, some).collect()
    assert len(rows) == len(edge_rows) and {(r.score, r.predicted) for r in rows} == {(0.5, 0)}


def test_equal_statistics_do_not_break_the_fit(spark):
    docs = make_docs(spark, [(i, "the same text again") for i in range(40)] + [(i, "") for i in range(40, 80)])
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(80)], "doc_id long, quality int")
    rows = {r.doc_id: r for r in quality.document_quality(docs, labels).collect()}
    assert rows[3].predicted == 1 and rows[60].predicted == 0 and all(0 <= r.score <= 1 for r in rows.values())
