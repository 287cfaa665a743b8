"""The pipeline's stages on what the stage before kept, against brute force."""

import pytest

import corpus_pipeline as pipeline
from slowtide.llm.queries import CATEGORIES, QUERIES, WORD_TOKENIZER, labels
from slowtide.llm.toxicity import document_toxicity
from slowtide.session import write_once

from tests.llm import test_llm_line_dedup, test_llm_ngram_join, test_llm_packing
from tests.llm.conftest import make_docs


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def brute_lines(rows):
    """Texts after line dedup, from the brute-force digests' own rule."""
    from collections import defaultdict

    key = lambda x: x.strip(" \t\n\v\f\r").translate(test_llm_line_dedup.LOWER)
    docs = defaultdict(set)
    for doc_id, text in rows:
        for line in text.split("\n"):
            if len(key(line)) >= 40:
                docs[key(line)].add(doc_id)
    lost = {k: max(ids) for k, ids in docs.items() if len(ids) >= 5}
    return [(i, "\n".join(x for x in t.split("\n") if lost.get(key(x), i) == i)) for i, t in rows]


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, tables = docs.columns, [docs]
    for name, stage in pipeline.STAGES[:-1]:
        tables.append(write_once(stage(spark, tables[-1], sf), f"test-{name}"))
        assert tables[-1].columns == columns
    scored = document_toxicity(docs, labels(spark, sf), CATEGORIES).where("not is_toxic")
    assert sorted(rows_of(scored)) == sorted(rows_of(tables[1]))
    assert sorted(brute_lines(rows_of(tables[1]))) == sorted(rows_of(tables[2]))
    assert all(r.n_chars == len(r.text) for r in tables[2].collect())
    classes = test_llm_ngram_join.brute(rows_of(tables[2]))
    assert sorted(r.doc_id for r in tables[3].collect()) == [i for i, c, _ in classes if i == c]
    last = pipeline.STAGES[-1][1](spark, tables[3], sf).collect()
    test_llm_packing.check(rows_of(tables[3]), last, 2048)
    assert len(pipeline.run(spark, sf).collect()) == len(last)


@pytest.mark.parametrize("number", range(4))
def test_edges(spark, sf, edge_docs, no_docs, number):
    name, stage = pipeline.STAGES[number]
    assert stage(spark, no_docs, sf).count() == 0
    kept = stage(spark, edge_docs, sf)
    if name != "packing":
        assert kept.columns == edge_docs.columns
    ids = {r.doc_id for r in kept.collect()}
    expected = {1, 2, 3, 4, 5, 6, 7, 8, 9, None} - ({5} if name == "ngram_join" else set())
    assert ids == expected
    if name == "ngram_join":
        assert kept.count() == len(expected)


def test_stages_match_the_named_operators():
    assert [name for name, _ in pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_join", "packing"]
    assert len(QUERIES) == 13 and WORD_TOKENIZER
    assert make_docs is not None


def test_texts_that_share_an_id_are_judged_on_their_own(spark, sf):
    x, y, z = (" ".join(f"{c}{i}" for i in range(40)) for c in "xyz")
    stage = dict(pipeline.STAGES)["ngram_join"]
    for one, two in ((x, y), (y, x)):  # either order of texts and digests
        kept = stage(spark, make_docs(spark, [(1, one), (1, two), (2, one), (3, two + " more"), (3, z)]), sf)
        assert sorted(rows_of(kept)) == sorted([(1, one), (1, two), (3, z)])
    kept = stage(spark, make_docs(spark, [(None, x), (None, x + " more"), (None, y), (4, x), (None, None)]), sf)
    assert {r for r in rows_of(kept)} == {(4, x), (None, y), (None, None)} and kept.count() == 3
