"""The chosen-path join against all pairs, at every depth of the recursion."""

import random
from collections import Counter

import pytest

from slowtide.llm import ngram_join
from slowtide.llm.components import connected_components
from slowtide.llm.ngram_join import near_duplicates, runs_needed

from tests.llm.conftest import make_docs


def shingle_set(text):
    words = [w for w in (text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def components(nodes, links):
    top = {n: n for n in nodes}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute(rows):
    docs = {i: shingle_set(t) for i, t in rows if i is not None}
    ids = sorted(docs)
    links = [
        (a, b)
        for n, a in enumerate(ids)
        for b in ids[n + 1 :]
        if docs[a] and docs[b] and 5 * len(docs[a] & docs[b]) >= 4 * len(docs[a] | docs[b])
    ]
    count = Counter(x for pair in links for x in pair)
    return sorted((i, c, count[i]) for i, c in components(ids, links).items())


def corpus(seed, groups):
    """Random documents, and per group an original with near copies at varied distances."""
    rng, rows = random.Random(seed), []
    word = lambda: "w%d" % rng.randrange(500)
    passage = [word() for _ in range(30)]
    for size in groups:
        original = [word() for _ in range(rng.randrange(20, 120))] + (passage if rng.random() < 0.5 else [])
        for _ in range(size):
            copy = list(original)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("small, depth, block", [(64, 5, 512), (3, 2, 7), (2, 5, 16)])
def test_random(spark, monkeypatch, small, depth, block):
    for name, value in (("SMALL", small), ("DEPTH", depth), ("BLOCK_SETS", block)):
        monkeypatch.setattr(ngram_join, name, value)
    rows = corpus(small, [1] * 60 + [2] * 20 + [40, 25])
    assert sorted(map(tuple, near_duplicates(make_docs(spark, rows)).collect())) == brute(rows)


def test_edges(spark, edge_docs, edge_rows, no_docs):
    found = sorted(map(tuple, near_duplicates(edge_docs).collect()))
    assert found == brute(list(dict.fromkeys(edge_rows)))
    assert near_duplicates(no_docs).count() == 0
    alone = make_docs(spark, [(1, None), (2, "")])
    assert sorted(map(tuple, near_duplicates(alone).collect())) == [(1, 1, 0), (2, 2, 0)]
    two_texts = make_docs(spark, [(1, "a b c d e f"), (1, "x y z"), (2, "x y z"), (3, "a b c d e f")])
    found = near_duplicates(two_texts).collect()
    assert [r.doc_id for r in sorted(found)] == [1, 2, 3] and sum(r.class_id == 1 for r in found) == 2


def test_runs_reach_the_recall():
    assert runs_needed(0.8, 0.9999) == 4 and runs_needed(1.0, 0.99) == 1
    with pytest.raises(ValueError):
        runs_needed(0.5, 0.9)


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(7, 7)]
    found = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    expected = components({x for e in edges for x in e}, edges)
    assert {r.node: r.component for r in found} == {n: c for n, c in expected.items() if n != c}


def test_large_groups_are_divided_where_sketches_differ(spark, monkeypatch):
    for name, value in (("SMALL", 3), ("BLOCK_SETS", 8)):
        monkeypatch.setattr(ngram_join, name, value)
    rng, rows = random.Random(3), []
    template = ["t%d" % i for i in range(60)]
    for family in range(8):  # one template in each text; only texts of one family are near
        own = ["f%d" % rng.randrange(10**6) for _ in range(40)]
        rows += [" ".join([*template, *own, "v%d" % rng.randrange(10**6)]) for _ in range(6)]
    sent, check = [], ngram_join.check_groups

    def spy(dealt, *args):
        sent.append(dealt.select("comp", "set_id").distinct().groupBy("comp").count().agg({"count": "max"}).first()[0])
        return check(dealt, *args)

    monkeypatch.setattr(ngram_join, "check_groups", spy)
    rows = list(enumerate(rows))
    assert sorted(map(tuple, near_duplicates(make_docs(spark, rows)).collect())) == brute(rows)
    assert sent == [6]
