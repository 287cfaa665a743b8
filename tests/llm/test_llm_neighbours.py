"""Neighbours: exact distances and ties, recall against brute force, skew and odd vectors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from slowtide.llm import neighbours
from slowtide.llm.neighbours import CentroidGraph, balanced_centroids, nearest_neighbours

SCHEMA = "vec_id long, embedding array<float>, label int, rank string, list string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "x") for i, v in rows], SCHEMA)


def brute(rows, is_query, k):
    """Nearest of each query by distance, then vec_id; only usable vectors."""
    usable = {i: np.array(v, float) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    out = {}
    for q, own in usable.items():
        if is_query(q):
            near = sorted((math.dist(own, v), i) for i, v in usable.items() if i != q)
            out[q] = [(i, d) for d, i in near[:k]]
    return out


def run(df, k=10, every=100):
    found = {}
    for r in nearest_neighbours(df, F.col("vec_id") % every == 0, k).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(found[r.query_id])
    return found


def same(found, expected):
    assert found.keys() == {q for q, near in expected.items() if near}
    for q, near in found.items():
        assert [i for i, _ in near] == [i for i, _ in expected[q]]
        assert np.allclose([d for _, d in near], [d for _, d in expected[q]], rtol=1e-12, atol=0)


def recall(found, expected):
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in near}) for q, near in expected.items())
    return hits / sum(map(len, expected.values()))


def test_recall_on_the_table(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    found, expected = run(df), brute(rows, lambda i: i % 100 == 0, 10)
    assert recall(found, expected) >= 0.9


@pytest.mark.parametrize("lists", [1, 128])
def test_few_lists_still_give_all_ranks(spark, monkeypatch, lists):
    monkeypatch.setattr(neighbours, "LISTS", lists)
    rng = np.random.default_rng(1)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(400, 8)).astype(np.float32))]
    found, expected = run(frame(spark, rows), 30, 50), brute(rows, lambda i: i % 50 == 0, 30)
    assert all(len(near) == 30 for near in found.values())
    distance = {q: {i: d for i, d in brute(rows, lambda i: i == q, 400)[q]} for q in found}
    assert all(d == pytest.approx(distance[q][i]) for q, near in found.items() for i, d in near)
    if lists == 128:
        assert recall(found, expected) > 0.95


def test_odd_vectors_ties_and_few_rows(spark):
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0, 0.0], [nan, 1.0], [inf, 1.0], [None, 1.0], [1.0, 2.0, 3.0]]
    rows = [(10 * i, v) for i, v in enumerate(odd)] + [(100, [1.0, 0.0]), (101, [2.0, 0.0]), (99, [0.0, 0.5]), (7, [1.0, 1.0]), (200, [1.0, 0.0])]
    expected = brute([r for r in rows if r[1] != odd[-1]], lambda i: i % 100 == 0, 10)
    same(run(frame(spark, [*rows, rows[-1], (None, [1.0, 1.0])])), expected)
    assert run(frame(spark, [(100, [1.0, 2.0])])) == {} and run(frame(spark, [])) == {}


def test_many_equal_vectors(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 50)
    rng = np.random.default_rng(2)
    rows = [(i, [1.0, 1.0, 0.5]) for i in range(300)] + [(300 + i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 3)).astype(np.float32))]
    found, expected = run(frame(spark, rows)), brute(rows, lambda i: i % 100 == 0, 10)
    assert recall(found, expected) > 0.95
    # among equal vectors the smallest vec_ids, exactly
    for q in (0, 100, 200):
        assert found[q] == expected[q]


def test_graph_finds_the_nearest_centroids():
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(3000, 16))
    centroids = balanced_centroids(rows)
    graph = CentroidGraph.build(centroids)
    found, apart = graph.search(rows[:200], 8)
    true = np.argsort(((rows[:200, None] - centroids[None]) ** 2).sum(2), axis=1)
    assert np.mean([len(set(a) & set(b)) / 8 for a, b in zip(true[:, :8].tolist(), found.tolist())]) > 0.9
    assert (np.diff(apart, axis=1) >= 0).all()
    row, _ = graph.lists_of_row(rows)
    assert set(row.tolist()) == set(range(3000))
