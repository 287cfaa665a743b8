"""Line dedup against a dictionary of lines."""

import hashlib
import random
from collections import defaultdict

import pytest

from slowtide.llm.line_dedup import LineRuns, dedup_lines, line_keys, line_runs

from tests.llm.conftest import make_docs

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_chars, min_docs):
    def key(line):
        return line.strip(" \t\n\v\f\r").translate(LOWER)

    docs = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                docs[key(line)].add(doc_id)
    order = lambda d: (d is not None, d or 0)
    lost = {k: max(ids, key=order) for k, ids in docs.items() if len(ids) >= min_docs}
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in lost or lost[key(x)] == doc_id]
        out.append((doc_id, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def found(rows):
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, digest(r.text)) for r in rows.collect()), key=str)


def random_rows(n, seed):
    rng = random.Random(seed)
    lines = ["", "x", "Short é line", "A line with ÀÉ and ENOUGH letters", " a line with ÀÉ and enough letters\t", "\x1f odd \x85 white space"]
    lines += [f"filler line number {i}" for i in range(20)]
    return [(rng.randrange(n), "\n".join(rng.choice(lines) for _ in range(rng.randrange(8)))) for _ in range(n)]


@pytest.mark.parametrize("batches, fan", [(1, 2), (5, 2), (4, 4)])
def test_random(spark, batches, fan):
    rows = random_rows(120, batches)
    df = make_docs(spark, rows)
    assert found(dedup_lines(df, 8, 3, batches, fan)) == brute(rows, 8, 3)


def test_edges(edge_docs, edge_rows, no_docs):
    got = dedup_lines(edge_docs, 3, 2)
    assert found(got) == brute(edge_rows, 3, 2)
    assert set(edge_docs.columns) < set(got.columns)
    assert dedup_lines(no_docs).count() == 0


def test_runs_are_compacted(spark):
    store = LineRuns(spark, fan=2)
    for i in range(3):
        docs = spark.createDataFrame([(10 - i, "shared line\nown line %d" % i)], "doc_id long, text string")
        store.add(line_keys(docs, 5))
    assert [len(level) for level in store.levels] == [1, 1]
    rows = {(r.keeper, r.docs) for r in store.entries().collect()}
    assert rows == {(10, 3), (10, 1), (9, 1), (8, 1)}


def test_batches_fall_and_cover(spark):
    docs = spark.range(100).selectExpr("id as doc_id", "concat('line of document ', id) as text")
    assert line_runs(docs, 5, 4).entries().count() == 100
