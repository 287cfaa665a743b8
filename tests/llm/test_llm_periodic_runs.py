import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from slowtide.llm import periodic_runs
from slowtide.llm.queries import QUERIES
from tests.llm.conftest import make_docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words, least_periods=4, least_words=6):
    """Every maximal stretch of every period, kept if no smaller period spans it."""
    n, found = len(words), []
    for q in range(1, n // least_periods + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            start, length = i, j + q - i
            if length >= max(least_words, least_periods * q):
                own = words[start : start + length]
                if not any(own[p:] == own[:-p] for p in range(1, q)):
                    found.append((start, length, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    four = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    left = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *four, *[hashlib.sha256(t.encode()).hexdigest() for t in (listed, left)])


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("least_periods,least_words", [(4, 6), (2, 2), (3, 3)])
def test_runs_of_random_words(least_periods, least_words):
    draw = random.Random(7)
    for _ in range(1500):
        word = [draw.randrange(draw.choice((1, 2, 3, 5))) for _ in range(draw.randrange(40))]
        if draw.random() < 0.5:
            word += word[-draw.randrange(1, 9) :] * draw.randrange(1, 6)
        assert periodic_runs.runs_of(word, least_periods, least_words) == brute_runs(word, least_periods, least_words)


def test_stretches_hold_all_runs():
    draw = random.Random(3)
    for _ in range(300):
        texts = []
        for _ in range(draw.randrange(1, 5)):
            words = [str(draw.randrange(30)) for _ in range(draw.randrange(30))]
            block = [str(draw.randrange(6)) for _ in range(draw.randrange(1, 5))]
            words += block * draw.randrange(1, 7) + [str(draw.randrange(30)) for _ in range(draw.randrange(9))]
            texts.append(" ".join(words))
        runs, left = periodic_runs.find_runs(texts)
        for text, own, kept in zip(texts, runs, left):
            words = text.split()
            assert own == brute_runs(words)
            gone = {i for s, length, q in own for i in range(s + q, s + length)}
            assert kept.decode().split() == [w for i, w in enumerate(words) if i not in gone]


def test_lyndon_words_reach_to_the_next_smaller_suffix():
    draw = random.Random(5)
    for _ in range(200):
        word = [draw.randrange(3) for _ in range(draw.randrange(1, 25))]
        ranks = {s: r for r, s in enumerate(sorted(set(word)))}
        longest = [next((j for j in range(i + 1, len(word)) if word[j:] < word[i:]), len(word)) - i for i in range(len(word))]
        heads = [
            (i, own) for i, own in enumerate(longest) if word[max(i - own, 0) : i] != word[i : i + own] or longest[i - own] != own
        ]
        assert sorted(periodic_runs.lyndon_roots(word, ranks, 1)) == sorted(heads)


def test_edge_documents(spark, edge_docs, edge_rows, no_docs):
    found = periodic_runs.collapse_runs(edge_docs.withColumnRenamed("shard", "runs"))
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars", "ids", "n_lines", "node", "runs", "collapsed"]
    for row in found.collect():
        words = WORD.findall(row.text or "")
        assert not row.runs and row.collapsed == " ".join(words)
    assert periodic_runs.collapse_runs(no_docs).count() == 0


def test_only_ascii_white_space_divides_words(spark):
    docs = make_docs(spark, [(1, "a b\x0bc\x0cd\x85e\x1cf a "), (2, "xy " * 6), (3, "x y\t\n" * 5 + "x z"), (4, "\x00 \x00 \x00 \x00 \x00 \x00")])
    rows = {r.doc_id: r for r in periodic_runs.collapse_runs(docs).collect()}
    assert rows[1].collapsed == "a b c d\x85e\x1cf a "
    assert rows[2].collapsed == "xy" and [tuple(r) for r in rows[2].runs] == [(0, 6, 1)]
    assert rows[3].collapsed == "x y z" and [tuple(r) for r in rows[3].runs] == [(0, 11, 2)]
    assert rows[4].collapsed == "\x00"


def test_long_text(spark):
    words = [f"w{i % 7_000}" for i in range(30_000)]
    (row,) = periodic_runs.collapse_runs(make_docs(spark, [(1, " ".join(words))])).collect()
    assert [tuple(r) for r in row.runs] == [(0, 30_000, 7_000)]
    assert row.collapsed == " ".join(words[:7_000])


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    draw = np.random.default_rng(0)
    rows = [(i, " ".join(map(str, draw.integers(0, 4 + i % 40, draw.integers(0, 90))))) for i in range(400)]
    rows += [(None, "a b a b a b a b"), (7, None), (7, ""), (11, " \n "), (11, " \n ")]
    path = str(tmp_path_factory.mktemp("runs"))
    make_docs(spark, rows).write.parquet(f"{path}/documents.parquet")
    return path, rows


def test_query_against_brute_force(spark, planted):
    path, rows = planted
    found = rows_of(QUERIES["op11_periodic_runs"](spark, path))
    assert found == sorted((brute_row(*r) for r in rows), key=repr)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(400)) > 20


def test_query_on_the_table(spark, sf):
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert rows_of(QUERIES["op11_periodic_runs"](spark, sf)) == sorted((brute_row(*r) for r in texts), key=repr)
