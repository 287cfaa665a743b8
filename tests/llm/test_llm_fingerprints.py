"""Fingerprints: edited texts by brute force, equality, likeness, and the place of edits."""

import hashlib
import random

from slowtide.llm.fingerprints import edited_paragraphs, fingerprint_edits, fingerprints, likeness, with_fingerprint


def one(text):
    return fingerprints([text])[0][0]


def expected(rows):
    """(doc_id, n_chars, sha of the edited text, edited text, next text) in the order of doc_id."""
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1].encode()))
    out = []
    for at, (doc_id, text) in enumerate(order):
        following = order[(at + 1) % len(order)][1]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + following[:cut]
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), text, edited, following))
    return out


def check(rows, found):
    want = expected(rows)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert len(found) == len(want)
    for w, r in zip(sorted(want, key=key), sorted(found, key=key)):
        assert (r.doc_id, r.n_chars, r.edited_sha256) == w[:3]
        assert r.fingerprint == one(w[3]) and r.edited_fingerprint == one(w[4])
        assert r.near_edited == likeness(one(w[3]), one(w[4])) and r.near_next == likeness(one(w[3]), one(w[5]))


def test_all_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    found = fingerprint_edits(docs.repartition(5)).collect()
    check(rows, found)
    long = [r for r in found if r.n_chars > 500]
    assert sum(0.5 < r.near_edited < 1 for r in long) > 0.9 * len(long)
    assert sum(r.near_next < 0.4 for r in long) > 0.9 * len(long)


def test_edges(spark, edge_docs, edge_rows, no_docs):
    check(edge_rows, fingerprint_edits(edge_docs).collect())
    assert fingerprint_edits(no_docs).count() == 0
    single = spark.createDataFrame([(5, "abcdefgh")], "doc_id long, text string")
    assert fingerprint_edits(single).first().edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()
    nulls = spark.createDataFrame([(None, "abcdefgh"), (None, "xyzw")], "doc_id long, text string")
    check([(None, "abcdefgh"), (None, "xyzw")], fingerprint_edits(nulls).collect())


def test_equal_texts_only_have_equal_roots(edge_docs, edge_rows):
    texts = [t or "" for _, t in edge_rows] + ["a\nb", "a b", "a\n\nb", "a \nb", "ab"]
    together = fingerprints(texts)[0]
    assert together == [one(t) for t in texts]
    assert len({f[:32] for f in together}) == len(set(texts))
    rows = with_fingerprint(edge_docs).collect()
    assert all(r.fingerprint == one(r.text or "") for r in rows)


def test_edits_are_located():
    rng = random.Random(8)
    lines = [" ".join(rng.choice(["red", "green", "blue", "one", "two"]) + str(rng.randrange(99)) for _ in range(12)) for _ in range(60)]
    changed = list(lines)
    changed[17] = changed[17].replace(" ", " very ", 1)
    changed.insert(40, "a new paragraph")
    a, b = one("\n".join(lines)), one("\n".join(changed))
    assert sorted(edited_paragraphs(a, b)) == [("+", 17), ("+", 40), ("-", 17)]
    assert edited_paragraphs(a, a) == [] and 0.9 < likeness(a, b) < 1 and likeness(a, a) == 1
    assert likeness(one(""), one("")) == 1 and likeness(one(""), one("x")) == 0
