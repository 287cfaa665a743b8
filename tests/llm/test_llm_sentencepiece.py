"""Encoding, decoding and counting against the tokenizer's library in unigram mode."""

import random

import public_tokenizers
import sentencepiece

from slowtide.llm.sentencepiece_viterbi import ViterbiEncoder, decode_documents, encode_documents
from slowtide.llm.token_counts import TokenCounter, count_tokens
from slowtide.llm.unigram import load_vocabulary, unigram_proto

PATH = public_tokenizers.path("piece_bpe_32k.model")
PROTO = unigram_proto(PATH)
LIBRARY = sentencepiece.SentencePieceProcessor(model_proto=PROTO.SerializeToString())
SCORES = {p.piece: p.score for p in PROTO.pieces if p.type == 1}
UNKNOWN = min(SCORES.values()) - 10


def score(text):
    """The best sum of scores over all ways to divide a text, an unknown character being a piece of its own."""
    seen = "▁" + text.replace(" ", "▁") if text else ""
    best = [0.0]
    for end in range(1, len(seen) + 1):
        pieces = ((start, seen[start:end]) for start in range(max(0, end - 16), end))
        reach = [best[start] + SCORES[p] for start, p in pieces if p in SCORES]
        if seen[end - 1] not in SCORES:
            reach.append(best[end - 1] + UNKNOWN)
        best.append(max(reach))
    return int(best[-1])


def random_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("ab tehn ▁\n日😀thein  erx,.'s(") for _ in range(rng.randrange(60))) for _ in range(n)]


def encode(encoder, texts):
    ids, bounds = encoder.encode(texts)
    return [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]


def test_random_texts():
    vocabulary, texts = load_vocabulary(PATH), random_texts(3000, 1) + ["a" * 700, " " * 40, "", "\x00\x7f"]
    expected = [LIBRARY.encode(t) for t in texts]
    assert encode(ViterbiEncoder(vocabulary), texts) == expected
    counter = TokenCounter(vocabulary, remembered=100)
    counts, scores = counter.count(texts)
    assert counts.tolist() == [len(e) for e in expected]
    for text, own in list(zip(texts, scores.tolist()))[:500]:
        assert own == score(text), text


def test_all_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    encoded = encode_documents(docs, PATH)
    rows = count_tokens(decode_documents(encoded, PATH), PATH).collect()
    assert len(rows) == docs.count()
    for row in rows:
        assert row.decoded == row.text and row.n_tokens == len(row.ids)
        if len(row.ids) < 450:  # the library's 32-bit sums are exact up to here
            assert row.ids == LIBRARY.encode(row.text)


def test_edges(edge_docs, edge_rows, no_docs):
    encoded = encode_documents(edge_docs, PATH)
    assert sorted(encoded.columns) == sorted(edge_docs.columns)
    rows = count_tokens(decode_documents(encoded, PATH), PATH, "text", "n_chars").collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in rows) == sorted((i or 0, t or "") for i, t in edge_rows)
    for row in rows:
        text = row.text or ""
        assert row.decoded == text.replace("▁", " ") and row.n_chars == len(row.ids)
        if len(text) < 1000:
            assert row.ids == LIBRARY.encode(text)
    assert encode_documents(no_docs, PATH).count() == 0 and count_tokens(no_docs, PATH).count() == 0


def test_decoding(spark):
    rows = [([], ""), (None, None), ([260], "<0x"), ([3 + 0xE6, 3 + 0x97, 3 + 0xA5], "日"), ([1, 3 + 0xFF, 2], "�")]
    df = spark.createDataFrame([(ids,) for ids, _ in rows], "ids array<int>")
    found = [r.decoded for r in decode_documents(df, PATH).collect()]
    assert found[0] == "" and found[1] is None and found[3] == "日" and found[4] == "�"
