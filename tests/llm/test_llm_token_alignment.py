import hashlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
import tokenizers
from public_tokenizers import path as tokenizer_path

from slowtide.llm import token_alignment
from slowtide.llm.queries import QUERIES
from tests.llm.conftest import make_docs

PATHS = token_alignment.tokenizer_paths()
ODD = [
    "two  spaces   here", " leading", "trailing ", "tab\there\n\n  next", "don't we'll 'tis", "a▁b", "nbsp  x   y", "\x00 nul\x00",
    "<|endoftext|> as text <s> </s> <unk> <0x41>", "日本語 naïve 😀👩‍👩‍👧 é", "x" * 3000, "1234567 8.9 3", "ends\n", "\r\n\r\n", " ", "   ", "  a \x85 b\x1c c",
    "¿qué? ¡sí!", "a \n b", "a\n b \nc",
]


def brute(rows):
    """Rows with both libraries on whole texts and a plain walk over bytes."""
    a_model = tokenizers.Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    a_bytes, b_bytes = token_alignment.byte_tokens(PATHS[0]), token_alignment.piece_tokens(PATHS[1])
    walked = []
    for doc_id, text in rows:
        a = a_model.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_model.encode(text) if text else []
        want = (" " + text).encode() if text else b""
        if b"".join(a_bytes[i] for i in a) != want or b"".join(b_bytes[i] for i in b) != want:
            a, b = [], []
        a_ends, b_ends = np.cumsum([len(a_bytes[i]) for i in a]).tolist(), np.cumsum([len(b_bytes[i]) for i in b]).tolist()
        links = [
            (a[i], b[j])
            for i, ae in enumerate(a_ends)
            for j in range(len(b))
            if max(a_ends[i - 1] if i else 0, b_ends[j - 1] if j else 0) < min(ae, b_ends[j])
        ] if len(a) < 1500 else None
        if links is None:
            links, i, j = [], 0, 0
            while i < len(a):
                links.append((a[i], b[j]))
                i, j = i + (a_ends[i] <= b_ends[j]), j + (b_ends[j] <= a_ends[i])
        number = set(a_ends) & set(b_ends)
        groups = [([], []) for _ in number]
        for side, (ids, ends) in enumerate(((a, a_ends), (b, b_ends))):
            g = 0
            for token, end in zip(ids, ends):
                groups[g][side].append(str(token))
                g += end in number
        groups = [[",".join(own) for own in g] for g in groups]
        walked.append((doc_id, len(a), len(b), len(groups), links, ";".join("|".join(g) for g in groups)))
    counts = Counter(link for row in walked for link in row[4])
    highest = {}
    for (_, b), n in counts.items():
        highest[b] = max(highest.get(b, 0), n)
    return sorted(
        (
            (d, a, b, g, len(links), sum(counts[x] == highest[x[1]] for x in links), sum(counts[x] for x in links),
             hashlib.sha256(text.encode()).hexdigest() if text else "")
            for d, a, b, g, links, text in walked
        ),
        key=repr,
    )


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_byte_tokens_are_the_vocabulary():
    tokens = token_alignment.byte_tokens(PATHS[0])
    assert len(tokens) == 50257 and tokens[50256] == b"" and sorted(map(len, tokens))[1] == 1
    assert len(set(tokens)) == 50257


def test_state_of_many_documents_equals_a_plain_walk():
    draw = np.random.default_rng(1)
    sizes = {"a": [], "b": []}
    first = {"a": [], "b": []}
    for _ in range(200):
        total = int(draw.integers(1, 60))
        for side in "ab":
            cuts = np.unique(np.append(draw.integers(1, total + 1, draw.integers(0, 20)), total))
            first[side].append(len(sizes[side]))
            sizes[side] += np.diff(cuts, prepend=0).tolist()
    a_ends, b_ends = np.cumsum(sizes["a"]), np.cumsum(sizes["b"])
    found = token_alignment.merge_in_lockstep(a_ends, b_ends, np.array(first["a"]), np.array(first["b"]))
    starts = [np.concatenate([[0], e[:-1]]) for e in (a_ends, b_ends)]
    over = np.maximum(starts[0][:, None], starts[1][None]) < np.minimum(a_ends[:, None], b_ends[None])
    assert sorted(zip(found.a.tolist(), found.b.tolist())) == [tuple(x) for x in np.argwhere(over).tolist()]
    assert found.a_cut.tolist() == np.isin(a_ends, b_ends).tolist() and found.b_cut.tolist() == np.isin(b_ends, a_ends).tolist()


def test_edge_documents(spark, edge_docs, edge_rows, no_docs):
    rows = token_alignment.align_tokens(edge_docs.withColumnRenamed("shard", "n_a").withColumnRenamed("node", "block"), *PATHS)
    assert rows.columns == [
        "doc_id", "text", "lang", "source", "n_chars", "ids", "n_lines", "block",
        "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups",
    ]
    digest = [(*r[:1], *r[8:14], hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "") for r in rows.collect()]
    assert sorted(digest, key=repr) == brute(edge_rows)
    assert token_alignment.align_tokens(no_docs, *PATHS).count() == 0


def test_odd_texts(spark, monkeypatch):
    rows = list(enumerate(ODD)) + [(100 + i, f"{x} {y}") for i, (x, y) in enumerate(zip(ODD, ODD[3:]))] + [(1, ODD[1]), (None, "no id")]
    docs = make_docs(spark, rows)
    found = token_alignment.align_tokens(docs.repartition(3), *PATHS, keep=["doc_id"], digest=True)
    assert rows_of(found) == brute(rows)


@pytest.mark.parametrize("blocks", [1, 6])
def test_query_against_both_libraries(spark, sf, tmp_path, blocks):
    texts = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    make_docs(spark, texts).repartition(blocks).write.parquet(f"{tmp_path}/documents.parquet")
    assert rows_of(QUERIES["op13_token_alignment"](spark, str(tmp_path))) == brute(texts)
