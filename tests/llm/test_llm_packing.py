"""Packing: token ids by the tokenizer, places without gaps, dominance against exhaustive search."""

import random
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import public_tokenizers
import tokenizers

from slowtide.llm.packing import best_fit, document_pieces, pack_documents, pack_pieces, placements, reduce_dominated
from slowtide.llm.word_ids import WordEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = tokenizers.Tokenizer.from_file(PATH)


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [0]


def check(rows, found, capacity):
    expected = Counter()
    for doc_id, text in rows:
        ids = ids_of(text)
        for n, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            expected[(doc_id, n, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == expected
    sequences = defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences)


def test_edges(edge_docs, edge_rows, no_docs):
    check(edge_rows, pack_documents(edge_docs, PATH, 32).collect(), 32)
    assert pack_documents(no_docs, PATH).count() == 0


def test_all_documents_near_the_bound(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    found = pack_documents(docs, PATH).collect()
    n = check([tuple(r) for r in docs.collect()], found, 2048)
    assert n <= -(-sum(r.length for r in found) // 2048) + 1


def test_ids_of_pieces(spark):
    docs = spark.createDataFrame([(1, "It's a test!"), (2, None)], "doc_id long, text string")
    rows = document_pieces(docs, PATH, 4, with_ids=True).orderBy("doc_id", "piece").collect()
    assert sum((r.ids for r in rows if r.doc_id == 1), []) == ids_of("It's a test!")
    assert [r.ids for r in rows if r.doc_id == 2] == [[0]]


def test_words_as_the_tokenizer_has_them():
    own, rng = WordEncoder(PATH, remembered=50), random.Random(3)
    letters = "aAbs't rl\nve d'm19 !<|>é\xa0\x85ß日́Σ"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(2000)]
    texts += ["<|endoftext|> x<|startoftext|>y", "12½²3 ÀÉ'S I'M don't 'lla !'s", "a\x1fb\x00c"]
    ids, bounds = own.encode(texts)
    for text, a, b in zip(texts, bounds[:-1], bounds[1:]):
        assert ids[a:b].tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


def fewest(items, capacity):
    items = tuple(sorted(items, reverse=True))

    @cache
    def search(rest):
        if not rest:
            return 0
        best = len(rest)
        first, others = rest[0], rest[1:]
        for mask in range(1 << len(others)):
            chosen = [x for i, x in enumerate(others) if mask >> i & 1]
            if first + sum(chosen) <= capacity:
                best = min(best, 1 + search(tuple(x for i, x in enumerate(others) if not mask >> i & 1)))
        return best

    return search(items)


def test_dominating_sets_keep_an_optimum():
    rng = random.Random(5)
    reduced = 0
    for _ in range(150):
        capacity = rng.choice([10, 12, 17])
        items = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 9))]
        counts = np.bincount(items, minlength=capacity + 1)
        fixed, rest = reduce_dominated(counts)
        for pattern, _ in fixed:
            assert sum(s * c for s, c in pattern) <= capacity
        left = [s for s in range(capacity + 1) for _ in range(rest[s])]
        reduced += len(items) - len(left)
        assert fewest(items, capacity) == sum(n for _, n in fixed) + fewest(left, capacity)
        packed = best_fit(rest)
        together = Counter()
        for pattern, times in fixed + packed:
            for s, c in pattern:
                together[s] += c * times
        assert all(together[s] == counts[s] for s in range(capacity + 1))
    assert reduced > 300


def plain_best_fit(counts):
    """The spaces left by best fit in falling length, one item after the other."""
    capacity, spaces = len(counts) - 1, []
    for s in range(capacity, 0, -1):
        for _ in range(counts[s]):
            fitting = [x for x in spaces if x >= s]
            space = min(fitting) if fitting else capacity
            if fitting:
                spaces.remove(space)
            spaces.append(space - s)
    return sorted(spaces)


def test_best_fit_many_at_a_time_equals_one_by_one():
    rng = random.Random(6)
    for _ in range(100):
        capacity = rng.choice([12, 30, 50])
        counts = np.bincount([rng.randrange(1, capacity + 1) for _ in range(rng.randrange(60))], minlength=capacity + 1)
        left = [capacity - sum(s * c for s, c in p) for p, times in best_fit(counts) for _ in range(times)]
        assert sorted(left) == plain_best_fit(counts)


def test_equal_pieces_get_different_places(spark):
    rows = spark.createDataFrame([(1, 5)] * 100, "doc_id long, length long")
    found = pack_pieces(rows, 12).collect()
    assert len({(r.sequence_id, r.offset) for r in found}) == 100 and len({r.sequence_id for r in found}) == 50
    assert placements([]) == []
