"""Rendezvous shards against a plain computation of the same draws."""

import math
import struct
import zlib
from collections import Counter, defaultdict

import xxhash
from pyspark.sql import functions as F

from slowtide.llm.sharding import rendezvous, shard_documents, with_slots


def draw(key, shard):
    seed = 42 if key is None else xxhash.xxh64_intdigest(struct.pack("<q", key), 42)
    bits = xxhash.xxh64_intdigest(struct.pack("<i", shard), seed) >> 12
    return (bits + 0.5) / (1 << 52)


def place(key, weights):
    return max(weights, key=lambda s: (math.log(draw(key, s)) / weights[s], -s))


def check(rows, found, shards):
    plain, grown = {i: 1.0 for i in range(shards)}, {i: 1.0 for i in range(shards + 1)}
    expected = Counter()
    for doc_id, text in rows:
        data = (text or "").encode()
        expected[(doc_id, len(data) + 16, zlib.crc32(data), "key", place(doc_id, plain), place(doc_id, grown))] += 1
    assert Counter((r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.grown_shard) for r in found) == expected
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, shards)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_edges(edge_docs, edge_rows, no_docs):
    check(edge_rows, shard_documents(edge_docs, 3).collect(), 3)
    assert shard_documents(no_docs, 3).count() == 0


def test_all_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    found = shard_documents(docs, 40).collect()
    check([tuple(r) for r in docs.collect()], found, 40)
    assert sorted(map(tuple, found)) == sorted(map(tuple, shard_documents(docs.repartition(7), 40).collect()))


def test_weights_share_and_move_only_into_the_heavier(spark):
    keys = spark.range(20_000)
    before, after = {0: 1.0, 1: 2.0, 2: 0.0, 3: 1.0}, {0: 1.0, 1: 4.0, 2: 0.0, 3: 1.0}
    rows = keys.select(rendezvous(F.col("id"), before).alias("a"), rendezvous(F.col("id"), after).alias("b")).collect()
    share = Counter(r.a for r in rows)
    assert abs(share[1] / len(rows) - 0.5) < 0.02 and share[2] == 0
    assert all(r.a == r.b or r.b == 1 for r in rows)


def test_slots_with_many_equal_rows(spark):
    rows = spark.range(3000).select((F.col("id") % 2).alias("shard"), F.lit(7).alias("x"))
    found = with_slots(rows).collect()
    for shard in (0, 1):
        assert sorted(r.slot for r in found if r.shard == shard) == list(range(1500))
