import datetime as dt

import pytest
from pyspark.sql import functions as F

from slowtide.operators import threads
from slowtide.operators.skew import hot_keys, lookup_join, salted_join

SCHEMA = "msg_id long, thread_id long, date timestamp_ntz, is_first_in_thread boolean, category string, author string, msg string"


def message(msg_id, thread_id, first, author, category="PracticeLogs", day=1):
    return (msg_id, thread_id, dt.datetime(2024, 1, day), first, category, author, "x")


@pytest.fixture
def rows(spark):
    return spark.createDataFrame(
        [
            message(1, 1, True, "ann"),
            message(2, 1, False, "bob"),
            message(3, 1, False, "ann", day=3),
            # two first messages: the larger id counts
            message(4, 2, True, "bob"),
            message(5, 2, True, "ann", day=2),
            # a first message of another category still names the author
            message(6, 3, True, "cat", "Other"),
            message(7, 3, False, "cat", day=9),
            message(8, 3, False, None),
        ],
        SCHEMA,
    )


def test_thread_authors(rows):
    found = {r["thread_id"]: r["thread_author"] for r in threads.thread_authors(rows).collect()}
    assert found == {1: "ann", 2: "ann", 3: "cat"}
    strict = threads.thread_authors(rows, strict=True)
    assert {r["thread_id"]: r["thread_author"] for r in strict.collect()} == found


def test_missing_first_message(spark, rows):
    orphan = rows.union(spark.createDataFrame([message(9, 44, False, "dan")], SCHEMA))
    lenient = threads.with_thread_author(orphan, missing="n/a")
    assert {r["msg_id"]: r["thread_author"] for r in lenient.collect()}[9] == "n/a"
    with pytest.raises(Exception, match="no first message in thread 44"):
        threads.with_thread_author(orphan).collect()
    with pytest.raises(Exception, match="no first message in thread 44"):
        threads.practice_logs(orphan, strict=True).collect()
    assert [tuple(r) for r in threads.threads_without_author(orphan).collect()] == [(44, 1)]
    assert threads.practice_logs(orphan).count() == 4


def test_own_messages(rows):
    found = threads.by_thread_author(rows)
    assert found.columns == rows.columns
    assert sorted(r["msg_id"] for r in found.collect()) == [1, 3, 5, 6, 7]
    assert sorted(r["msg_id"] for r in threads.practice_logs(rows, "ann").collect()) == [1, 3, 5]


def test_summary(rows):
    found = {r["author"]: tuple(r)[1:] for r in threads.own_thread_summary(rows).collect()}
    assert found == {
        "ann": (3, dt.date(2024, 1, 1), dt.date(2024, 1, 3)),
        "cat": (1, dt.date(2024, 1, 9), dt.date(2024, 1, 9)),
    }
    assert [r["author"] for r in threads.top_authors(threads.own_thread_summary(rows), k=1).collect()] == ["ann"]


def test_profile(rows):
    assert tuple(threads.collection_profile(rows, "ann").first()) == (8, 7, 3, 3)


@pytest.mark.parametrize("how", ["left", "inner"])
def test_salted_join_equals_plain_join(spark, how):
    facts = spark.range(3000).select(
        "id",
        # a third of the rows on one key, some without a key, some without a partner
        F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 50).alias("k"),
    )
    dim = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    plain = facts.join(dim, "k", how).select("id", "k", "v")
    salted = salted_join(facts, dim, ["k"], ["id"], how, rows_per_salt=100).select("id", "k", "v")
    assert salted.count() == plain.count()
    assert salted.exceptAll(plain).count() == 0
    wide = lookup_join(facts, dim, ["k"], ["id"], dim_bytes=320, how=how, rows_per_salt=100, broadcast_bytes=64)
    assert wide.select("id", "k", "v").exceptAll(plain).count() == 0
    small = lookup_join(facts, dim, ["k"], ["id"], dim_bytes=320, how=how)
    assert small.select("id", "k", "v").exceptAll(plain).count() == 0


def test_salts_spread_a_hot_key(spark):
    counts = spark.createDataFrame([(1, 1000), (2, 10), (3, 350)], "k int, rows long")
    assert {r["k"]: r["__salts"] for r in hot_keys(counts, ["k"], "rows", 100).collect()} == {1: 10, 3: 4}
    # with a bound on the list a salt holds more rows: 1/2 of all here
    assert {r["k"]: r["__salts"] for r in hot_keys(counts, ["k"], "rows", 100, max_hot=2).collect()} == {1: 2}


def test_hot_thread_with_salting(rows):
    plain = threads.with_thread_author(rows).collect()
    salted = threads.with_thread_author(rows, rows_per_salt=1).collect()
    key = lambda r: r["msg_id"]
    pick = lambda rows: [(r["msg_id"], r["thread_author"]) for r in sorted(rows, key=key)]
    assert pick(plain) == pick(salted)
    assert sorted(r["msg_id"] for r in threads.by_thread_author(rows, rows_per_salt=1).collect()) == [1, 3, 5, 6, 7]


def test_sketches_of_distinct_authors_merge(spark):
    rows = spark.range(120_000).select(
        F.concat(F.lit("author "), F.col("id") % 30_000).alias("author"), (F.col("id") % 7).alias("day"), F.lit("c").alias("category")
    )
    rows = rows.unionByName(spark.createDataFrame([(None, 0, "c"), ("x", 1, "few"), ("y", 2, "few"), ("x", 2, "few"), (None, 1, "none")], rows.schema))
    found = [
        {r["category"]: r["num_authors"] for r in threads.distinct_authors(threads.author_sketches(rows.repartition(n), ["category", "day"]), ["category"]).collect()}
        for n in (2, 9)
    ]
    assert found[0] == found[1]
    # five standard errors
    assert abs(found[0]["c"] / 30_000 - 1) < 5 * 1.04 / 2 ** (threads.SKETCH_SIZE / 2)
    assert found[0]["few"] == 2 and found[0]["none"] == 0
