import datetime as dt
import json
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from slowtide.functions.text import parse_timestamp
from slowtide.session import checked_shared, fresh_path, shared_dir, write_once
from slowtide.sources import messages as S
from slowtide.sources import score_table, testbed
from slowtide.sources.score_table import CommitLog, ScoreTable, VectorTable

ROW = {
    "msg_id": 1, "thread_id": 7, "date": "2024-02-03T04:05:06.789", "is_first_in_thread": True,
    "category": "PracticeLogs", "author": "Linda ”P” Ö", "title": "t", "msg": "Hi.",
}


def write_lines(spark, lines):
    path = fresh_path(spark, "lines")
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    return path


def test_blank_lines_are_skipped_and_dates_parsed(spark):
    path = write_lines(spark, [json.dumps(ROW), "", "   ", json.dumps(ROW | {"msg_id": 2, "msg": None})])
    rows = S.read_messages(spark, path).orderBy("msg_id").collect()
    assert [r["msg_id"] for r in rows] == [1, 2]
    assert rows[0]["date"] == dt.datetime(2024, 2, 3, 4, 5, 6, 789000)
    assert rows[0]["author"] == ROW["author"] and rows[1]["msg"] is None


def test_unreadable_date(spark):
    path = write_lines(spark, [json.dumps(ROW | {"date": "yesterday"})])
    assert S.read_messages(spark, path, strict_dates=False).first()["date"] is None
    with pytest.raises(Exception, match="unreadable date: yesterday"):
        S.read_messages(spark, path).collect()


def test_malformed_line_is_an_error(spark):
    path = write_lines(spark, ['{"msg_id": '])
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        S.read_messages(spark, path).collect()


def test_typed_reader_names_and_default(spark):
    path = write_lines(spark, [json.dumps(ROW), json.dumps(ROW | {"msg_id": 5, "thread_id": 8, "is_first_in_thread": False})])
    found = S.read_typed_messages(spark, path)
    assert set(found.columns) == {
        "msgId", "threadId", "date", "isFirstInThread", "category", "author", "title", "msg", "threadAuthor",
    }
    assert {r["msgId"]: r["threadAuthor"] for r in found.collect()} == {1: ROW["author"], 5: "n/a"}


def test_round_trip(spark, sf):
    rows = testbed.messages(spark, sf)
    path = fresh_path(spark, "messages")
    S.write_messages(rows, path)
    back = S.read_messages(spark, path).select(*rows.columns)
    assert back.exceptAll(rows).count() == 0 and rows.exceptAll(back).count() == 0


def test_round_trip_in_a_zone_with_summer_time(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        row = ROW | {"date": "2024-03-10T02:30:00.25"}
        read = S.read_messages(spark, write_lines(spark, [json.dumps(row)]))
        path = fresh_path(spark, "messages")
        S.write_messages(read, path)
        assert S.read_messages(spark, path).select(F.col("date").cast("string")).first()[0] == "2024-03-10 02:30:00.25"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_unused_columns_are_not_read(spark):
    path = write_lines(spark, [json.dumps(ROW)])
    plan = S.read_messages(spark, path).groupBy("author").count()._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<author:string>" in plan


def test_dates_do_not_depend_on_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        row = spark.createDataFrame([("2024-03-10 02:30:00",)], "t string").select(parse_timestamp(F.col("t")).cast("string"))
        assert row.first()[0] == "2024-03-10 02:30:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_write_once_keeps_rows_in_shared_folder(spark):
    kept = write_once(spark.range(10), "r")
    assert kept.count() == 10 and shared_dir(spark) in kept.inputFiles()[0]


def test_score_table(spark):
    table = ScoreTable(spark, fresh_path(spark, "scores"))
    assert table.latest("m", ["a"]).count() == 0
    rows = spark.createDataFrame([(b"k1", "a", 0.25), (b"k2", "b", 0.5)], "text_key binary, label string, score float")
    assert table.append(rows, "m", "1") == 2
    assert table.append(rows.where("label = 'a'").withColumn("score", F.lit(0.75).cast("float")), "m", "2") == 1
    assert table.append(rows, "other", "3") == 2
    found = {(r["label"], bytes(r["text_key"])): r["score"] for r in table.latest("m", ["a", "b"]).collect()}
    assert found == {("a", b"k1"): 0.75, ("b", b"k2"): 0.5}
    assert table.latest("m", ["a"]).count() == 1


def scanned(df) -> int:
    """Rows that the scans of an executed query passed on, after pages were skipped."""
    plan = df._jdf.queryExecution().executedPlan()
    plan.executeCollect()
    leaves = (plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan).collectLeaves()
    return sum(leaves.apply(i).metrics().get("numOutputRows").get().value() for i in range(leaves.size()))


def test_score_table_opens_one_models_files(spark):
    table = ScoreTable(spark, fresh_path(spark, "scores"))
    rows = spark.createDataFrame([(b"k1", "a", 0.25), (b"k2", "b", 0.5)], "text_key binary, label string, score float")
    table.append(rows, "m", "1")
    table.append(rows, "other", "1")
    assert len(table.read().inputFiles()) == len(table.read("m").inputFiles()) + len(table.read("other").inputFiles())
    assert table.read("none").count() == 0 and table.latest("m", ["a"]).count() == 1


def test_few_texts_are_probed_in_few_pages(spark, monkeypatch):
    """A probe of a large table passes on some pages; of many texts it becomes a join with the same rows."""
    table = ScoreTable(spark, fresh_path(spark, "scores"))
    texts = spark.range(60_000).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("text_key"), "id")
    stored = texts.repartitionByRange(16, "text_key").select(
        "text_key", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("label"), F.lit(0.5).cast("float").alias("score")
    )
    assert table.append(stored, "m", "1") == 120_000
    few = texts.where("id in (5, 77, 41234)").select("text_key").unionByName(spark.createDataFrame([(b"unknown",)], "text_key binary"))
    found = table.entries("m", ["a"], few)
    assert found.count() == 3 and scanned(found) < 120_000 / 5
    monkeypatch.setattr(score_table, "PROBE_TEXTS", 2)
    joined = table.entries("m", ["a"], few)
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, found.collect()))
    assert table.entries("m", ["a"], few.limit(0)).count() == 0


def one_score(spark, key, score):
    return spark.createDataFrame([(key, "a", float(score))], "text_key binary, label string, score float")


def test_an_append_reads_no_stored_rows(spark):
    table = ScoreTable(spark, fresh_path(spark, "scores"))
    table.append(one_score(spark, b"k", 1), "m", "1")
    table.log.drop("../data")
    assert table.append(one_score(spark, b"k2", 2), "m", "2") == 1


def test_writers_at_the_same_time_lose_nothing(spark):
    path = fresh_path(spark, "scores")

    def write(writer: int) -> None:
        table = ScoreTable(spark, path)
        for i in range(6):
            table.append(one_score(spark, f"{writer}-{i}".encode(), writer).unionByName(one_score(spark, b"shared", writer)), f"m{writer % 2}", "r")

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(write, range(4)))
    table = ScoreTable(spark, path)
    numbers = [r["seq"] for r in table.read().select("seq").distinct().collect()]
    for parity in (0, 1):
        found = {bytes(r["text_key"]).decode(): r["score"] for r in table.latest(f"m{parity}", ["a"]).collect()}
        assert found.keys() == {f"{w}-{i}" for w in (parity, parity + 2) for i in range(6)} | {"shared"}
        assert all(found[k] == float(k.split("-")[0]) for k in found if k != "shared") and found["shared"] in (parity, parity + 2)
    assert len(numbers) <= 24 and len(set(numbers)) == len(numbers)


def test_numbers_are_claimed_once(spark):
    logs = [CommitLog(spark, fresh_path(spark, "log"))] * 2
    with ThreadPoolExecutor(8) as pool:
        numbers = list(pool.map(lambda i: logs[i % 2].claim(), range(40)))
    assert sorted(numbers) == list(range(1, 41))
    assert logs[0].live() == {} and logs[0].lease(3) and not logs[1].lease(3)
    logs[0].commit(2, {"folder": "x"})
    with pytest.raises(FileExistsError):
        logs[1].commit(2, {"folder": "y"})
    assert CommitLog(spark, logs[0].path).live() == {2: {"folder": "x"}}


def test_half_written_appends_are_not_seen(spark, monkeypatch):
    table = ScoreTable(spark, fresh_path(spark, "scores"))
    table.append(one_score(spark, b"k", 1), "m", "1")
    monkeypatch.setattr(table.log, "commit", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        table.append(one_score(spark, b"k", 2), "m", "2")
    other = ScoreTable(spark, table.path)
    assert [r["score"] for r in other.latest("m", ["a"]).collect()] == [1.0]
    other.append(one_score(spark, b"k", 3), "m", "3")
    assert [r["score"] for r in other.latest("m", ["a"]).collect()] == [3.0]


def test_appends_are_merged(spark, monkeypatch):
    monkeypatch.setattr(score_table, "MAX_APPENDS", 3)
    table = ScoreTable(spark, fresh_path(spark, "scores"))
    table.append(one_score(spark, b"x", 9), "other", "1")
    for i in range(14):
        table.append(one_score(spark, b"k", i).unionByName(one_score(spark, f"k{i}".encode(), i)), "m", str(i))
        assert sum(e["model"] == "m" for e in table.log.live().values()) <= 3
        found = {bytes(r["text_key"]): r["score"] for r in table.latest("m", ["a"]).collect()}
        assert found == {b"k": i} | {f"k{j}".encode(): j for j in range(i + 1)}
    files = len(table.read("m").inputFiles())
    assert files <= 3 * 4
    assert table.vacuum() > 0 and len(table.read("m").inputFiles()) == files
    assert {bytes(r["text_key"]): r["score"] for r in table.latest("m", ["a"]).collect()} == found
    assert table.latest("other", ["a"]).count() == 1


def test_only_shared_folders_are_used():
    for folder, master in (("s3a://x/w", "spark://m:7077"), ("file:/x", "local[4]"), ("/x", "local")):
        assert checked_shared(folder, master) == folder
    for folder, master in (("file:/x", "spark://m:7077"), ("/x", "local-cluster[2,1,1024]")):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            checked_shared(folder, master)


def test_vector_table(spark):
    table = VectorTable(spark, fresh_path(spark, "vectors"))
    rows = spark.createDataFrame([(b"k", [1.0, 2.0])], "text_key binary, embedding array<float>")
    table.append(rows, "m", "1")
    table.append(rows.withColumn("embedding", F.array(F.lit(3.0).cast("float"))), "m", "2")
    assert table.latest("m").first()["embedding"] == [3.0]
