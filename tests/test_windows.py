import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from slowtide.operators.ordered import (
    consecutive_differences,
    dimension_slowness,
    dimension_variance,
    first_rows,
    row_index,
    with_previous,
)
from slowtide.operators.windows import Span, join_texts, pool_windows, time_scale_means

D = dt.datetime
SCHEMA = "msg_id long, series string, date timestamp_ntz, msg string, embedding array<float>"


@pytest.fixture
def rows(spark):
    return spark.createDataFrame(
        [
            (1, "a", D(2024, 1, 3, 9), "one", [1.0, 2.0]),
            (2, "a", D(2024, 1, 3, 23, 59, 59), "two", [3.0, 4.0]),
            (3, "a", D(2024, 1, 6), None, None),
            (4, "a", D(2024, 1, 9), "four", [5.0, 0.0]),
            (5, "b", D(2024, 1, 8, 1), "five", [7.0, 7.0]),
            (6, "b", D(2024, 1, 8, 1), "six", [9.0, 9.0]),
        ],
        SCHEMA,
    )


def table(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_tumbling(rows):
    found = table(pool_windows(rows, "1d"), "series", "window_start", "n", "embedding")
    assert found == [
        ("a", D(2024, 1, 3), 2, [2.0, 3.0]),
        ("a", D(2024, 1, 9), 1, [5.0, 0.0]),
        ("b", D(2024, 1, 8), 2, [8.0, 8.0]),
    ]


def test_weeks_start_on_monday(rows):
    assert table(pool_windows(rows, "1w"), "series", "window_start", "n") == [
        ("a", D(2024, 1, 1), 2), ("a", D(2024, 1, 8), 1), ("b", D(2024, 1, 8), 2),
    ]


def test_seven_days_are_aligned_to_the_epoch(rows):
    # 1970-01-01 was a Thursday, and so is every seventh day from there
    assert {r["window_start"].weekday() for r in pool_windows(rows, "7d").collect()} == {3}


def test_sliding_windows_open_on_first_day_of_the_series(rows):
    found = table(pool_windows(rows, "1d", "1w"), "series", "window_start", "n")
    a = [(s, w, n) for s, w, n in found if s == "a"]
    assert a[0] == ("a", D(2024, 1, 3), 3) and a[-1] == ("a", D(2024, 1, 9), 1)
    assert len(a) == 7
    assert [x for x in found if x[0] == "b"] == [("b", D(2024, 1, 8), 2)]


@pytest.mark.parametrize("every, period", [("1d", "3d"), ("2d", "5d"), ("1d", "36h"), ("12h", "2d"), ("1w", "2w")])
def test_sliding_equals_brute_force(spark, every, period):
    rng = np.random.default_rng(5)
    step, length = Span(every), Span(period)
    start = D(2024, 2, 26)  # a month change and a leap day
    data = [(i, "ab"[i % 2], start + dt.timedelta(minutes=int(m)), [float(v)]) for i, (m, v) in enumerate(zip(rng.integers(0, 15000, 60), rng.integers(0, 9, 60)))]
    rows = spark.createDataFrame(data, "msg_id long, series string, date timestamp_ntz, embedding array<float>")
    epoch = D(1970, 1, 1) + step.offset
    expected = {}
    for s in "ab":
        own = [(t, v[0]) for _, x, t, v in data if x == s]
        floor = lambda t: epoch + (t - epoch) // step.length * step.length
        at, last = floor(min(t for t, _ in own)), max(t for t, _ in own)
        while at <= last:
            inside = [v for t, v in own if at <= t < at + length.length]
            if inside:
                expected[(s, at)] = (len(inside), pytest.approx(np.mean(inside), abs=1e-5))
            at += step.length
    found = {(r["series"], r["window_start"]): (r["n"], r["embedding"][0]) for r in pool_windows(rows, every, period).collect()}
    assert found == expected
    alone = pool_windows(rows, every, period, series=[]).collect()
    assert sum(r["n"] for r in alone) >= sum(n for n, _ in expected.values())


def test_partitions_do_not_matter(rows):
    grids = [table(pool_windows(rows.repartition(n), "1d", "1w"), "series", "window_start", "n", "embedding") for n in (1, 16)]
    assert grids[0] == grids[1]


def test_bad_durations():
    for text in ("1mo", "0d", "d", "1 d"):
        with pytest.raises(ValueError):
            Span(text)


def test_texts(rows):
    assert table(join_texts(rows, "1w"), "series", "window_start", "part", "msg") == [
        ("a", D(2024, 1, 1), 0, "one two"), ("a", D(2024, 1, 8), 0, "four"), ("b", D(2024, 1, 8), 0, "five six"),
    ]
    sliding = {(r["series"], r["window_start"].day): r["msg"] for r in join_texts(rows, "1d", "1w").collect()}
    assert sliding[("a", 3)] == "one two four" and sliding[("a", 4)] == "four"
    assert min(k for k in sliding) == ("a", 3)


@pytest.mark.parametrize("period", [None, "3d"])
def test_oversize_texts_come_in_parts(spark, period):
    rows = spark.range(400).select(
        F.col("id").alias("msg_id"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 5 > 0, F.concat(F.lit("s"), F.col("id") % 5)).alias("series"),
        F.expr("timestamp_ntz '2024-01-01' + (id % 40) * interval '3' hour").alias("date"),
        F.concat(F.lit("m"), F.col("id")).alias("msg"),
    )
    whole = {(r["series"], r["window_start"]): r["msg"] for r in join_texts(rows, "1d", period).collect()}
    parts = join_texts(rows, "1d", period, max_bytes=60).collect()
    assert len(parts) > len(whole)
    pieces = {}
    for r in sorted(parts, key=lambda r: r["part"]):
        pieces.setdefault((r["series"], r["window_start"]), []).append(r["msg"])
    assert {k: " ".join(v) for k, v in pieces.items()} == whole
    assert any(series is None for series, _ in whole)
    # a window's parts depend on its own texts alone
    alone = join_texts(rows.where("series = 's1'"), "1d", period, max_bytes=60).collect()
    assert sorted(map(tuple, alone)) == sorted(tuple(r) for r in parts if r["series"] == "s1")


def test_time_scales_equal_single_grids(rows):
    found = time_scale_means(rows, 5).collect()
    for days in range(1, 6):
        single = pool_windows(rows, f"{days}d").collect()
        expected = {(r["series"], (r["window_start"] - D(1970, 1, 1)).days): (r["n"], r["embedding"]) for r in single}
        assert {(r["series"], r["window_start"]): (r["n"], r["embedding"]) for r in found if r["days"] == days} == expected


def series_rows(spark, n=300):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(n, 3))
    names = ["hot" if i % 3 else "rest" if i % 2 else None for i in range(n)]
    # equal dates: the id breaks ties
    data = [(i, names[i], D(2024, 1, 1) + dt.timedelta(hours=i // 4), [float(v) for v in x[i]]) for i in range(n)]
    shuffled = [data[i] for i in rng.permutation(n)]
    return spark.createDataFrame(shuffled, "row_id long, series string, date timestamp_ntz, embedding array<double>"), names, x


@pytest.mark.parametrize("max_rows", [5_000_000, 10])
def test_differences(spark, max_rows):
    rows, names, x = series_rows(spark)
    found = consecutive_differences(rows, ["date", "row_id"], max_series_rows=max_rows).collect()
    assert len(found) == len(names)
    for s in ("hot", "rest", None):
        ids = [i for i, name in enumerate(names) if name == s]
        diffs = {r["row_id"]: r["diff"] for r in found if r["series"] == s}
        assert diffs[ids[0]] is None
        for before, at in zip(ids, ids[1:]):
            assert diffs[at] == pytest.approx(list(x[at] - x[before]))


def test_previous_value_over_runs(spark):
    rows = spark.range(200).select(F.lit("s").alias("series"), "id", (F.col("id") * 2).alias("v"))
    found = with_previous(rows, {"p": "v"}, ["id"], max_series_rows=7).orderBy("id").collect()
    assert [r["p"] for r in found] == [None] + [2 * i for i in range(199)]


def test_row_index(spark):
    rows, names, _ = series_rows(spark)
    found = row_index(rows, ["date", "row_id"], max_run_rows=20).collect()
    for s in ("hot", "rest", None):
        ids = [i for i, name in enumerate(names) if name == s]
        assert {r["row_id"]: (r["idx"], r["n"]) for r in found if r["series"] == s} == {i: (at, len(ids)) for at, i in enumerate(ids)}


def test_dimension_statistics(spark):
    rows, names, x = series_rows(spark)
    diffs = consecutive_differences(rows, ["date", "row_id"])
    deltas = {(r["series"], r["dim"]): r["delta"] for r in dimension_slowness(diffs).collect()}
    variances = {(r["series"], r["dim"]): r["variance"] for r in dimension_variance(rows).collect()}
    for s in ("hot", "rest", None):
        own = x[[i for i, name in enumerate(names) if name == s]]
        for j in range(3):
            assert deltas[(s, j)] == pytest.approx(np.diff(own[:, j]).var(ddof=1) / own[:, j].var(ddof=1))
            assert variances[(s, j)] == pytest.approx(own[:, j].var())


def test_constant_dimension_has_no_slowness(spark):
    rows = spark.createDataFrame([("s", i, [1.0, float(i)]) for i in range(4)], "series string, i int, embedding array<double>")
    found = dimension_slowness(consecutive_differences(rows, ["i"])).orderBy("dim").collect()
    assert found[0]["delta"] is None and found[1]["delta"] == 0.0


def test_first_rows(spark):
    rows = spark.range(50).select((F.col("id") % 3).alias("series"), "id")
    found = first_rows(rows, 4, ["id"])
    assert table(found, "series", "id") == sorted((i % 3, i) for i in range(12))
    assert "WindowGroupLimit" in found._jdf.queryExecution().executedPlan().toString()


def test_a_vector_of_another_length_names_its_row(spark):
    rows = spark.createDataFrame(
        [("s", D(2024, 1, 1), [1.0, 2.0]), ("s", D(2024, 1, 2), [1.0])], "series string, date timestamp_ntz, embedding array<float>"
    )
    with pytest.raises(Exception, match="not 2 in row s 2024-01-02"):
        pool_windows(rows, "1d", dims=2).collect()


@pytest.mark.parametrize("broadcast_bytes", [-1, 1 << 20])
@pytest.mark.parametrize("series", [[], ["series"]])
def test_no_task_holds_the_windows_of_a_series(spark, monkeypatch, broadcast_bytes, series):
    from functools import partial

    from slowtide.operators import ordered, windows

    monkeypatch.setattr(windows, "lookup_join", partial(windows.lookup_join, broadcast_bytes=broadcast_bytes, rows_per_salt=7))
    monkeypatch.setattr(ordered, "RUN_ROWS", 10)
    runs, sorted_runs = [], ordered.sorted_runs
    monkeypatch.setattr(ordered, "sorted_runs", lambda df, order, n: runs.append(n) or sorted_runs(df, order, n))
    data = [(i, [None, "a", "a", "a", "b"][i % 5], D(2024, 1, 1) + dt.timedelta(hours=13 * i), f"t{i}", [float(i)]) for i in range(60)]
    rows = spark.createDataFrame(data, SCHEMA)
    texts, sums = {}, {}
    for name in {r[1] if series else None for r in data}:
        own = [r for r in data if not series or r[1] == name]
        first = min(r[2] for r in own).replace(hour=0)
        for i, _, date, msg, (v,) in own:
            for back in range(3):
                start = date.replace(hour=0) - dt.timedelta(days=back)
                if start >= first:
                    texts.setdefault((name, start), []).append(msg)
                    sums.setdefault((name, start), []).append(v)
    joined = join_texts(rows, "1d", "3d", series=series)
    name = lambda r: r["series"] if series else None
    assert {(name(r), r["window_start"]): r["msg"] for r in joined.collect()} == {k: " ".join(v) for k, v in texts.items()}
    pooled = pool_windows(rows, "1d", "3d", series=series)
    assert {(name(r), r["window_start"]): (r["n"], r["embedding"][0]) for r in pooled.collect()} == {
        k: (len(v), pytest.approx(sum(v) / len(v))) for k, v in sums.items()
    }
    # sorted in several runs, and no window function over a whole series
    assert runs and min(runs) > 1
    plan = (joined._jdf.queryExecution().optimizedPlan().toString() + pooled._jdf.queryExecution().optimizedPlan().toString()).splitlines()
    assert not any("Window [min(" in line for line in plan)
