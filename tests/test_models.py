import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from slowtide.functions.spectra import retained_count, slow_directions, slowest
from slowtide.functions.vectors import vector_mean
from slowtide.operators import labels as L
from slowtide.operators.extremes import extreme_rows
from slowtide.operators.models import apply_model, fit_pca, fit_sfa, fit_windowed_sfa, series_moments
from slowtide.operators.moments import Partial, _moment_schema, _partial_moments, covariance_entries, moments, plain_arrow_schema
from slowtide.operators.slowness import label_gains, label_orders, mean_label_gains, prefix_gains, slowness, slowness_by_time_scale
from slowtide.operators import smoothing
from slowtide.operators.smoothing import AMPLITUDES, Sums, Waves, best_fit, likelihoods, posterior_at, smooth
from slowtide.operators.spectrum import amplitude_spectrum
from slowtide.session import write_once


def series_frame(spark, **arrays):
    """One row per array row; series by keyword."""
    data = [(name, i, [float(v) for v in row]) for name, x in arrays.items() for i, row in enumerate(x)]
    return spark.createDataFrame(data, "series string, window_start int, embedding array<double>")


def walk(rng, n, d):
    return np.cumsum(rng.normal(size=(n, d)), axis=0) @ rng.normal(size=(d, d)) + 100


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    return {"slow": walk(rng, 200, 5), "noise": rng.normal(size=(150, 3)) + 1e6, "short": rng.normal(size=(3, 5))}


@pytest.fixture(scope="module")
def rows(spark, data):
    return series_frame(spark, **data).repartition(7)


def matrices(df, kind="x"):
    found = {}
    for r in covariance_entries(df).where(F.col("kind") == kind).collect():
        found.setdefault(r["series"], {})[(r["i"], r["j"])] = r["covariance"]
    return {s: np.array([[m[(i, j)] for j in range(int(len(m) ** 0.5))] for i in range(int(len(m) ** 0.5))]) for s, m in found.items()}


@pytest.mark.parametrize("partitions", [1, 16])
def test_moments(spark, data, rows, partitions):
    found = series_moments(rows.repartition(partitions), bounded=True)
    for kind, f in (("x", lambda x: x), ("dx", lambda x: np.diff(x, axis=0))):
        by_series = matrices(found, kind)
        for name, x in data.items():
            assert np.allclose(by_series[name], np.cov(f(x).T), rtol=1e-9, atol=1e-9)
    means = {r["series"]: r["mean"] for r in found.where("kind = 'x' and i = 0").collect()}
    assert np.allclose(means["noise"], data["noise"].mean(axis=0), rtol=1e-14)


def test_large_matrices_merge_in_blocks(spark):
    x = np.random.default_rng(0).normal(size=(120, 150))
    found = moments(series_frame(spark, s=x).repartition(5))
    assert np.allclose(matrices(found)["s"], np.cov(x.T))
    assert sorted(r["i"] for r in found.collect()) == list(range(150))


def test_full_tasks_emit_partials_early(spark, data, rows, monkeypatch):
    from slowtide.operators import moments as module

    monkeypatch.setattr(module, "HELD_BYTES", 1)
    monkeypatch.setattr(module, "SENT_BYTES", 1)
    assert np.allclose(matrices(moments(rows))["slow"], np.cov(data["slow"].T))


def test_moments_reject_uneven_vectors(spark):
    rows = spark.createDataFrame([("s", [1.0]), ("s", [1.0, 2.0])], "series string, embedding array<double>")
    for n in (1, 2):
        with pytest.raises(Exception, match="different length"):
            moments(rows.repartition(n)).collect()


def test_merge_is_exact_for_constant_data():
    partial = Partial()
    for _ in range(2):
        partial.add_moments(10, np.full(2, 1e9), np.zeros((2, 2)))
    assert (partial.scatter == 0).all() and partial.n == 20


def test_moments_reject_null_entries(spark):
    rows = spark.createDataFrame([("s", [1.0, None]), ("s", [3.0, 4.0])], "series string, embedding array<double>")
    for job in (lambda: moments(rows), lambda: rows.groupBy("series").agg(vector_mean(F.col("embedding")))):
        with pytest.raises(Exception, match="null entry"):
            job().collect()


def test_many_series_of_few_rows_send_rows(spark):
    """What is shuffled stays near the size of the vectors; every series spread over all tasks."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(60, 8, 64))
    data = [(s, [float(v) for v in row]) for s in range(60) for row in x[s]]
    rows = spark.createDataFrame(data, "series int, embedding array<double>").repartition(12)
    partials = rows.mapInArrow(_partial_moments(["series"], ["x"], plain_arrow_schema(_moment_schema(rows, ["series"]))), _moment_schema(rows, ["series"]))
    assert partials.agg(F.sum(F.size("mean") + F.size("covariance"))).first()[0] == 60 * 8 * 64
    found = matrices(moments(rows))
    assert all(np.allclose(found[s], np.cov(x[s].T)) for s in range(60))


def test_one_series_over_many_tasks(spark):
    x = np.random.default_rng(10).normal(size=(900, 3)) + 1e6
    rows = spark.createDataFrame([("s", [float(v) for v in row]) for row in x], "series string, embedding array<double>")
    assert np.allclose(matrices(moments(rows.repartition(40)))["s"], np.cov(x.T))


@pytest.mark.parametrize("keep, kept", [(2, 2), (None, 4), (0.5, 1), (0.9, 3), (0.8, 3), (9, 4)])
def test_retained_count(keep, kept):
    assert retained_count(np.array([6.0, 2.0, 1.5, 0.5]), keep, 100) == kept


def test_retained_count_is_bounded_by_rows():
    assert retained_count(np.array([1.0, 1.0, 1.0]), None, 2) == 2


def test_pca_invariants(spark, data, rows):
    models = {r["series"]: r for r in fit_pca(moments(rows), 0.99).collect()}
    for name, x in data.items():
        r = models[name]
        parts = np.array(r["components"])
        assert np.allclose(parts @ parts.T, np.eye(len(parts)), atol=1e-8)
        assert (np.diff(r["variances"]) <= 0).all() and sum(r["ratios"]) == pytest.approx(1)
        assert len(parts) == r["n_retained"]
        assert r["n_retained"] == min(np.searchsorted(np.cumsum(r["ratios"]), 0.99, side="right") + 1, len(x), x.shape[1])
        _, _, reference = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
        assert np.allclose(np.abs(np.sum(parts * reference[: len(parts)], axis=1)), 1, atol=1e-4)
        lead = np.abs(parts).argmax(axis=1)
        assert (parts[np.arange(len(parts)), lead] > 0).all()


def test_sfa_invariants(spark, data, rows):
    models = write_once(fit_sfa(series_moments(rows), 3), "sfa")
    applied = apply_model(rows, models, ["window_start"], target="SFA", split=3)
    deltas = {r["series"]: np.array(r["deltas"]) for r in models.collect()}
    for name in ("slow", "noise"):
        y = np.array([[r["SFA_0"], r["SFA_1"], r["SFA_2"]] for r in applied.where(F.col("series") == name).orderBy("window_start").collect()])
        assert np.allclose(y.mean(axis=0), 0, atol=1e-6)
        assert np.allclose(np.cov(y.T), np.eye(3), atol=1e-5)
        assert (np.diff(deltas[name]) >= 0).all()
        assert np.allclose(np.diff(y, axis=0).var(axis=0, ddof=1), deltas[name], atol=1e-5)
    # three rows span two directions: the third feature is zero
    assert deltas["short"][2] == 0
    assert {r["SFA_2"] for r in applied.where("series = 'short'").collect()} == {0.0}


def test_models_too_large_to_broadcast_are_joined(spark, rows, monkeypatch):
    from slowtide.operators import models as module
    from slowtide.operators.skew import salted_join

    fitted = write_once(fit_pca(moments(rows), 2), "pca")
    small = apply_model(rows, fitted, ["window_start"], target="P", split=2)
    monkeypatch.setattr(
        module, "lookup_join", lambda f, d, k, s, dim_bytes: salted_join(f, d, k, s, "inner", rows_per_salt=20)
    )
    large = apply_model(rows, fitted, ["window_start"], target="P", split=2)
    pick = lambda df: sorted((r["series"], r["window_start"], r["P_0"], r["P_1"]) for r in df.collect())
    assert pick(small) == pick(large) and len(pick(small)) == rows.count()


def test_wide_models_multiply_batches(spark, monkeypatch):
    from slowtide.operators import models as module

    rng = np.random.default_rng(5)
    x = {"a": rng.normal(size=(40, 90)), "b": rng.normal(size=(30, 70)), None: rng.normal(size=(3, 90))}
    data = [(s, i, f"t{i}", [float(v) for v in row]) for s, rows in x.items() for i, row in enumerate(rows)] + [("a", 99, "none", None), ("c", 0, "", [1.0])]
    rows = spark.createDataFrame(data, "series string, window_start int, msg string, embedding array<double>").repartition(4)
    fitted = write_once(fit_pca(moments(rows.where("series in ('a', 'b') and embedding is not null")), 60), "pca")
    pick = lambda df: {(r["series"], r["window_start"], r["msg"]): r for r in df.collect()}
    found = {}
    for wide in (1, 1 << 40):
        monkeypatch.setattr(module, "WIDE", wide)
        whole, split = apply_model(rows, fitted, ["window_start"]), apply_model(rows, fitted, ["window_start"], target="P", split=2)
        assert whole.columns == rows.columns and split.columns == [*rows.columns, "P_0", "P_1"]
        assert ("MapInArrow" in split._jdf.queryExecution().executedPlan().toString()) == (wide == 1)
        found[wide] = pick(whole), pick(split)
    for one, other in zip(found[1], found[1 << 40]):
        assert one.keys() == other.keys() and len(one) == 71
    for key, row in found[1][0].items():
        want = found[1 << 40][0][key]["embedding"]
        assert row["embedding"] == want if key[2] == "none" else np.allclose(row["embedding"], want, atol=1e-9)
        a, b = found[1][1][key], found[1 << 40][1][key]
        assert (a["P_0"] is None and b["P_0"] is None) or np.allclose([a["P_0"], a["P_1"]], [b["P_0"], b["P_1"]], atol=1e-9)


def test_slowness_survives_linear_maps(spark, data):
    x = data["slow"]
    turned = x @ np.random.default_rng(9).normal(size=(5, 5))
    found = {r["series"]: r["delta"] for r in slowness(series_frame(spark, a=x, b=turned), 3, keep=None).collect()}
    assert found["a"] == pytest.approx(found["b"], rel=1e-6)


def test_white_noise_anchors(spark):
    one = np.random.default_rng(0).standard_normal(size=(1000, 1))
    two = np.random.default_rng(0).standard_normal(size=(1000, 2))
    assert slowness(series_frame(spark, s=one)).first()["delta"] == pytest.approx(2.0, abs=0.1)
    assert slowness(series_frame(spark, s=two), dims=2).first()["delta"] == pytest.approx(4.0, abs=0.1)


def test_constant_series(spark):
    rows = series_frame(spark, flat=np.ones((20, 2)))
    r = fit_sfa(series_moments(rows), 2).first()
    assert r["n_nontrivial"] == 0 and r["deltas"] == [0.0, 0.0] and r["components"] == [[0.0, 0.0]] * 2
    assert slowness(rows).first()["delta"] is None


def test_series_without_variance_retain_nothing(spark):
    rng = np.random.default_rng(4)
    line = rng.normal(size=(30, 1)) @ np.ones((1, 3))
    rows = series_frame(spark, one=np.ones((1, 3)), flat=np.full((5, 3), 0.3), line=line, two=rng.normal(size=(2, 3)))
    for keep in (2, 0.99, None):
        models = write_once(fit_pca(moments(rows), keep), "pca")
        found = {r["series"]: r for r in models.collect()}
        assert {s: r["n_retained"] for s, r in found.items()} == {"one": 0, "flat": 0, "line": 1, "two": 1}
        assert found["one"]["ratios"] == found["flat"]["ratios"] == [0.0, 0.0, 0.0]
        assert {len(r["components"]) for r in found.values()} == ({2} if keep == 2 else {0, 1})
        shares = L.explained_variance(models).collect()
        assert len(shares) == 12 and all(r["ratio"] == 0 and not r["retained"] for r in shares if r["series"] in ("one", "flat"))
        kept = {(r["series"], r["component"]) for r in L.weights(models).collect()}
        assert kept == {("line", 0), ("two", 0)}
        ratios = L.component_values(models, "ratios", "ratio")
        assert {r["series"] for r in L.importance(L.weights(models), ratios).collect()} == {"line", "two"}
    applied = apply_model(rows, write_once(fit_pca(moments(rows), 2), "pca"), ["window_start"], target="P").collect()
    assert all(len(r["P"]) == 2 and (r["series"] in ("line", "two") or not any(r["P"])) for r in applied)


@pytest.mark.parametrize("n", [1, 2, 3, 30, 63, 64, 65, 99, 100, 101, 150])
def test_fits_from_rows_equal_fits_from_matrices(spark, n):
    """Windowed series with fewer rows than dimensions, as many, and more."""
    rng = np.random.default_rng(n)
    x = np.cumsum(rng.normal(size=(n, 100)), axis=0) @ rng.normal(size=(100, 100))
    rows = series_frame(spark, s=x, flat=np.ones((n, 100)), empty=np.zeros((0, 100)))
    for keep in (0.9, None):
        whole = {r["series"]: r for r in fit_sfa(series_moments(rows), 3, keep, 1e-9, "ratio").collect()}
        found = {r["series"]: r for r in fit_windowed_sfa(rows.repartition(3), 3, keep, 1e-9, "ratio").collect()}
        assert found.keys() == whole.keys() == {"s", "flat"}
        for s, own in found.items():
            want = whole[s]
            assert (own["n"], own["n_nontrivial"]) == (want["n"], want["n_nontrivial"])
            assert np.allclose(own["deltas"], want["deltas"], atol=1e-6)
            assert np.allclose(own["variances"], want["variances"], rtol=1e-8, atol=1e-8 * max(want["variances"][0], 1e-30))
            assert np.allclose(own["mean"], want["mean"])
            if keep:
                y = (x - x.mean(0)) @ np.array(own["components"]).T if s == "s" else x[:, :3] * 0
                z = (x - x.mean(0)) @ np.array(want["components"]).T if s == "s" else y
                assert np.allclose(y, z, atol=1e-4)


def test_windowed_fits_reject_uneven_vectors(spark):
    rows = spark.createDataFrame([("s", 1, [1.0]), ("s", 2, [1.0, 2.0])], "series string, window_start int, embedding array<double>")
    with pytest.raises(Exception, match="different length|null entry"):
        fit_windowed_sfa(rows, 1).collect()


def test_cutoff_modes():
    c, d = np.diag([100.0, 1.0, 0.01]), np.diag([100.0, 1.0, 0.01])
    assert len(slow_directions(c, d, 99, cutoff=0.02)[0]) == 2
    assert len(slow_directions(c, d, 99, cutoff=0.02, cutoff_mode="ratio")[0]) == 1
    assert len(slow_directions(c, d, 99)[0]) == 3


def test_stacked_slowness_equals_single():
    rng = np.random.default_rng(4)
    for n, d in ((60, 6), (4, 6)):
        stack = [walk(rng, n, d) for _ in range(8)]
        c, dd = np.array([np.cov(x.T) for x in stack]), np.array([np.cov(np.diff(x, axis=0).T) for x in stack])
        found = slowest(c, dd, n, 0.99)
        assert np.allclose(found, [slow_directions(a, b, n, 0.99)[0][0] for a, b in zip(c, dd)], atol=1e-8)
    assert np.isnan(slowest(np.zeros((1, 2, 2)), np.zeros((1, 2, 2)), 9, 0.99)).all()


def test_time_scales(spark):
    rng = np.random.default_rng(2)
    start = dt.datetime(2024, 1, 1)
    x = walk(rng, 90, 2)
    data = [("s", start + dt.timedelta(days=i), [float(v) for v in row]) for i, row in enumerate(x)]
    rows = spark.createDataFrame(data, "series string, date timestamp_ntz, embedding array<float>")
    found = {r["days"]: (r["n"], r["delta"]) for r in slowness_by_time_scale(rows, 10).collect()}
    assert found[1][0] == 90 and found[1][1] < found[10][1]


def test_gains(spark, data):
    x = data["slow"]
    frame = series_frame(spark, s=x, flat=np.ones((9, 5)))
    gains = label_gains(frame, 5, n_iterations=23, seed=1, iterations_per_task=10)
    rows = gains.collect()
    assert len(rows) == 2 * 23 * 5
    total = slowness(frame).where("series = 's'").first()["delta"]
    orders = {r["iteration"]: r["label_order"] for r in label_orders(spark, 23, 5, seed=1).collect()}
    c, d = np.cov(x.T), np.cov(np.diff(x, axis=0).T)
    for it in range(23):
        own = {r["label_idx"]: r["delta_diff"] for r in rows if r["iteration"] == it and r["series"] == "s"}
        assert sum(own.values()) == pytest.approx(2 - total, abs=1e-6)
        expected = prefix_gains(c, d, len(x), np.array([orders[it]]))[0]
        assert [own[i] for i in orders[it]] == pytest.approx(list(expected), abs=1e-6)
    assert {r["delta_diff"] for r in rows if r["series"] == "flat"} == {0.0}
    labels = spark.createDataFrame([(i, "same" if i in (1, 3) else str(i)) for i in range(5)], "label_idx int, label string")
    means = mean_label_gains(gains, labels).where("series = 's'").collect()
    assert sorted(r["label_idx"] for r in means) == list(range(5))
    assert [r["label"] for r in means].count("same") == 2


def test_label_orders_are_permutations(spark):
    orders = lambda n: {r[0]: r[1] for r in label_orders(spark, 40, 6).repartition(n).collect()}
    assert orders(1) == orders(16)
    assert all(sorted(o) == list(range(6)) for o in orders(1).values()) and len({tuple(o) for o in orders(1).values()}) > 20


def test_extremes(spark):
    rows = spark.range(100).select(
        F.when(F.col("id") < 66, "a").otherwise("b").alias("series"), "id",
        F.array((F.col("id") % 50).cast("double"), (-F.col("id")).cast("double")).alias("v"),
    )
    found = extreme_rows(rows, "v", 3, ["id"], ["id"], ["series"])
    pick = lambda s, c, side: [r["id"] for r in found.where(f"series='{s}' and component={c} and side='{side}'").orderBy("rank").collect()]
    assert pick("a", 0, "high") == [49, 48, 47] and pick("a", 0, "low") == [0, 50, 1]
    assert pick("b", 1, "high") == [66, 67, 68] and pick("b", 1, "low") == [99, 98, 97]
    assert found.columns == ["series", "component", "side", "rank", "score", "id"]
    assert extreme_rows(rows, "v", 3, ["id"], ["id"], n_components=1).count() == 6
    assert [f.dataType.simpleString() for f in found.schema][1:5] == ["int", "string", "int", "double"]


def test_extremes_equal_a_sort_in_any_partitioning(spark):
    rng = np.random.default_rng(12)
    vectors = rng.integers(0, 6, size=(400, 3)).astype(float)  # many ties
    vectors[5, 1] = np.nan
    data = [((None, "a", "b")[i % 3], f"k{i:03d}", [float(v) for v in row[: 2 + i % 2]]) for i, row in enumerate(vectors)]
    data += [("a", "none", None), ("a", "holes", [None, 9.0, None])]
    rows = spark.createDataFrame(data, "series string, id string, v array<double>")
    expected = set()
    for name in (None, "a", "b"):
        for c in range(3):
            own = [(v[c], i) for s, i, v in data if s == name and v and len(v) > c and v[c] is not None and v[c] == v[c]]
            for side, sign in (("high", -1), ("low", 1)):
                best = sorted(own, key=lambda r: (sign * r[0], r[1]))[:7]
                expected |= {(name, c, side, rank, *r) for rank, r in enumerate(best, 1)}
    for n in (1, 9):
        found = extreme_rows(rows.repartition(n), "v", 7, ["id"], ["id"], ["series"])
        assert {tuple(r) for r in found.collect()} == expected
    # few rows per series and end leave a task
    sent = extreme_rows(rows.repartition(2), "v", 2, ["id"], ["id"], ["series"])
    assert sent.count() == 3 * 3 * 2 * 2
    assert extreme_rows(rows.limit(0), "v", 2, ["id"], ["id"]).count() == 0


def test_label_algebra(spark):
    rng = np.random.default_rng(8)
    sfa, pca = rng.normal(size=(2, 3)), rng.normal(size=(3, 4))
    long = lambda m: spark.createDataFrame(
        [("s", i, j, float(m[i, j])) for i in range(m.shape[0]) for j in range(m.shape[1])],
        "series string, component int, label_idx int, weight double",
    )
    dense = lambda df, shape: np.array([[df[(i, j)] for j in range(shape[1])] for i in range(shape[0])])
    product = {(r["component"], r["label_idx"]): r["weight"] for r in L.multiply(long(sfa), long(pca)).collect()}
    assert np.allclose(dense(product, (2, 4)), sfa @ pca)

    ratios = [0.6, 0.3, 0.1]
    table = spark.createDataFrame([("s", i, r) for i, r in enumerate(ratios)], "series string, component int, ratio double")
    found = {r["label_idx"]: r["importance"] for r in L.importance(long(pca), table).collect()}
    assert [found[j] for j in range(4)] == pytest.approx(list(np.abs(np.sqrt(ratios)[:, None] * pca).max(axis=0)))

    deltas = np.array([0.5, 2.5])
    table = spark.createDataFrame([("s", i, float(x)) for i, x in enumerate(deltas)], "series string, component int, delta double")
    variances = spark.createDataFrame([("s", j, 1.0) for j in range(3)], "series string, dim int, variance double")
    found = {r["label_idx"]: r["importance"] for r in L.temporal_importance(long(sfa), table, variances).collect()}
    unit = sfa / np.linalg.norm(sfa, axis=1)[:, None] * np.clip(2 - deltas, 0, None)[:, None]
    assert [found[j] for j in range(3)] == pytest.approx(list(np.abs(unit).max(axis=0)))

    names = spark.createDataFrame([(j, f"l{j}") for j in range(4)], "label_idx int, label string")
    ordered = L.ordered_weights(long(pca), names).where("component = 1").orderBy("position").collect()
    assert [r["label_idx"] for r in ordered] == list(np.argsort(pca[1]))


def test_whitening_axes_are_unit_rows(spark, rows):
    models = fit_sfa(series_moments(rows), 2)
    lengths = L.whitening_axes(models).groupBy("series", "component").agg(F.sum(F.col("weight") ** 2).alias("l")).collect()
    assert all(r["l"] == pytest.approx(1) for r in lengths)
    flags = L.explained_variance_of_sfa(models).where("series = 'short'").orderBy("component").collect()
    assert [r["retained"] for r in flags] == [True, True, False, False, False]


@pytest.mark.parametrize("limit", [1 << 20, 20])
def test_spectrum(spark, limit):
    rng = np.random.default_rng(6)
    y = {"even": rng.normal(size=64), "odd": rng.normal(size=31), "tiny": rng.normal(size=8), "one": np.ones(1), None: rng.normal(size=37)}
    data = [(s, i, float(v)) for s, values in y.items() for i, v in enumerate(values)]
    rows = spark.createDataFrame(data, "series string, window_start int, v double").repartition(5)
    found = amplitude_spectrum(rows, "v", max_fft_rows=limit).collect()
    for s, values in y.items():
        own = sorted((r["k"], r["frequency"], r["amplitude"]) for r in found if r["series"] == s)
        n = len(values)
        assert [k for k, _, _ in own] == list(range(n // 2))
        assert [f for _, f, _ in own] == pytest.approx([k / n for k in range(n // 2)])
        assert [a for _, _, a in own] == pytest.approx(list(2 / n * np.abs(np.fft.fft(values)[: n // 2])), abs=1e-9)


def test_smoothing(spark):
    start = dt.datetime(2024, 1, 1)
    t = np.arange(120.0)
    curve = 3 * np.sin(t / 20)
    y = curve + np.random.default_rng(0).normal(size=120)
    data = [(s, start + dt.timedelta(days=float(a)), float(b)) for s, values in (("sine", y), ("zero", y * 0)) for a, b in zip(t, values)]
    rows = spark.createDataFrame(data, "series string, window_start timestamp_ntz, v double")
    found = smooth(rows, "v")
    own = found.where("series = 'sine'").orderBy("day").collect()
    assert len(own) == 120 and np.abs(np.array([r["mean"] for r in own]) - curve).mean() < 0.5
    assert all(r["lower"] < r["mean"] < r["upper"] for r in own)
    assert {r["mean"] for r in found.where("series = 'zero'").collect()} == {0.0}


def test_sums_equal_the_kernel_of_the_rows():
    rng = np.random.default_rng(1)
    for n, days in ((1, 1), (7, 30), (900, 60), (500, 700)):
        t = np.sort(rng.uniform(0, days, n)) + 19_000
        y = 3 * np.sin(t / 15) + rng.normal(size=n)
        waves = Waves(t[0], t[-1], (10.0, 100.0))
        sums = Sums.of_rows(waves, t[: n // 2], y[: n // 2]) + Sums.of_rows(waves, t[n // 2 :], y[n // 2 :])
        for scale in (10.0, 31.4, 100.0):
            exact = likelihoods(t, y, scale, 1.0)
            assert np.allclose(sums.likelihoods(waves, scale, 1.0), exact, rtol=1e-8, atol=1e-7)
            for amplitude in (AMPLITUDES[0], 1.0, AMPLITUDES[-1]):
                mean, root = sums.curve(waves, scale, amplitude, 1.0)
                values = waves.at(t, len(mean))
                want, deviation = posterior_at(t, y, scale, amplitude, 1.0)
                assert np.allclose(values @ mean, want, atol=1e-8)
                assert np.allclose(np.sqrt(((values @ root) ** 2).sum(1)), deviation, atol=1e-7)


def test_length_scale_is_continuous():
    peak = lambda s: -((np.log(s / 37.3)) ** 2) - np.abs(np.log10(AMPLITUDES))
    scale, amplitude = best_fit(peak, (10.0, 100.0))
    assert scale == pytest.approx(37.3, rel=1e-3) and amplitude == pytest.approx(1)
    assert best_fit(lambda s: peak(s / 100), (10.0, 100.0))[0] == 100.0
    assert best_fit(peak, (10.0, 10.0))[0] == 10.0


def test_long_series_equal_the_dense_fit(spark, monkeypatch):
    """Hourly rows on both sides of the number of waves, in one part and in several; null series kept."""
    start, rng = dt.datetime(2024, 1, 1), np.random.default_rng(1)
    data, count = [], Waves(0.0, 899 / 24, (10.0, 100.0)).count
    for name, n in (("long", 900), (None, 700), ("short", 40), ("border", count), ("over", count + 40)):
        y = 3 * np.sin(np.arange(n) / 150) + rng.normal(size=n)
        data += [(name, start + dt.timedelta(hours=i), float(v)) for i, v in enumerate(y)]
    rows = spark.createDataFrame(data, "series string, window_start timestamp_ntz, v double").repartition(5)
    for limit in (100_000, 200):
        monkeypatch.setattr(smoothing, "PART_ROWS", limit)
        found = {}
        for r in smooth(rows, "v").collect():
            found.setdefault(r["series"], []).append((r["day"], r["length_scale"], r["mean"], r["upper"]))
        assert {k: len(v) for k, v in found.items()} == {"long": 900, None: 700, "short": 40, "border": count, "over": count + 40}
        for name, own in found.items():
            own = np.array(sorted(own))
            y = np.array([v for s, _, v in data if s == name])
            scale, amplitude = best_fit(lambda s: likelihoods(own[:, 0], y, s, 1.0), (10.0, 100.0))
            assert np.allclose(own[:, 1], scale, rtol=1e-3)
            mean, deviation = posterior_at(own[:, 0], y, own[0, 1], amplitude, 1.0)
            assert np.allclose(own[:, 2], mean, atol=1e-6) and np.allclose(own[:, 3], mean + 1.96 * deviation, atol=1e-6)


def test_posterior_equals_textbook():
    t, y = np.arange(6.0) * 9, np.array([0.0, 1, 3, 2, 1, -1])
    fits = likelihoods(t, y, 15.0, 1.0)
    amplitude = AMPLITUDES[int(np.argmax(fits))]
    mean, deviation = posterior_at(t, y, 15.0, amplitude, 1.0)
    k = amplitude * np.exp(-0.5 * ((t[:, None] - t) / 15) ** 2)
    total = k + np.eye(6)
    assert np.allclose(mean, k @ np.linalg.solve(total, y))
    assert np.allclose(deviation**2, np.diag(k - k @ np.linalg.solve(total, k)))
    assert fits.max() == pytest.approx(-0.5 * (y @ np.linalg.solve(total, y) + np.linalg.slogdet(total)[1] + 6 * np.log(2 * np.pi)))
