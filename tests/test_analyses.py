"""The end-to-end analyses against plain numpy on collected data."""

import datetime as dt
import inspect
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from slowtide.functions.scorers import LexicalEncoder, LexicalPairScorer
from slowtide.operators.scoring import add_embeddings, add_label_vectors
from slowtide.operators.sentences import explode_sentences
from slowtide.operators.slowness import label_orders
from slowtide.operators.threads import practice_logs
from slowtide.plans import analyses, registry
from slowtide.plans.vocabulary import ANALYSIS_LABELS
from slowtide.sources.testbed import LEXICON, LEXICON_LABELS
from slowtide.sources import testbed

ENCODER, SCORER = LexicalEncoder(6), LexicalPairScorer(LEXICON)
DAY = dt.timedelta(days=1)
EPOCH = dt.datetime(1970, 1, 1)


@pytest.fixture(scope="module")
def messages(spark, sf):
    # fewer writers, so that their series are long enough on the smallest tables
    rows = testbed.messages(spark, sf)
    return rows.withColumn("author", F.substring_index("author", "_", 1)).withColumn("category", F.lit("PracticeLogs"))


def logs_of(messages, add, per_sentence):
    rows = practice_logs(messages).where("msg is not null")
    rows = explode_sentences(rows) if per_sentence else rows.withColumn("sentence_idx", F.lit(0))
    found = defaultdict(list)
    for r in add(rows).orderBy("date", "msg_id", "sentence_idx").collect():
        found[r["author"]].append((r["date"], np.array(r["embedding"], dtype=float), (r["msg_id"], r["sentence_idx"], r["msg"])))
    return found


def pool(rows, every, period=None, offset=dt.timedelta(0)):
    period = period or every
    floor = lambda t: EPOCH + offset + (t - EPOCH - offset) // every * every
    at, windows = floor(rows[0][0]), []
    while at <= rows[-1][0]:
        inside = [v for t, v, _ in rows if at <= t < at + period]
        if inside:
            windows.append((at, np.mean(inside, axis=0).astype(np.float32).astype(float)))
        at += every
    return [w for w, _ in windows], np.array([v for _, v in windows])


def pca(x, keep):
    _, s, v = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    var = s**2 / (len(x) - 1)
    if isinstance(keep, float):
        keep = min(np.searchsorted(np.cumsum(var / var.sum()), keep, side="right") + 1, len(var))
    return v[:keep], var / var.sum()


def signed(rows):
    lead = np.abs(rows).argmax(axis=1)
    return rows * np.sign(rows[np.arange(len(rows)), lead])[:, None]


def sfa(x, k, cutoff=1e-15, ratio=False):
    """Slow features by whitening the rows themselves."""
    centred = x - x.mean(axis=0)
    _, s, v = np.linalg.svd(centred, full_matrices=False)
    var = s**2 / (len(x) - 1)
    good = var > max(cutoff * (var.sum() if ratio else 1), var[0] * x.shape[1] * 2.3e-16)
    white = v[good] / np.sqrt(var[good])[:, None]
    d = np.diff(centred @ white.T, axis=0)
    deltas, turn = np.linalg.eigh(np.atleast_2d(np.cov(d.T)))
    return deltas[:k], signed(turn.T @ white)[:k]


def author_delta(x):
    kept, _ = pca(x, 0.99)
    return sfa((x - x.mean(axis=0)) @ kept.T, 1)[0][0]


def test_author_slowness(messages):
    logs = logs_of(messages, lambda d: add_embeddings(d, ENCODER), False)
    found = {r["author"]: r for r in analyses.author_slowness(messages, ENCODER).collect()}
    assert set(found) == set(logs)
    for author, rows in logs.items():
        _, x = pool(rows, 7 * DAY, offset=4 * DAY)
        assert found[author]["n"] == len(x)
        if len(x) > 2:
            assert found[author]["delta"] == pytest.approx(author_delta(x), abs=1e-6)


def test_slow_features(messages):
    logs = logs_of(messages, lambda d: add_embeddings(d, ENCODER), False)
    found = analyses.slow_features(messages, ENCODER, n_components=2).collect()
    for author, rows in logs.items():
        starts, x = pool(rows, DAY, 7 * DAY)
        own = {r["window_start"]: (r["SFA_0"], r["SFA_1"]) for r in found if r["author"] == author}
        assert sorted(own) == starts
        kept, _ = pca(x, 0.98)
        y = (x - x.mean(axis=0)) @ kept.T
        _, weights = sfa(y, 2)
        expected = (x - x.mean(axis=0)) @ signed(weights @ kept).T
        got = np.array([own[s] for s in starts])[:, : expected.shape[1]]
        assert np.allclose(np.abs(got), np.abs(expected), atol=1e-4)


def test_time_scales(messages):
    logs = logs_of(messages, lambda d: add_embeddings(d, ENCODER), False)
    found = {(r["author"], r["days"]): r for r in analyses.slowness_over_time_scales(messages, ENCODER, 6).collect()}
    for author, rows in logs.items():
        for days in range(1, 7):
            _, x = pool(rows, days * DAY)
            r = found[(author, days)]
            assert r["n"] == len(x)
            if len(x) > 2:
                assert r["delta"] == pytest.approx(author_delta(x), abs=1e-6)


def test_typical_sentences(messages):
    logs = logs_of(messages, lambda d: add_embeddings(d, ENCODER), True)
    found = analyses.typical_sentences(messages, ENCODER, 2, 5).collect()
    for author, rows in logs.items():
        x = np.array([v for _, v, _ in rows])
        kept, _ = pca(x, 2)
        scores = (x - x.mean(axis=0)) @ signed(kept).T
        for c in range(2):
            for side, sign in (("high", -1), ("low", 1)):
                own = sorted((r["rank"], r["score"]) for r in found if (r["author"], r["component"], r["side"]) == (author, c, side))
                assert [s for _, s in own] == pytest.approx(sorted(scores[:, c], key=lambda v: sign * v)[:5], abs=1e-5)


def test_label_gains(spark, messages):
    logs = logs_of(messages, lambda d: add_label_vectors(d, SCORER, LEXICON_LABELS), True)
    found = {(r["author"], r["label_idx"]): r["mean_delta_diff"] for r in analyses.slowness_gain_per_label(messages, SCORER, LEXICON_LABELS, 7, 2).collect()}
    orders = [r["label_order"] for r in label_orders(spark, 7, len(LEXICON_LABELS), 2).collect()]
    for author, rows in logs.items():
        _, x = pool(rows, DAY)
        gains = defaultdict(list)
        for order in orders:
            before = 2.0
            for size in range(1, len(order) + 1):
                part = x[:, order[:size]]
                delta = author_delta(part) if part.var(axis=0).max() > 1e-14 else before
                gains[order[size - 1]].append(before - delta)
                before = delta
        for label, values in gains.items():
            assert found[(author, label)] == pytest.approx(np.mean(values), abs=1e-5)


def test_slowness_analysis(messages):
    logs = logs_of(messages, lambda d: add_label_vectors(d, SCORER, LEXICON_LABELS), True)
    run = analyses.SlownessAnalysis(messages, SCORER, LEXICON_LABELS, cutoff=1e-3, cutoff_mode="ratio", train_rows=25)
    by = lambda df, *keys: {tuple(r[k] for k in keys): r for r in df.collect()}
    deltas = by(run.deltas(), "author", "component")
    pca_weights = by(run.label_weights_of_pca(), "author", "component", "label_idx")
    sfa_weights = by(run.label_weights_of_sfa(), "author", "component", "label_idx")
    variance = by(run.explained_variance(), "author", "component")
    importance = by(run.label_importance(), "author", "label_idx")
    temporal = by(run.temporal_importance(), "author", "label_idx")
    curves = by(run.curves(), "author", "windows", "window_start")
    spectra = by(run.spectra(), "author", "component", "k")
    tops = {name: by(getattr(run, name)(), "author", "component", "side", "rank") for name in ("pca_sentences", "sfa_sentences", "whitened_sentences")}
    for author, rows in logs.items():
        x = np.array([v for _, v, _ in rows])
        kept, ratios = pca(x, 4)
        kept = signed(kept)
        for c in range(4):
            assert [pca_weights[(author, c, j)]["weight"] for j in range(10)] == pytest.approx(list(kept[c]), abs=1e-5)
        assert [variance[(author, c)]["ratio"] for c in range(10)] == pytest.approx(list(ratios), abs=1e-8)
        assert [variance[(author, c)]["retained"] for c in range(10)] == [True] * 4 + [False] * 6
        expected = np.abs(np.sqrt(ratios[:4])[:, None] * kept).max(axis=0)
        assert [importance[(author, j)]["importance"] for j in range(10)] == pytest.approx(list(expected), abs=1e-5)

        projected = [(t, (v - x.mean(axis=0)) @ kept.T, key) for t, v, key in rows]
        _, train = pool(projected, DAY, 7 * DAY)
        train = train[:25]
        plot_starts, plot = pool(projected, DAY)
        slow, weights = sfa(train, 2, 1e-3, True)
        filled = np.zeros((2, 4))
        filled[: len(weights)] = weights
        assert [deltas[(author, c)]["delta"] for c in range(len(slow))] == pytest.approx(list(slow), abs=1e-5)
        for c in range(2):
            assert [sfa_weights[(author, c, j)]["weight"] for j in range(10)] == pytest.approx(list((filled @ kept)[c]), rel=1e-3, abs=1e-3)
        unit = weights / np.linalg.norm(weights, axis=1)[:, None] * np.clip(2 - slow, 0, None)[:, None]
        assert [temporal[(author, j)]["importance"] for j in range(4)] == pytest.approx(list(np.abs(unit).max(axis=0)), abs=1e-3)
        assert [temporal[(author, j)]["variance"] for j in range(4)] == pytest.approx(list(train.var(axis=0)), abs=1e-8)
        y = (plot - train.mean(axis=0)) @ filled.T
        got = np.array([[curves[(author, "plot", s)][f"SFA_{c}"] for c in range(2)] for s in plot_starts])
        assert np.allclose(got, y, atol=1e-2, rtol=1e-3)
        n = len(y)
        amplitude = 2 / n * np.abs(np.fft.fft(got, axis=0))[: n // 2]
        assert np.allclose([[spectra[(author, c, k)]["amplitude"] for c in range(2)] for k in range(n // 2)], amplitude, atol=1e-6)
        scores = np.array([v for _, v, _ in projected])
        top = lambda name, c, side, count: [tops[name][(author, c, side, i + 1)]["score"] for i in range(count)]
        count = min(10, len(rows))
        assert top("pca_sentences", 0, "high", count) == pytest.approx(sorted(scores[:, 0])[::-1][:count], abs=1e-5)
        slow_scores = (scores - train.mean(axis=0)) @ filled.T
        assert top("sfa_sentences", 0, "low", count) == pytest.approx(sorted(slow_scores[:, 0])[:count], rel=1e-3, abs=1e-2)
        assert tops["whitened_sentences"][(author, 0, "high", 1)]["score"] >= tops["whitened_sentences"][(author, 0, "low", 1)]["score"]


def test_texts_come_with_vectors(messages):
    found = analyses.time_aggregated_logs(messages, ENCODER, "1w", with_text=True)
    assert found.columns == ["author", "window_start", "n", "embedding", "part", "msg"]
    assert found.where("msg is null or part <> 0").count() == 0


def test_registered_analyses_run_at_full_width(spark, sf, monkeypatch):
    calls = {}
    for name in ("slowness_gain_per_label", "slow_features", "slowness_over_time_scales"):
        def spy(*args, f=getattr(analyses, name), name=name):
            calls[name] = inspect.signature(f).bind(*args)
            calls[name].apply_defaults()
            return f(*args)

        monkeypatch.setattr(analyses, name, spy)
    registry.QUERIES["slowness_gain_of_all_labels"](spark, sf)
    gains = calls["slowness_gain_per_label"].arguments
    assert gains["labels"] == ANALYSIS_LABELS and gains["n_iterations"] == 1000
    for name in ("slow_features", "slowness_over_time_scales"):
        registry.QUERIES[name](spark, sf)
        assert calls[name].arguments["encoder"].dims == 384
    weights = registry.QUERIES["slowness_analysis_label_weights_of_pca"](spark, sf)
    assert {r.label_idx for r in weights.select("label_idx").distinct().collect()} == set(range(69))
