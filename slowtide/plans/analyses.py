"""The end-to-end analyses. Each runs for all authors (series) at once.

Restrict ``messages`` with ``practice_logs(..., author=...)`` for one author.
Models are called through a ``Memo``: each text, or pair of text and label, is
scored once, over all analyses that share it. Without one, a model gets tables
of its own for the run; scorers that are mere expressions are evaluated in place.
"""

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slowtide.functions.scorers import Encoder, PairScorer
from slowtide.operators import labels as L
from slowtide.operators.extremes import extreme_rows
from slowtide.operators.models import apply_model, fit_pca, fit_windowed_sfa
from slowtide.operators.moments import moments
from slowtide.operators.ordered import dimension_variance, first_rows
from slowtide.operators.scoring import Memo, label_vectors_of, vectors_of
from slowtide.operators.sentences import explode_sentences
from slowtide.operators.slowness import label_gains, mean_label_gains, slowness, slowness_by_time_scale
from slowtide.operators.spectrum import amplitude_spectrum
from slowtide.operators.threads import practice_logs
from slowtide.operators.windows import join_texts, pool_windows
from slowtide.plans.vocabulary import label_table
from slowtide.session import write_once

AUTHOR = ["author"]
MESSAGE = ["msg_id"]
SENTENCE = ["msg_id", "sentence_idx"]


def time_aggregated_logs(
    messages: DataFrame,
    encoder: Encoder,
    every: str,
    period: str | None = None,
    with_text: bool = False,
    memo: Memo | None = None,
) -> DataFrame:
    """Practice logs pooled in time windows: ``author, window_start, n, embedding`` (and texts).

    With texts the result has one row per part of a window's text; part 0 is
    the only one unless a window's text exceeds the size of one string.
    """
    logs = practice_logs(messages)
    pooled = pool_windows(vectors_of(logs, encoder, memo, MESSAGE), every, period, AUTHOR)
    if not with_text:
        return pooled
    return pooled.join(join_texts(logs, every, period, AUTHOR), [*AUTHOR, "window_start"], "left")


def author_slowness(
    messages: DataFrame, encoder: Encoder, every: str = "1w", dims: int = 1, memo: Memo | None = None
) -> DataFrame:
    """Slowness of each author's windowed series: ``author, n, delta``."""
    windows = time_aggregated_logs(messages, encoder, every, memo=memo)
    return slowness(windows, dims, series=AUTHOR, bounded=True)


def slow_features(
    messages: DataFrame,
    encoder: Encoder,
    every: str = "1d",
    period: str | None = "1w",
    keep: float | None = 0.98,
    n_components: int = 3,
    memo: Memo | None = None,
) -> DataFrame:
    """Windowed logs with the slowest features ``SFA_0 ..`` of each author."""
    windows = write_once(time_aggregated_logs(messages, encoder, every, period, memo=memo), "windows")
    share = keep if keep is not None and 0 < keep < 1 else None
    models = write_once(fit_windowed_sfa(windows, n_components, share, series=AUTHOR), "sfa")
    return apply_model(windows, models, ["window_start"], AUTHOR, target="SFA", split=n_components)


def add_pca_columns(
    df: DataFrame, n_components: int, spread_by: list[str], series: list[str] = ("series",), vector: str = "embedding"
) -> DataFrame:
    """Append ``PCA_0 ..`` of each series' own principal components."""
    models = write_once(fit_pca(moments(df, series, vector), n_components, series), "pca")
    return apply_model(df, models, spread_by, series, vector, target="PCA", split=n_components)


def typical_sentences(
    messages: DataFrame, encoder: Encoder, n_components: int = 1, k: int = 20, memo: Memo | None = None
) -> DataFrame:
    """The k sentences at either end of each author's principal components."""
    sentences = write_once(vectors_of(explode_sentences(practice_logs(messages)), encoder, memo, SENTENCE), "sentences")
    models = write_once(fit_pca(moments(sentences, AUTHOR), n_components, AUTHOR), "pca")
    projected = apply_model(sentences, models, SENTENCE, AUTHOR, target="PCA")
    return extreme_rows(projected, "PCA", k, SENTENCE, [*SENTENCE, "msg"], AUTHOR, n_components)


def slowness_over_time_scales(
    messages: DataFrame, encoder: Encoder, max_days: int = 30, memo: Memo | None = None
) -> DataFrame:
    """Slowness of each author's series for windows of 1 .. ``max_days`` days."""
    logs = vectors_of(practice_logs(messages), encoder, memo, MESSAGE)
    return slowness_by_time_scale(logs, max_days, AUTHOR)


def slowness_gain_per_label(
    messages: DataFrame,
    scorer: PairScorer,
    labels: list[str],
    n_iterations: int = 1000,
    seed: int = 0,
    memo: Memo | None = None,
) -> DataFrame:
    """Mean slowness gain of adding each label, over random orders of the labels."""
    sentences = label_vectors_of(explode_sentences(practice_logs(messages)), scorer, labels, memo, SENTENCE)
    daily = pool_windows(sentences, "1d", series=AUTHOR)
    gains = label_gains(daily, len(labels), n_iterations, seed, series=AUTHOR, bounded=True)
    means = mean_label_gains(gains, label_table(messages.sparkSession, labels), AUTHOR)
    # one row per author and label
    return means.orderBy(*AUTHOR, F.desc("mean_delta_diff"), "label_idx")


@dataclass
class SlownessAnalysis:
    """What changes slowly in each author's practice logs, and which labels and sentences show it.

    Tables that several reports need are stored once and read from storage.
    """

    messages: DataFrame
    scorer: PairScorer
    labels: list[str]
    train_period: str = "1w"
    plot_period: str = "1d"
    cutoff: float = 2e-2
    cutoff_mode: str = "absolute"
    n_pca: int = 4
    n_sfa: int = 2
    train_rows: int = 800
    memo: Memo | None = None

    @cached_property
    def label_names(self) -> DataFrame:
        return label_table(self.messages.sparkSession, self.labels)

    @cached_property
    def scored(self) -> DataFrame:
        """Sentences with one score per label."""
        sentences = explode_sentences(practice_logs(self.messages))
        return write_once(label_vectors_of(sentences, self.scorer, self.labels, self.memo, SENTENCE), "scored")

    @cached_property
    def pca(self) -> DataFrame:
        return write_once(fit_pca(moments(self.scored, AUTHOR), self.n_pca, AUTHOR), "pca")

    @cached_property
    def projected(self) -> DataFrame:
        """Sentences with their vector replaced by principal components."""
        return apply_model(self.scored, self.pca, SENTENCE, AUTHOR)

    @cached_property
    def train(self) -> DataFrame:
        pooled = pool_windows(self.projected, "1d", self.train_period, AUTHOR)
        return write_once(first_rows(pooled, self.train_rows, ["window_start"], AUTHOR), "train")

    @cached_property
    def plot(self) -> DataFrame:
        return write_once(pool_windows(self.projected, "1d", self.plot_period, AUTHOR), "plot")

    @cached_property
    def sfa(self) -> DataFrame:
        found = fit_windowed_sfa(self.train, self.n_sfa, cutoff=self.cutoff, cutoff_mode=self.cutoff_mode, series=AUTHOR)
        return write_once(found, "sfa")

    def with_slow_features(self, df: DataFrame, spread_by: list[str], split: bool = True) -> DataFrame:
        """``SFA_0 ..`` columns (or one array) from the trained model on any table of projected vectors."""
        return apply_model(
            df, self.sfa, spread_by, AUTHOR, target="SFA", split=self.n_sfa if split else None
        )

    def deltas(self) -> DataFrame:
        return L.component_values(self.sfa, "deltas", "delta", AUTHOR)

    def pca_sentences(self, k: int = 10) -> DataFrame:
        return extreme_rows(self.projected, "embedding", k, SENTENCE, [*SENTENCE, "msg"], AUTHOR, self.n_pca)

    def sfa_sentences(self, k: int = 10) -> DataFrame:
        rows = self.with_slow_features(self.projected, SENTENCE, split=False)
        return extreme_rows(rows, "SFA", k, SENTENCE, [*SENTENCE, "msg"], AUTHOR, self.n_sfa)

    def whitened_sentences(self, k: int = 10) -> DataFrame:
        """Extreme sentences along the whitened axes inside the slow-feature model."""
        rows = apply_model(self.projected, self.sfa, SENTENCE, AUTHOR, target="axes", matrix="whitening")
        return extreme_rows(rows, "axes", k, SENTENCE, [*SENTENCE, "msg"], AUTHOR)

    def label_weights_of_pca(self) -> DataFrame:
        return L.ordered_weights(L.weights(self.pca, AUTHOR), self.label_names, AUTHOR)

    def label_weights_of_sfa(self) -> DataFrame:
        return L.ordered_weights(L.slow_label_weights(self.sfa, self.pca, AUTHOR), self.label_names, AUTHOR)

    def pca_weights_in_sfa(self) -> DataFrame:
        return L.weights(self.sfa, AUTHOR).withColumnRenamed("label_idx", "pca_component")

    def whitening_weights(self) -> DataFrame:
        return L.whitening_axes(self.sfa, AUTHOR).withColumnRenamed("label_idx", "pca_component")

    def label_importance(self) -> DataFrame:
        ratios = L.component_values(self.pca, "ratios", "ratio", AUTHOR)
        found = L.importance(L.weights(self.pca, AUTHOR), ratios, AUTHOR)
        return found.join(self.label_names, "label_idx")

    def temporal_importance(self) -> DataFrame:
        """Importance of each input of the slow features, with its variance in the training windows."""
        variances = dimension_variance(self.train, AUTHOR)
        return L.temporal_importance(L.weights(self.sfa, AUTHOR), self.deltas(), variances, AUTHOR)

    def explained_variance(self) -> DataFrame:
        return L.explained_variance(self.pca, AUTHOR)

    def explained_variance_of_sfa(self) -> DataFrame:
        return L.explained_variance_of_sfa(self.sfa, AUTHOR)

    def curves(self) -> DataFrame:
        """Slow features over time, on training and on plotting windows."""
        parts = [
            self.with_slow_features(rows, ["window_start"]).select(
                *AUTHOR, F.lit(name).alias("windows"), "window_start", *[f"SFA_{i}" for i in range(self.n_sfa)]
            )
            for name, rows in (("train", self.train), ("plot", self.plot))
        ]
        return parts[0].unionByName(parts[1])

    def spectra(self) -> DataFrame:
        """Amplitude spectrum of every slow feature on the plotting windows."""
        rows = self.with_slow_features(self.plot, ["window_start"], split=False)
        long = rows.select(*AUTHOR, "window_start", F.posexplode("SFA").alias("component", "value"))
        return amplitude_spectrum(long, "value", ["window_start"], [*AUTHOR, "component"])
