"""Quality by a regularised quadratic discriminant over statistics of whole texts.

Each class, good and poor, is a normal density over a dozen or so statistics of a
text (how long, how varied, how repetitive, how much of it is marks or capitals),
transformed so that they spread evenly. Means and covariances of the classes are
summed up by Spark over all labelled rows; a class's covariance is drawn towards the
one of both classes together, and that mixture towards a multiple of the identity. How
far is chosen on folds: moments of the other folds are at hand without another pass.
The score is the logistic of the difference of both log densities (Mahalanobis
distances and log determinants from Cholesky factors made once) and log priors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slowtide.llm.codes import Sums, code_points, map_texts, mix, offsets, spans
from slowtide.operators.moments import matrix_of, moments
from slowtide.session import write_once

FOLDS = 3
#: Shares of the joint covariance in a class's own, and of the identity in the mixture, that are tried.
TOWARDS_JOINT = (0.0, 0.05, 0.2, 0.5)
TOWARDS_IDENTITY = (1e-4, 1e-3, 1e-2, 0.1)
#: The least score of a good text.
GOOD = 0.7
#: Words in a row that count as one passage.
PASSAGE = 5
STATISTICS = (
    "words", "word_length", "line_words", "capitals", "marks", "marked_words", "calls", "digits",
    "variety", "passages_repeated", "words_doubled", "lines_repeated", "commonest", "ends", "shouted", "character_entropy",
)
_PLAIN = frozenset(".,;:'\"!?-()")


def _character_kinds() -> np.ndarray:
    """Bits for code points below U+3000: letter 1, capital 2, digit 4, white space 8, other mark 16, call 32, sentence end 64."""
    kinds = np.zeros(0x3000, np.uint8)
    for i in range(0x3000):
        c = chr(i)
        kinds[i] = (
            c.isalpha() + 2 * (c.isupper()) + 4 * c.isdigit() + 8 * c.isspace()
            + 16 * (not c.isalnum() and not c.isspace() and c not in _PLAIN)
            + 32 * (c in "!?") + 64 * (c in ".!?")
        )
    return kinds


_KINDS = _character_kinds()
LETTER, CAPITAL, DIGIT, SPACE, MARK, CALL, END = (1 << i for i in range(7))


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """The arc sine of the root of part / whole: shares with a variance that hardly depends on their size."""
    return np.arcsin(np.sqrt(np.clip(part / np.maximum(whole, 1), 0.0, 1.0)))


def _repeats(values: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each owner: how many distinct values it has, and how often its commonest one occurs."""
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(fresh)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, owner[at], np.diff(np.append(at, len(values))))
    return np.bincount(owner[at], minlength=n), most


def statistics(texts: list[str]) -> np.ndarray:
    """One row per text, one column per name in ``STATISTICS``; an empty text has zeros."""
    n = len(texts)
    codes, bounds = code_points("\n".join(texts) + "\n" if texts else ""), offsets(len(t) + 1 for t in texts)
    kind = np.where(codes < len(_KINDS), _KINDS[np.minimum(codes, len(_KINDS) - 1)], LETTER).astype(np.uint8)
    totals = {}
    for name, bit in (("letters", LETTER), ("capitals", CAPITAL), ("digits", DIGIT), ("marks", MARK), ("calls", CALL), ("ends", END), ("white", SPACE)):
        sums = np.concatenate([[0], np.cumsum((kind & bit) > 0)])
        totals[name] = np.diff(sums[bounds]).astype(float)
    size = np.diff(bounds) - 1.0
    visible = size - (totals["white"] - 1)

    white = (kind & SPACE) > 0
    starts, ends = spans(~white)
    owner = np.searchsorted(bounds, starts, side="right") - 1
    words = np.bincount(owner, minlength=n).astype(float)
    sums = Sums(codes)
    hashes = sums.hashes(starts, ends)
    distinct, most = _repeats(hashes, owner, n)
    marked = np.bincount(owner[(kind[ends - 1] & (MARK | CALL)) > 0], minlength=n)
    capitals = np.concatenate([[0], np.cumsum((kind & CAPITAL) > 0)])
    loud = (capitals[ends] - capitals[starts]) * 2 > ends - starts
    shouted = np.bincount(owner[loud & (ends - starts > 1)], minlength=n)
    doubled = np.bincount(owner[1:][(hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])], minlength=n)

    last = np.arange(len(starts)) + PASSAGE - 1
    inside = np.flatnonzero((last < len(starts)) & (owner[np.minimum(last, len(starts) - 1)] == owner)) if len(starts) else last
    mixed = np.zeros(len(inside), np.uint64)
    for i in range(PASSAGE):
        mixed = mix(mixed + hashes[inside + i])
    passages = np.bincount(owner[inside], minlength=n)
    passages_distinct, _ = _repeats(mixed, owner[inside], n)

    starts, ends = spans(codes != 10)
    line_owner = np.searchsorted(bounds, starts, side="right") - 1
    lines = np.bincount(line_owner, minlength=n)
    lines_distinct, _ = _repeats(sums.hashes(starts, ends), line_owner, n)

    # the entropy of characters, by counts of their low bits
    low = np.minimum(codes, 1023).astype(np.int64)
    place = np.repeat(np.arange(n), np.diff(bounds)) * 1024 + low
    values, counts = np.unique(place[~white], return_counts=True)
    share = counts / np.maximum(visible[values >> 10], 1)
    entropy = np.bincount(values >> 10, weights=-share * np.log(share), minlength=n)

    columns = {
        "words": np.log1p(words),
        "word_length": np.log1p(visible / np.maximum(words, 1)),
        "line_words": np.log1p(words / np.maximum(lines, 1)),
        "capitals": _share(totals["capitals"], totals["letters"]),
        "marks": _share(totals["marks"], visible),
        "marked_words": _share(marked, words),
        "calls": _share(totals["calls"], visible),
        "digits": _share(totals["digits"], visible),
        "variety": np.log1p(distinct) - np.log1p(words),
        "passages_repeated": _share(passages - passages_distinct, passages),
        "words_doubled": _share(doubled, words - 1),
        "lines_repeated": _share(lines - lines_distinct, lines),
        "commonest": _share(most, words),
        "ends": _share(totals["ends"], words),
        "shouted": _share(shouted, words),
        "character_entropy": entropy,
    }
    return np.stack([columns[c] for c in STATISTICS], axis=1) if n else np.zeros((0, len(STATISTICS)))


@dataclass(frozen=True)
class Moments:
    """Rows, mean and scatter matrix of a class."""

    n: int
    mean: np.ndarray
    scatter: np.ndarray

    @classmethod
    def none(cls, d: int) -> Moments:
        return cls(0, np.zeros(d), np.zeros((d, d)))

    def __add__(self, other: Moments) -> Moments:
        n = self.n + other.n
        if not self.n or not other.n:
            return other if not self.n else self
        shift = other.mean - self.mean
        spread = np.outer(shift, shift) * (self.n * other.n / n)
        return Moments(n, self.mean + shift * (other.n / n), self.scatter + other.scatter + spread)


@dataclass(frozen=True)
class Discriminant:
    """Densities of poor (0) and good (1) texts: means, Cholesky factors of the covariances, log weights."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    weights: np.ndarray

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """Log odds of good for rows of statistics."""
        z = (x - self.centre) / self.scale
        parts = []
        for mean, factor, weight in zip(self.means, self.factors, self.weights):
            along = np.linalg.solve(factor, (z - mean).T)
            parts.append(weight - 0.5 * (along * along).sum(0) - np.log(np.diag(factor)).sum())
        return parts[1] - parts[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.log_odds(x), -700, 700)))


def fit_discriminant(classes: tuple[Moments, Moments], towards_joint: float, towards_identity: float) -> Discriminant | None:
    """Densities from the moments of poor and good rows; None unless both have rows."""
    poor, good = classes
    if not poor.n or not good.n:
        return None
    whole = poor + good
    scale = np.sqrt(np.diag(whole.scatter) / whole.n)
    scale = np.where(scale > 1e-9, scale, 1.0)
    square = np.outer(scale, scale)
    joint = (poor.scatter + good.scatter) / square / whole.n
    means, factors, weights = [], [], []
    for own in classes:
        covariance = (1 - towards_joint) * own.scatter / square / own.n + towards_joint * joint
        level = max(np.trace(covariance) / len(scale), 1e-6)
        covariance = (1 - towards_identity) * covariance + towards_identity * level * np.eye(len(scale))
        means.append((own.mean - whole.mean) / scale)
        factors.append(np.linalg.cholesky(covariance))
        weights.append(np.log(own.n / whole.n))
    return Discriminant(whole.mean, scale, np.stack(means), np.stack(factors), np.array(weights))


def measured(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add the array ``statistics`` of every whole text."""
    lists = T.ArrayType(T.DoubleType())

    def work(texts: list[str]) -> list[pa.Array]:
        found = statistics(texts)
        cuts = pa.array(np.arange(len(texts) + 1) * found.shape[1], pa.int32())
        return [pa.ListArray.from_arrays(cuts, pa.array(found.ravel()))]

    return map_texts(docs, text, {"statistics": lists}, lambda: work, keep)


def class_moments(rows: DataFrame) -> dict[tuple[int, int], Moments]:
    """Moments of the statistics per (quality, fold); the driver gets 2 · ``FOLDS`` matrices of a dozen rows."""
    found: dict[tuple[int, int], list] = {}
    for row in moments(rows, ["quality", "fold"], "statistics").collect():
        found.setdefault((row.quality, row.fold), []).append(row)
    merged = {}
    for key, own in found.items():
        own.sort(key=lambda r: r.i)
        n = own[0].n
        merged[key] = Moments(n, np.array(own[0].mean), np.array([r.covariance for r in own]) * max(n - 1, 0))
    return merged


def _sum(parts: dict[tuple[int, int], Moments], quality: int, leave: int | None = None) -> Moments:
    total = Moments.none(len(STATISTICS))
    for (own, fold), part in sorted(parts.items()):
        if own == quality and fold != leave:
            total = total + part
    return total


def fit_quality(rows: DataFrame) -> Discriminant | None:
    """Fit on labelled rows ``quality`` (0 or 1), ``fold``, ``statistics``; None unless both classes occur.

    Every mixture of covariances is fitted without a fold and judged on it by its
    log loss, summed up in Spark; the best one is fitted on all rows.
    """
    parts = class_moments(rows)
    tried = [(a, b) for a in TOWARDS_JOINT for b in TOWARDS_IDENTITY]
    models = {
        (fold, t): fit_discriminant((_sum(parts, 0, fold), _sum(parts, 1, fold)), *mixture)
        for fold in range(FOLDS)
        for t, mixture in enumerate(tried)
    }

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, seen = np.zeros(len(tried)), False
        for batch in batches:
            if not batch.num_rows:
                continue
            seen = True
            x, y, folds = matrix_of(batch.column("statistics")), batch.column("quality").to_numpy(), batch.column("fold").to_numpy()
            for (fold, t), model in models.items():
                own = folds == fold
                if model is not None and own.any():
                    odds = model.log_odds(x[own])
                    # a row beyond all doubt costs no more than 30
                    loss[t] += np.minimum(np.logaddexp(0, np.where(y[own] == 1, -odds, odds)), 30).sum()
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(tried))), pa.array(loss)], names=["mixture", "loss"])

    losses = rows.select("quality", "fold", "statistics").mapInArrow(judge, "mixture long, loss double")
    ranked = sorted((round(r.loss, 6), r.mixture) for r in losses.groupBy("mixture").agg(F.sum("loss").alias("loss")).collect())
    if not ranked:
        return None
    return fit_discriminant((_sum(parts, 0), _sum(parts, 1)), *tried[ranked[0][1]])


def remainder(doc_id, of: int):
    """crc32 of the decimal id modulo ``of``; null for null."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(of))


def document_quality(docs: DataFrame, labels: DataFrame, held_out: int = 2, text: str = "text") -> DataFrame:
    """Score every whole text by a discriminant learnt from the labelled rows that are not held out.

    ``doc_id, held_out, score, predicted``, a row per row of ``docs``. Held out is a row
    whose crc32 of the decimal doc_id leaves ``held_out`` modulo 4; the other three remainders are
    the folds. Scores depend on texts alone: equal texts have equal scores. Null and empty texts
    have zeros for statistics and are scored as such. Rows without doc_id are not
    held out and have no label. Of several label rows of one doc_id the largest quality counts,
    labels that are null are left out, and every row of a repeated doc_id takes part in the fit.
    Unless both classes are labelled, every score is 0.5. Extra columns are not kept.

    All labelled rows take part; there is no sample. The statistics are stored once, as
    ``len(STATISTICS)`` numbers a row, and joined with the labels by doc_id.
    """
    stored = write_once(measured(docs, text, ["doc_id"]), "text-statistics")
    one = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    part = remainder(F.col("doc_id"), 4)
    # the three remainders that are not held out, numbered from 0
    learnt = stored.where(part != held_out).join(one, "doc_id").withColumn("fold", F.pmod(part - held_out - 1, F.lit(4)).cast("int"))
    model = fit_quality(write_once(learnt.select("quality", "fold", "statistics"), "labelled-statistics"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix_of(batch.column("statistics"))
            found = model.score(x) if model is not None and len(x) else np.full(batch.num_rows, 0.5)
            good = pc.cast(pc.greater_equal(pa.array(found), GOOD), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found), good], names=["doc_id", "held_out", "score", "predicted"])

    schema = T.StructType([stored.schema["doc_id"]]).add("held_out", "boolean").add("score", "double").add("predicted", "integer")
    own = F.coalesce(part == held_out, F.lit(False)).alias("held_out")
    return stored.select("doc_id", own, "statistics").mapInArrow(score, schema)
