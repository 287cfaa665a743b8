"""Toxicity by classifier chains of linear models over word features.

Categories are predicted in a fixed order. The model of a later category sees
the probabilities of all earlier ones. While it is trained those probabilities
are out of fold (each row's come from a model that did not see the row), so it
learns how far to trust them; when it is applied they come from the full models.

Features of a text are the words it holds and their beginnings (a word's stem
survives inflection), in lower case, plus the kinds of marks between words.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slowtide.llm.codes import Sums, code_points, map_texts, mix, offsets, spans
from slowtide.session import write_once

#: Labelled rows that a chain is fitted on at most, the first by hash of doc_id; their texts count whole.
SAMPLE = 10_000
FOLDS = 3
#: Features kept per category, and the least chi-square and number of texts to keep one.
FEATURES = 4000
LEAST_CHI2 = 30.0
LEAST_TEXTS = 5
#: Lengths of word beginnings used as features.
BEGINNINGS = (4, 5, 6)
RIDGE = 1.0
ITERATIONS = 25
_LETTER = np.array([chr(i).isalnum() for i in range(0x3000)])


def text_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct features, text after text, and the texts' bounds among them."""
    lowered = [t.lower() for t in texts]
    codes, bounds = code_points("\n".join(lowered)), offsets(len(t) + 1 for t in lowered)
    letter = np.where(codes < len(_LETTER), _LETTER[np.minimum(codes, len(_LETTER) - 1)], codes >= 0x3040)
    sums = Sums(codes)
    starts, ends = spans(letter)
    kinds, places = [sums.hashes(starts, ends)], [starts]
    for n in BEGINNINGS:
        long = ends - starts >= n
        kinds.append(sums.hashes(starts[long], starts[long] + n) + np.uint64(n))
        places.append(starts[long])
    space = (codes == 32) | (codes == 10) | (codes == 9) | (codes == 13)
    starts, ends = spans(~letter & ~space)
    kinds.append(mix(codes[starts].astype(np.uint64) * np.uint64(64) + np.minimum(ends - starts, 3).astype(np.uint64)))
    places.append(starts)
    hashes, owner = np.concatenate(kinds), np.searchsorted(bounds, np.concatenate(places), side="right") - 1
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[fresh], np.searchsorted(owner[fresh], np.arange(len(texts) + 1))


@dataclass(frozen=True)
class Chain:
    """Categories in order, the sorted hashes of all features, and one weight row per category.

    ``weights`` has a column per feature; ``links[c]`` weighs the earlier
    categories' probabilities (less one half), ``bias[c]`` stands alone.
    """

    categories: tuple[str, ...]
    features: np.ndarray
    weights: np.ndarray
    links: np.ndarray
    bias: np.ndarray
    #: probabilities from which a category holds, chosen on out-of-fold ones
    thresholds: np.ndarray

    def probabilities(self, texts: list[str]) -> np.ndarray:
        hashes, bounds = text_features(texts)
        sums = np.zeros((len(self.categories), len(texts)))
        if len(self.features) and len(hashes):
            at = np.minimum(np.searchsorted(self.features, hashes), len(self.features) - 1)
            held = self.features[at] == hashes
            owner = np.repeat(np.arange(len(texts)), np.diff(bounds))[held]
            for c, own in enumerate(self.weights):
                sums[c] = np.bincount(owner, weights=own[at[held]], minlength=len(texts))
        found = np.zeros_like(sums)
        for c in range(len(self.categories)):
            found[c] = _sigmoid(sums[c] + self.bias[c] + self.links[c, :c] @ (found[:c] - 0.5))
        return found


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def _fit_linear(columns: np.ndarray, rows: np.ndarray, extra: np.ndarray, y: np.ndarray, width: int) -> np.ndarray:
    """Ridge logistic regression by Newton steps with conjugate gradients: feature weights, links, bias.

    ``columns`` and ``rows`` place the ones of a sparse matrix, ``extra`` holds dense columns as rows.
    """
    n, k = len(y), extra.shape[0]
    ridge = np.full(width + k + 1, RIDGE)
    ridge[-1] = 1e-3  # the bias is hardly held back, but stays finite if all rows agree

    def times(x: np.ndarray) -> np.ndarray:
        return np.bincount(rows, weights=x[columns], minlength=n) + x[width : width + k] @ extra + x[-1]

    def back(r: np.ndarray) -> np.ndarray:
        sparse = np.bincount(columns, weights=r[rows], minlength=width)[:width]
        return np.concatenate([sparse, extra @ r, [r.sum()]])

    def loss(x: np.ndarray, z: np.ndarray) -> float:
        return float((np.logaddexp(0, z) - y * z).sum() + 0.5 * (ridge * x * x).sum())

    x = np.zeros(width + k + 1)
    z = times(x)
    now = loss(x, z)
    for _ in range(ITERATIONS):
        p = _sigmoid(z)
        slope, curve = back(p - y) + ridge * x, np.maximum(p * (1 - p), 1e-9)
        if np.abs(slope).max() < 1e-4:
            break
        step, r = np.zeros_like(x), -slope
        d, rr = r.copy(), float(r @ r)
        for _ in range(50):
            hd = back(curve * times(d)) + ridge * d
            alpha = rr / float(d @ hd)
            step, r = step + alpha * d, r - alpha * hd
            new = float(r @ r)
            if new < 1e-4 * float(slope @ slope):
                break
            d, rr = r + new / rr * d, new
        size = 1.0
        while size > 1e-4:
            z_new = times(x + size * step)
            after = loss(x + size * step, z_new)
            if after <= now:
                break
            size /= 2
        if size <= 1e-4 or now - after < 1e-9 * abs(now):
            break
        x, z, now = x + size * step, z_new, after
    return x


def _marked(hashes: np.ndarray, owner: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Features that are clearly more or less frequent in texts of the category, by chi-square.

    Counted in 16 ranges of the hash, one after the other, to save memory.
    """
    n, n1 = len(y), y.sum()
    if not 0 < n1 < n:
        return np.zeros(0, np.uint64)
    features, scores = [], []
    for part in range(16):
        at = np.flatnonzero(hashes >> np.uint64(60) == part)
        values, inverse, n_all = np.unique(hashes[at], return_inverse=True, return_counts=True)
        a = np.bincount(inverse, weights=y[owner[at]], minlength=len(values))
        b = n_all - a
        c, d = n1 - a, n - n1 - b
        chi2 = n * (a * d - b * c) ** 2 / np.maximum((a + b) * (c + d) * n1 * (n - n1), 1)
        keep = (n_all >= LEAST_TEXTS) & (chi2 >= LEAST_CHI2)
        features.append(values[keep])
        scores.append(chi2[keep])
    best = np.argsort(-np.concatenate(scores), kind="stable")[:FEATURES]
    return np.concatenate(features)[best]


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The cut with the best F1, halfway (in log odds) between the probabilities around it; one half without both kinds."""
    if y.min() == y.max():
        return 0.5
    order = np.argsort(-p, kind="stable")
    hits, taken = np.cumsum(y[order]), np.arange(1, len(y) + 1)
    f1 = 2 * hits / (taken + y.sum())
    odds = np.log(np.clip(p[order], 1e-12, 1 - 1e-12) / (1 - np.clip(p[order], 1e-12, 1 - 1e-12)))
    f1[:-1][odds[:-1] == odds[1:]] = -1  # equal probabilities stay together
    best = int(np.argmax(f1))
    low = odds[best + 1] if best + 1 < len(y) else odds[best] - 2
    return float(_sigmoid(np.array([(odds[best] + low) / 2]))[0])


def fit_chain(texts: Sequence[str], labels: np.ndarray, categories: Sequence[str]) -> Chain:
    """Fit a chain on texts and a 0/1 column of ``labels`` per category.

    Copies count once: texts whose labels and two smallest hashes agree. A
    category without both kinds of rows gets a constant.
    """
    parts, sizes, seen, kept, fold = [], [], set(), [], []
    for first in range(0, len(texts), 100):
        found, bounds = text_features(list(texts[first : first + 100]))
        for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:]), first):
            own = found[a:b]
            key = (*labels[i].tolist(), *_two_lowest(own))
            if key not in seen:
                seen.add(key)
                kept.append(i)
                parts.append(own.copy())
                sizes.append(len(own))
                fold.append(_fold(own))
    n, k = len(kept), len(categories)
    if not n:
        return Chain(tuple(categories), np.zeros(0, np.uint64), np.zeros((k, 0)), np.zeros((k, k)), np.full(k, -20.0), np.full(k, 0.5))
    joined, owner, y = np.concatenate(parts), np.repeat(np.arange(n, dtype=np.int32), sizes), labels[kept].astype(float)
    del parts
    features = np.unique(np.concatenate([_marked(joined, owner, y[:, c]) for c in range(k)]))
    held, columns = _places(features, joined)
    return _fit_categories(columns, owner[held], y, np.array(fold), features, categories)


def _two_lowest(own: np.ndarray) -> tuple[int, int]:
    """The least of a text's sorted hashes in two orders."""
    return (int(own[0]), int(mix(own).min())) if len(own) else (0, 0)


def _fold(own: np.ndarray) -> int:
    return int(mix(own[:1])[0] % np.uint64(FOLDS)) if len(own) else 0


def _places(features: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which hashes are among the sorted features, and the positions of those there."""
    at = np.minimum(np.searchsorted(features, hashes), max(len(features) - 1, 0))
    held = features[at] == hashes if len(features) else np.zeros(len(hashes), bool)
    return held, at[held]


def _fit_categories(
    columns: np.ndarray, rows: np.ndarray, y: np.ndarray, fold: np.ndarray, features: np.ndarray, categories: Sequence[str]
) -> Chain:
    """Fit each category on the features that every row holds (``columns`` of ``rows``) and on the earlier categories."""
    n, k = y.shape
    weights, links, bias, thresholds = np.zeros((k, len(features))), np.zeros((k, k)), np.full(k, -20.0), np.full(k, 0.5)
    earlier = np.zeros((0, n))
    for c in range(k):
        def fit(use: np.ndarray) -> np.ndarray:
            number = np.cumsum(use) - 1
            own = use[rows]
            return _fit_linear(columns[own], number[rows[own]], earlier[:, use], y[use, c], len(features))

        def predict(x: np.ndarray) -> np.ndarray:
            z = np.bincount(rows, weights=x[columns], minlength=n) if len(columns) else np.zeros(n)
            return _sigmoid(z + x[len(features) : -1] @ earlier + x[-1])

        whole = fit(np.ones(n, bool))
        weights[c], links[c, :c], bias[c] = whole[: len(features)], whole[len(features) : -1], whole[-1]
        out_of_fold = np.zeros(n)
        for f in range(FOLDS):
            if (fold != f).any():
                out_of_fold[fold == f] = predict(fit(fold != f))[fold == f]
        thresholds[c] = _threshold(out_of_fold, y[:, c])
        earlier = np.vstack([earlier, out_of_fold - 0.5])
    return Chain(tuple(categories), features, weights, links, bias, thresholds)


def labelled_sample(docs: DataFrame, labels: DataFrame, categories: Sequence[str]) -> DataFrame:
    """Labels and distinct features of at most ``SAMPLE`` labelled documents that have a text, the first by hash of doc_id.

    Of several label rows of a doc_id the largest counts; rows that lack a
    category's label are left out. Features come from the whole text, however long,
    in Spark tasks. Copies count once, see ``fit_chain``. The ids are bounded by
    ``SAMPLE``, hence broadcast.
    """
    one = labels.groupBy("doc_id").agg(*[F.max(c).alias(c) for c in categories]).dropna()
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    first = one.join(texts.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    found = texts.join(F.broadcast(first), "doc_id").dropDuplicates(["doc_id"])

    def work(block: list[str]) -> list[pa.Array]:
        hashes, bounds = text_features(block)
        own = [hashes[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        low = np.array([_two_lowest(o) for o in own], np.uint64).view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(hashes.view(np.int64)))
        return [lists, pa.array(low[:, 0]), pa.array(low[:, 1]), pa.array([_fold(o) for o in own], pa.int32())]

    kinds = {"__features": T.ArrayType(T.LongType()), "__low": T.LongType(), "__mixed": T.LongType(), "__fold": T.IntegerType()}
    stored = write_once(map_texts(found, "text", kinds, lambda: work, ["doc_id", *categories]), "labelled-sample")
    fresh = stored.groupBy(*categories, "__low", "__mixed").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    return stored.join(F.broadcast(fresh), "doc_id", "left_semi")


def marked_features(sample: DataFrame, categories: Sequence[str]) -> np.ndarray:
    """The sorted features that ``_marked`` would find, counted in Spark; at most ``FEATURES`` per category are collected."""
    sums = [F.sum(F.col(c).cast("double")).alias(c) for c in categories]
    total = sample.agg(F.count("*").alias("__n"), *sums).first()
    each = sample.select(*categories, F.explode("__features").alias("__feature"))
    each = each.groupBy("__feature").agg(F.count("*").cast("double").alias("__n"), *sums)
    each = write_once(each.where(F.col("__n") >= LEAST_TEXTS), "feature-counts")
    n, found = float(total["__n"]), []
    for category in categories:
        n1 = total[category]
        if not n or not 0 < n1 < n:
            continue
        a, b = F.col(category), F.col("__n") - F.col(category)
        c, d = F.lit(n1) - a, F.lit(n - n1) - b
        odd, even = a * d - b * c, (a + b) * (c + d) * F.lit(n1) * F.lit(n - n1)
        chi2 = F.lit(n) * (odd * odd) / F.greatest(even, F.lit(1.0))
        unsigned = F.col("__feature").bitwiseXOR(F.lit(-(1 << 63)))
        rows = each.select("__feature", chi2.alias("__chi2")).where(F.col("__chi2") >= LEAST_CHI2)
        found += [row[0] for row in rows.orderBy(F.desc("__chi2"), unsigned).limit(FEATURES).collect()]
    return np.unique(np.array(found, np.int64).view(np.uint64))


def fit_toxicity(docs: DataFrame, labels: DataFrame, categories: Sequence[str]) -> Chain:
    """Fit a chain on the labelled sample, as ``fit_chain`` would; the driver gets features and weights only.

    Texts are read and features counted in Spark tasks. The one task that fits the
    models holds the positions of the kept features in each row: at most ``SAMPLE``
    rows with ``FEATURES`` per category, whatever the texts' lengths.
    """
    names = list(categories)
    sample = labelled_sample(docs, labels, names)
    features = marked_features(sample, names)
    kept = ["doc_id", *names, "__fold"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 100):
                part = batch.slice(first, 100)
                lists = part.column("__features")
                hashes = lists.flatten().to_numpy().view(np.uint64)
                held, columns = _places(features, hashes)
                bounds = lists.offsets.to_numpy()
                bounds = np.concatenate([[0], np.cumsum(held)])[bounds - bounds[0]]
                own = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(columns.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + [own], names=[*kept, "__columns"])

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id")
        owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(c) for c in rows["__columns"]])
        y, fold = rows[names].to_numpy().astype(float), rows["__fold"].to_numpy()
        chain = _fit_categories(np.concatenate(rows["__columns"].tolist()), owner, y, fold, features, names)
        return pd.DataFrame(
            {
                "category": np.arange(len(names)),
                "weights": list(chain.weights),
                "links": list(chain.links),
                "bias": chain.bias,
                "threshold": chain.thresholds,
            }
        )

    placed = T.StructType([sample.schema[c] for c in kept] + [T.StructField("__columns", T.ArrayType(T.IntegerType()))])
    schema = "category int, weights array<double>, links array<double>, bias double, threshold double"
    fitted = sample.select(*kept, "__features").mapInArrow(place, placed).groupBy().applyInPandas(fit, schema)
    found = sorted(fitted.collect(), key=lambda r: r.category)
    if not found:
        return fit_chain([], np.zeros((0, len(names))), names)
    return Chain(
        tuple(names),
        features,
        np.array([r.weights for r in found]).reshape(len(names), -1),
        np.array([r.links for r in found]),
        np.array([r.bias for r in found]),
        np.array([r.threshold for r in found]),
    )


def score_toxicity(df: DataFrame, chain: Chain, text: str = "text", prefix: str = "p_", keep: list[str] | None = None) -> DataFrame:
    """Add the probability of each category as ``p_<category>`` (double).

    Every text is read whole; null counts as empty. Extra columns (or those in
    ``keep``) stay, columns named like the added ones are replaced. The chain (at most
    a few thousand weights per category) goes with the task: no join, no shuffle.
    """
    targets = {prefix + c: T.DoubleType() for c in chain.categories}
    return map_texts(df, text, targets, lambda: lambda texts: [pa.array(p) for p in chain.probabilities(texts)], keep)


def document_toxicity(docs: DataFrame, labels: DataFrame, categories: Sequence[str], keep: list[str] | None = None) -> DataFrame:
    """Score all documents with a chain fitted on the labelled ones.

    Adds ``p_<category>`` and ``is_toxic``: the last category's probability
    reaches the threshold that was best on out-of-fold predictions. Without
    labelled rows nothing is toxic.
    """
    chain = fit_toxicity(docs, labels, categories)
    scored = score_toxicity(docs, chain, keep=keep)
    return scored.withColumn("is_toxic", F.col(f"p_{categories[-1]}") >= float(chain.thresholds[-1]))
