"""Scorers: text to vectors, or (text, label) to scores, as column expressions.

A scorer is anything with the methods of ``Encoder`` or ``PairScorer``. The
lexical ones need no model and run inside the JVM; the ``Batch`` ones wrap a
model that is loaded once per Python worker and called on batches of texts of
similar length, since a model pads a batch to its longest text.
"""

import uuid
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slowtide.functions.text import bind, entailment_score, hypothesis, softmax, words
from slowtide.functions.vectors import norm, scale

FLOATS = T.ArrayType(T.FloatType())


#: Characters of a padded batch (rows times the longest text); a longer text comes alone.
BUDGET = 1 << 18
#: Models that a worker keeps in memory.
MODELS = 4
_LOADED: dict[str, Callable] = {}


def length_batches(lengths: np.ndarray, batch_size: int, budget: int) -> list[np.ndarray]:
    """Row numbers of batches: rows by length, at most ``batch_size`` of them and ``budget`` padded characters each."""
    order = np.argsort(lengths, kind="stable")
    found, first = [], 0
    for at in range(1, len(order) + 1):
        # sorted: the row at hand would be the batch's longest
        full = at < len(order) and (at - first >= batch_size or (at - first + 1) * lengths[order[at]] > budget)
        if full or at == len(order):
            found.append(order[first:at])
            first = at
    return found


def padding_share(lengths: np.ndarray, batches: list[np.ndarray]) -> float:
    """The share of padded positions that hold no text."""
    padded = sum(len(b) * int(lengths[b].max()) for b in batches)
    return 1 - float(lengths.sum()) / padded if padded else 0.0


def loaded(key: str, make_predict_fn: Callable) -> Callable:
    """The worker's model of that name; of several models the last few stay in memory."""
    if key not in _LOADED:
        while len(_LOADED) >= MODELS:
            _LOADED.pop(next(iter(_LOADED)))
        _LOADED[key] = make_predict_fn()
    return _LOADED[key]


def _model_udf(make_predict_fn: Callable, batch_size: int, budget: int):
    """The model as a column function of one or more text columns.

    Rows of one Arrow batch go to the model by length and come back in their own order. Of
    several columns a batch is a tuple.
    """
    key = uuid.uuid4().hex

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        predict = loaded(key, make_predict_fn)
        for columns in batches:
            columns = [columns] if isinstance(columns, pd.Series) else columns
            texts = [c.to_numpy() for c in columns]
            lengths = sum(np.fromiter(map(len, t), np.int64, len(t)) for t in texts)
            found = np.empty(len(lengths), object)
            for rows in length_batches(lengths, batch_size, budget):
                for row, result in zip(rows, predict(*[t[rows] for t in texts])):
                    found[row] = np.asarray(result, np.float32)
            yield pd.Series(found)

    return F.pandas_udf(run, FLOATS).asNondeterministic()


class Encoder(Protocol):
    def encode(self, text: Column) -> Column:
        """Vector (array of float) of a text; null for null."""


class PairScorer(Protocol):
    def score(self, text: Column, label: Column) -> Column:
        """Score in (0, 1), as float, of how well a label fits a text; null for null."""

    def scores(self, text: Column, labels: list[str]) -> Column:
        """One independent score per label, in label order; null for null text."""


class BatchEncoder:
    """Sentence encoder: ``make_predict_fn`` returns a function from texts to an n × d array."""

    def __init__(self, make_predict_fn: Callable, batch_size: int = 1000, budget: int = BUDGET):
        self._predict = _model_udf(make_predict_fn, batch_size, budget)

    def encode(self, text: Column) -> Column:
        return F.when(text.isNotNull(), self._predict(F.coalesce(text, F.lit(""))))


class BatchClassifier:
    """Class probabilities: the model gives logits, the softmax is native."""

    def __init__(self, make_predict_fn: Callable, batch_size: int = 100, budget: int = BUDGET):
        self._logits = _model_udf(make_predict_fn, batch_size, budget)

    def encode(self, text: Column) -> Column:
        logits = self._logits(F.coalesce(text, F.lit(""))).cast("array<double>")
        return F.when(text.isNotNull(), softmax(logits).cast("array<float>"))


class BatchPairScorer:
    """Zero-shot model: logits of (text, hypothesis) pairs; positions of two classes are given."""

    def __init__(
        self,
        make_predict_fn: Callable,
        entailment_index: int,
        contradiction_index: int,
        batch_size: int = 100,
        budget: int = BUDGET,
    ):
        self._logits = _model_udf(make_predict_fn, batch_size, budget)
        self._entailment, self._contradiction = entailment_index, contradiction_index

    def score(self, text: Column, label: Column) -> Column:
        logits = self._logits(F.coalesce(text, F.lit("")), hypothesis(label))
        pick = lambda l, i: F.get(l, F.lit(i))
        fitted = bind(logits, lambda l: entailment_score(pick(l, self._entailment), pick(l, self._contradiction)))
        return F.when(text.isNotNull(), fitted)

    def scores(self, text: Column, labels: list[str]) -> Column:
        return F.when(text.isNotNull(), F.array(*[self.score(text, F.lit(x)) for x in labels]))


class LexicalPairScorer:
    """Zero-shot stand-in: the share of a text's words that are on the label's word list.

    The share s gives the logits ``sharpness``·s for entailment and
    ``sharpness``·(1 − s) for contradiction.
    """

    #: an expression as cheap as reading a stored score
    native = True

    def __init__(self, lists: dict[str, list[str]], sharpness: float = 4.0):
        self._lists, self._sharpness = lists, sharpness
        self._listed = sorted({w for listed in lists.values() for w in listed})

    def _words_of(self, label: str) -> Column:
        return F.array(*[F.lit(w) for w in self._lists[label]])

    def _fitted(self, hits: Column, total: Column, listed: Column) -> Column:
        count = F.size(F.filter(hits, lambda w: F.array_contains(listed, w)))
        return bind(
            count / F.greatest(total, F.lit(1)),
            lambda share: entailment_score(share * self._sharpness, (1 - share) * self._sharpness),
        )

    def _over(self, text: Column, use) -> Column:
        """``use(listed words, number of all words)``, with the text taken apart once."""
        listed = lambda w: F.filter(w, lambda x: x.isin(self._listed))
        taken = bind(words(text), lambda w: bind(listed(w), lambda hits: use(hits, F.size(w))))
        return F.when(text.isNotNull(), taken)

    def score(self, text: Column, label: Column) -> Column:
        by_label = F.create_map(*[c for name in self._lists for c in (F.lit(name), self._words_of(name))])
        chosen = F.try_element_at(by_label, label)
        fitted = lambda hits, total: bind(chosen, lambda listed: self._fitted(hits, total, listed))
        return F.when(chosen.isNotNull(), self._over(text, fitted))

    def scores(self, text: Column, labels: list[str]) -> Column:
        # one expression for all labels: the plan does not grow with their number
        lists = F.array(*[self._words_of(x) for x in labels])
        each = lambda hits, total: F.transform(lists, lambda listed: self._fitted(hits, total, listed))
        return self._over(text, each)


class LexicalEncoder:
    """Embedding stand-in: counts of words hashed to ``dims`` places, scaled to length 1.

    ``key`` turns a word into the integer whose remainder is its place.
    """

    native = True

    def __init__(self, dims: int = 16, key: Callable[[Column], Column] = F.xxhash64):
        self.dims, self._key = dims, key

    def encode(self, text: Column) -> Column:
        places = F.transform(words(text), lambda w: F.pmod(self._key(w), F.lit(self.dims)))
        counts = bind(F.array_sort(places), lambda s: bind(F.array_distinct(s), lambda u: self._counts(s, u)))
        # a text without words keeps the zero vector
        unit = bind(counts, lambda c: bind(F.greatest(norm(c), F.lit(1.0)), lambda n: scale(c, 1 / n)))
        return F.when(text.isNotNull(), unit.cast("array<float>"))

    def _counts(self, placed: Column, used: Column) -> Column:
        """How often each of the ``dims`` places occurs, from all sorted places and the distinct ones.

        Each used place gives the zeros before it and its run length: work for the
        words and the result, none per place and word.
        """
        zeros = lambda n: F.array_repeat(F.lit(0.0), n.cast("int"))
        start = lambda at: F.coalesce(F.array_position(placed, F.get(used, at)), F.size(placed) + 1)
        before = lambda at: F.coalesce(F.get(used, at - 1), F.lit(-1))
        part = lambda p, at: F.concat(zeros(p - before(at) - 1), F.array((start(at + 1) - start(at)).cast("double")))
        return F.concat(F.flatten(F.transform(used, part)), zeros(self.dims - 1 - before(F.size(used))))


def mock_vector(row_key: Column, dims: int = 10, seed: int = 0) -> Column:
    """Uniform [0, 1) entries, a function of (seed, row key, position) alone: 52 bits of an MD5 digest."""
    digest = lambda i: F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), row_key.cast("string"), i.cast("string"))), 1, 13)
    return F.transform(
        F.sequence(F.lit(0), F.lit(dims - 1)),
        lambda i: F.conv(digest(i), 16, 10).cast("double") / F.lit(float(1 << 52)),
    )
