"""Every operator and analysis as a query over the test tables.

A query is a function (spark, sf_dir) -> DataFrame. Dates are shown as text and
doubles rounded to six places, so that results compare across engines.
"""

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from slowtide.functions import text as X
from slowtide.functions.scorers import BatchClassifier, BatchEncoder, BatchPairScorer, LexicalEncoder, LexicalPairScorer, mock_vector
from slowtide.functions.vectors import affine, map_vector
from slowtide.operators import labels as L
from slowtide.operators import ordered, scoring, splitter, threads, windows
from slowtide.operators.extremes import extreme_rows
from slowtide.operators.models import apply_model, fit_pca, fit_sfa, series_moments
from slowtide.operators.moments import covariance_entries, moments
from slowtide.operators.sentences import explode_sentences
from slowtide.operators.slowness import label_gains, mean_label_gains, slowness, slowness_by_time_scale, with_label_order
from slowtide.operators.smoothing import smooth
from slowtide.operators.spectrum import amplitude_spectrum
from slowtide.plans import analyses
from slowtide.operators.scoring import Memo
from slowtide.plans.vocabulary import ANALYSIS_LABELS, label_table
from slowtide.session import fresh_path, write_once
from slowtide.sources import messages as S
from slowtide.sources import testbed
from slowtide.sources.score_table import ScoreTable, VectorTable
from slowtide.sources.testbed import LEXICON, LEXICON_LABELS, generated_lexicon

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def letter_key(word: Column) -> Column:
    """An integer from a word's first and last letters and its length; any SQL engine can compute it."""
    return F.ascii(word) + F.ascii(F.substring(word, -1, 1)) * 7 + F.length(word) * 31


ENCODER, ENCODER_2D = LexicalEncoder(16, letter_key), LexicalEncoder(2, letter_key)
#: As wide as the sentence encoder of the analyses.
ENCODER_384 = LexicalEncoder(384, letter_key)
SCORER, SCORER_69 = LexicalPairScorer(LEXICON), LexicalPairScorer(generated_lexicon(ANALYSIS_LABELS))
SENTENCE = ["msg_id", "sentence_idx"]


def show(df: DataFrame) -> DataFrame:
    """Dates as text, floating-point numbers to six places, ints as longs."""
    shown = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DateType, T.TimestampNTZType)):
            column = column.cast("string")
        elif isinstance(field.dataType, (T.FloatType, T.DoubleType)):
            # + 0.0 turns a negative zero into zero
            column = F.round(column.cast("double"), 6) + F.lit(0.0)
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType)):
            column = column.cast("long")
        shown.append(column.alias(field.name))
    return df.select(*shown)


def query(f: Query) -> Query:
    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return show(f(spark, sf_dir))

    QUERIES[f.__name__] = run
    return run


def long_vector(df: DataFrame, keys: list[str], vector: str | Column = "embedding") -> DataFrame:
    return df.select(*keys, F.posexplode(vector).alias("dim", "value"))


def user_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages where a thread opened by a system prompt counts as having no first message."""
    rows = testbed.messages(spark, sf_dir)
    return rows.withColumn("is_first_in_thread", F.col("is_first_in_thread") & ~F.col("author").startswith("system"))


def pairs_of_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector series with the sums of each half of a vector as its two dimensions, whose spectra have closed forms."""
    rows = testbed.vector_series(spark, sf_dir)
    half = lambda first: F.aggregate(
        F.slice(F.col("embedding").cast("array<double>"), first, 32), F.lit(0.0), lambda total, x: total + x
    )
    return rows.withColumn("embedding", F.array(half(1), half(33)))


def vector_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values as one-dimensional vectors, one series per event type."""
    return testbed.events(spark, sf_dir).withColumn("embedding", F.array(F.col("value").cast("float")))


# Sources


@query
def read_messages(spark, sf_dir):
    path = fresh_path(spark, "messages")
    S.write_messages(testbed.messages(spark, sf_dir), path)
    return S.read_messages(spark, path)


@query
def read_typed_messages(spark, sf_dir):
    path = fresh_path(spark, "messages")
    S.write_messages(user_threads(spark, sf_dir), path)
    return S.read_typed_messages(spark, path)


@query
def score_table_upsert(spark, sf_dir):
    """Every score stored twice; the later run replaces the earlier one's values."""
    table = ScoreTable(spark, fresh_path(spark, "scores"))
    texts = testbed.documents(spark, sf_dir).select("text", scoring.text_key(F.col("text")).alias("text_key")).distinct()
    scored = write_once(scoring.score_pairs(texts, SCORER, LEXICON_LABELS, "text").drop("text", "label_idx"), "scored")
    table.append(scored.withColumn("score", F.col("score") / 2), "lexical", "run-1")
    table.append(scored, "lexical", "run-2")
    stored = table.latest("lexical", LEXICON_LABELS)
    return stored.groupBy("label").agg(
        F.count(F.lit(1)).alias("num_texts"), F.sum(F.round(F.col("score").cast("double"), 6)).alias("total")
    )


@query
def vector_table_memo(spark, sf_dir):
    """Vectors of all documents through the vector table, twice; nothing is encoded twice."""
    docs = testbed.documents(spark, sf_dir)
    table = VectorTable(spark, fresh_path(spark, "vectors"))
    for run_id in ("run-1", "run-2"):
        found = scoring.memoised_embeddings(docs, ENCODER, table, "lexical", run_id, ["doc_id"], "text")
    by_dim = long_vector(found, ["doc_id"]).groupBy("dim").agg(
        F.count(F.lit(1)).alias("num_docs"), F.sum(F.round(F.col("value").cast("double"), 6)).alias("total")
    )
    return by_dim.withColumn("num_encoded", table.entries("lexical").agg(F.count(F.lit(1))).scalar())


# Filters, projections, lookups


@query
def filter_category_author(spark, sf_dir):
    rows = testbed.messages(spark, sf_dir)
    return rows.where((F.col("category") == "PracticeLogs") & (F.col("author") == "user_3")).select("msg_id", "date", "msg")


@query
def own_thread_messages(spark, sf_dir):
    rows = threads.by_thread_author(testbed.messages(spark, sf_dir), strict=True)
    return rows.select("msg_id", "thread_id", "author", "category", "date")


@query
def first_messages(spark, sf_dir):
    return testbed.messages(spark, sf_dir).where("is_first_in_thread").select("thread_id", "author")


@query
def messages_with_text(spark, sf_dir):
    return testbed.messages(spark, sf_dir).where(F.col("msg").isNotNull()).select("msg_id", "msg")


@query
def append_columns(spark, sf_dir):
    """Vector entries appended to their own row as scalar columns."""
    rows = testbed.vector_series(spark, sf_dir)
    return map_vector(rows, "embedding", lambda v: v, target="V", split=64).drop("date", "embedding")


@query
def thread_author_strict(spark, sf_dir):
    return threads.with_thread_author(testbed.messages(spark, sf_dir)).select("msg_id", "thread_id", "author", "thread_author")


@query
def thread_author_lenient(spark, sf_dir):
    return threads.with_thread_author(user_threads(spark, sf_dir), missing="n/a").select("msg_id", "thread_author")


@query
def threads_without_author(spark, sf_dir):
    return threads.threads_without_author(user_threads(spark, sf_dir))


# Score lookups: English documents play the cached part


def _pairs(spark, sf_dir):
    """Scored (document, label) pairs, stored."""
    docs = testbed.documents(spark, sf_dir)
    keyed = docs.select("doc_id", "lang", "text", scoring.text_key(F.col("text")).alias("text_key"))
    return write_once(scoring.score_pairs(keyed, SCORER, LEXICON_LABELS, "text").drop("text"), "pairs")


def _cache(pairs):
    return pairs.where("lang = 'en'").groupBy("text_key", "label").agg(F.max("score").alias("score"))


@query
def text_label_pairs(spark, sf_dir):
    """Every message with every analysis label and its hypothesis."""
    rows = scoring.pair_with_labels(testbed.messages(spark, sf_dir).select("msg_id", "msg"), ANALYSIS_LABELS)
    pair = F.md5(F.concat(F.col("msg"), X.hypothesis(F.col("label")))).alias("pair")
    return rows.select("msg_id", "label_idx", X.hypothesis(F.col("label")).alias("hypothesis"), pair)


@query
def score_cache_hits(spark, sf_dir):
    pairs = _pairs(spark, sf_dir)
    wanted = pairs.select("doc_id", "text_key", "label")
    return scoring.cache_hits(wanted, _cache(pairs), ["doc_id"]).select("doc_id", "label", "score")


@query
def score_cache_misses(spark, sf_dir):
    pairs = _pairs(spark, sf_dir)
    found = scoring.cache_misses(pairs, _cache(pairs))
    return found.groupBy("label").agg(F.count(F.lit(1)).alias("num_texts"))


@query
def score_reattach(spark, sf_dir):
    """Hits and freshly scored misses together give every input row its score."""
    pairs = _pairs(spark, sf_dir)
    hits = _cache(pairs)
    texts = scoring.distinct_texts(testbed.documents(spark, sf_dir), "text")
    missing = scoring.cache_misses(pairs, hits).join(texts, "text_key")
    fresh = write_once(missing.select("text_key", "label", SCORER.score(F.col("text"), F.col("label")).alias("score")), "fresh")
    found = scoring.attach_scores(pairs.drop("score"), hits, fresh, ["doc_id"])
    return found.select("doc_id", "label_idx", "score")


@query
def distinct_texts(spark, sf_dir):
    docs = testbed.documents(spark, sf_dir)
    return docs.select("lang", "text").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("num_texts"))


# Aggregates


@query
def messages_per_author(spark, sf_dir):
    return threads.category_author_counts(testbed.messages(spark, sf_dir))


@query
def vector_mean(spark, sf_dir):
    from slowtide.functions.vectors import vector_mean as mean

    rows = testbed.vector_series(spark, sf_dir).groupBy("series").agg(mean(F.col("embedding")).alias("embedding"))
    return long_vector(rows, ["series"])


@query
def vector_variance(spark, sf_dir):
    return ordered.dimension_variance(testbed.vector_series(spark, sf_dir))


@query
def vector_covariance(spark, sf_dir):
    return covariance_entries(moments(testbed.vector_series(spark, sf_dir))).select("series", "n", "i", "j", "covariance")


@query
def difference_covariance(spark, sf_dir):
    rows = series_moments(testbed.vector_series(spark, sf_dir), ["date", "row_id"], bounded=False)
    return covariance_entries(rows).where("kind = 'dx'").select("series", "n", "i", "j", "covariance")


# Text and scalars


@query
def document_sentences(spark, sf_dir):
    docs = testbed.documents(spark, sf_dir).select("doc_id", "text")
    return explode_sentences(docs, "text")


@query
def document_word_counts(spark, sf_dir):
    """What the learnt splitter counts: each word with and without a period, by case, and after periods."""
    counts = splitter.count_words(testbed.documents(spark, sf_dir))
    sums = {"dotted": F.col("end") == ".", "plain": F.col("end") != ".", "uppers": F.col("upper"), "lowers": F.col("lower"),
            "after_period": F.col("before_end") == "."}
    return counts.groupBy("type").agg(*[F.sum(F.when(c, F.col("n")).otherwise(0)).alias(name) for name, c in sums.items()])


@query
def document_sentences_learnt(spark, sf_dir):
    """T1 with abbreviations, starters and collocations learnt from all documents."""
    docs = testbed.documents(spark, sf_dir).select("doc_id", "text")
    return splitter.split_learnt(docs, splitter.learn_splitter(docs), ["doc_id"], "text")


@query
def message_sentences(spark, sf_dir):
    return explode_sentences(testbed.messages(spark, sf_dir).select("msg_id", "author", "msg"), abbreviations=("la.", "de."))


@query
def parse_dates(spark, sf_dir):
    """Dates as text, some unreadable: those become null."""
    rows = testbed.messages(spark, sf_dir)
    broken = F.when(F.col("msg").isNull(), "no date").otherwise(F.col("date").cast("string"))
    parsed = X.parse_timestamp(broken, strict=False)
    return rows.select("msg_id", parsed.alias("date"), parsed.cast("date").alias("day"))


@query
def event_epoch_days(spark, sf_dir):
    return testbed.events(spark, sf_dir).select(
        F.col("msg_id").alias("event_id"), F.col("date").cast("date").alias("day"), X.epoch_days(F.col("date")).alias("days")
    )


@query
def vector_softmax(spark, sf_dir):
    rows = testbed.vector_series(spark, sf_dir)
    return long_vector(rows.select("row_id", X.softmax(F.col("embedding").cast("array<double>")).alias("p")), ["row_id"], "p")


@query
def entailment_scores(spark, sf_dir):
    """The first three vector entries as contradiction, neutral and entailment logits."""
    rows = testbed.vector_series(spark, sf_dir)
    score = X.entailment_score(F.get("embedding", F.lit(2)) * 10, F.get("embedding", F.lit(0)) * 10)
    return rows.select("row_id", score.alias("score"))


@query
def label_lookup(spark, sf_dir):
    rows = testbed.table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("label_idx"))
    return rows.join(label_table(spark, LEXICON_LABELS), "label_idx").select("vec_id", "label")


# Time windows and ordered rows


def _grid(spark, sf_dir, every, period=None):
    pooled = windows.pool_windows(vector_events(spark, sf_dir), every, period)
    return pooled.select("series", "window_start", "n", F.get("embedding", F.lit(0)).alias("value"))


@query
def tumbling_windows(spark, sf_dir):
    return _grid(spark, sf_dir, "1d")


@query
def sliding_windows(spark, sf_dir):
    return _grid(spark, sf_dir, "1d", "1w")


@query
def sliding_windows_uneven(spark, sf_dir):
    """A period that is no multiple of the step."""
    return _grid(spark, sf_dir, "2d", "5d")


@query
def weekly_windows(spark, sf_dir):
    return _grid(spark, sf_dir, "1w")


@query
def time_scale_grids(spark, sf_dir):
    pooled = windows.time_scale_means(vector_events(spark, sf_dir))
    return pooled.select("series", "days", "window_start", "n", F.get("embedding", F.lit(0)).alias("value"))


@query
def pooled_vectors(spark, sf_dir):
    pooled = windows.pool_windows(testbed.vector_series(spark, sf_dir), "1d", "1w")
    return long_vector(pooled, ["series", "window_start", "n"])


@query
def window_texts(spark, sf_dir):
    return windows.join_texts(testbed.messages(spark, sf_dir), "1w", series=["author"])


@query
def sliding_window_texts(spark, sf_dir):
    return windows.join_texts(testbed.messages(spark, sf_dir), "1d", "3d", series=["category"])


@query
def vector_differences(spark, sf_dir):
    rows = ordered.consecutive_differences(testbed.vector_series(spark, sf_dir), ["date", "row_id"])
    return long_vector(rows, ["series", "row_id"], "diff")


@query
def slowness_per_dimension(spark, sf_dir):
    rows = ordered.consecutive_differences(testbed.vector_series(spark, sf_dir), ["date", "row_id"])
    return ordered.dimension_slowness(rows)


# Sorting and extremes


@query
def messages_by_date(spark, sf_dir):
    rows = testbed.messages(spark, sf_dir).select("msg_id", "date", "author")
    return rows.orderBy("date", "msg_id")


@query
def first_windows(spark, sf_dir):
    pooled = windows.pool_windows(vector_events(spark, sf_dir), "1h")
    firsts = ordered.first_rows(pooled, 100, ["window_start"])
    return firsts.select("series", "window_start", "n", F.get("embedding", F.lit(0)).alias("value"))


@query
def extreme_vectors(spark, sf_dir):
    rows = testbed.vector_series(spark, sf_dir)
    return extreme_rows(rows, "embedding", 10, ["row_id"], ["row_id"], ["series"])


# Models on two dimensions, where the results have closed forms


def _pca_2d(spark, sf_dir, keep=2):
    return fit_pca(moments(pairs_of_dims(spark, sf_dir)), keep)


def _sfa_2d(spark, sf_dir, keep=None, bounded=False):
    rows = series_moments(pairs_of_dims(spark, sf_dir), ["date", "row_id"], bounded=bounded)
    return fit_sfa(rows, 2, keep)


@query
def pca_of_pairs(spark, sf_dir):
    model = _pca_2d(spark, sf_dir)
    shares = L.explained_variance(model)
    return L.weights(model).join(shares, ["series", "component"]).select("series", "component", "label_idx", "weight", "ratio", "retained")


@query
def pca_fraction_of_pairs(spark, sf_dir):
    """How many components exceed a share of the variance."""
    models = [_pca_2d(spark, sf_dir, keep).select("series", F.lit(keep).alias("keep"), "n_retained") for keep in (0.4, 0.99)]
    return models[0].unionByName(models[1])


@query
def pca_columns_of_pairs(spark, sf_dir):
    rows = pairs_of_dims(spark, sf_dir)
    return analyses.add_pca_columns(rows, 2, ["row_id"]).select("series", "row_id", "PCA_0", "PCA_1")


@query
def affine_map_of_pairs(spark, sf_dir):
    """A fixed affine map of two dimensions to two, split into columns."""
    rows = pairs_of_dims(spark, sf_dir)
    matrix = F.array(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(-0.5), F.lit(3.0)))
    centre = F.array(F.lit(0.1), F.lit(0.2))
    mapped = map_vector(rows, "embedding", lambda v: affine(v, matrix, centre), target="Y", split=2)
    return mapped.select("row_id", "Y_0", "Y_1")


@query
def sfa_of_pairs(spark, sf_dir):
    model = _sfa_2d(spark, sf_dir)
    deltas = L.component_values(model, "deltas", "delta")
    return L.weights(model).join(deltas, ["series", "component"]).select("series", "component", "label_idx", "weight", "delta")


@query
def sfa_columns_of_pairs(spark, sf_dir):
    models = write_once(_sfa_2d(spark, sf_dir), "sfa")
    rows = apply_model(pairs_of_dims(spark, sf_dir), models, ["row_id"], target="SFA", split=2)
    return rows.select("series", "row_id", "SFA_0", "SFA_1")


@query
def slowness_of_pairs(spark, sf_dir):
    return slowness(pairs_of_dims(spark, sf_dir), 2, order=["date", "row_id"], bounded=False)


@query
def time_scale_slowness_of_pairs(spark, sf_dir):
    return slowness_by_time_scale(pairs_of_dims(spark, sf_dir))


@query
def time_scale_slowness_of_events(spark, sf_dir):
    return slowness_by_time_scale(vector_events(spark, sf_dir))


@query
def single_label_gain(spark, sf_dir):
    """With one label every order is the same: its gain is 2 minus its slowness."""
    daily = windows.pool_windows(vector_events(spark, sf_dir), "1d")
    return mean_label_gains(label_gains(daily, 1, 10), label_table(spark, ["value"]))


@query
def label_gains_telescope(spark, sf_dir):
    """Gains of one iteration add up to 2 minus the slowness of all labels."""
    daily = windows.pool_windows(pairs_of_dims(spark, sf_dir), "1d")
    gains = label_gains(daily, 2, 20)
    return gains.groupBy("series", "iteration").agg(F.sum("delta_diff").alias("total_gain"))


@query
def amplitude_spectra(spark, sf_dir):
    """Hourly mean values per event type."""
    hour = windows.Span("1h").start_of(F.col("date")).alias("window_start")
    hourly = testbed.events(spark, sf_dir).groupBy("series", hour).agg(F.avg("value").alias("value"))
    return _finite_period(amplitude_spectrum(hourly, "value"))


def _finite_period(found: DataFrame) -> DataFrame:
    """The period, with an infinite one as a flag of its own, which compares in any engine."""
    endless = F.col("period") == float("inf")
    return found.withColumns({"endless": endless, "period": F.when(~endless, F.col("period"))})


# Label analyses on given matrices: each series' mean vectors per label serve as matrix rows


def _given_matrix(spark, sf_dir, name="label"):
    rows = testbed.table(spark, sf_dir, "embeddings")
    vectors = rows.select(F.lit(0).alias("series"), F.col("label").alias("component"), F.posexplode("embedding").alias("label_idx", "v"))
    return vectors.groupBy("series", "component", "label_idx").agg(F.avg("v").alias("weight"))


@query
def matrix_label_weights(spark, sf_dir):
    found = L.ordered_weights(_given_matrix(spark, sf_dir), label_table(spark, ANALYSIS_LABELS))
    return found.select("component", "position", "label", "weight")


@query
def matrix_product(spark, sf_dir):
    matrix = _given_matrix(spark, sf_dir)
    return L.multiply(matrix, matrix).select("component", "label_idx", "weight")


@query
def matrix_label_importance(spark, sf_dir):
    matrix = _given_matrix(spark, sf_dir)
    ratios = matrix.groupBy("series", "component").agg(F.sum(F.abs("weight")).alias("ratio"))
    return L.importance(matrix, ratios).select("label_idx", "importance")


@query
def matrix_temporal_importance(spark, sf_dir):
    matrix = _given_matrix(spark, sf_dir)
    deltas = matrix.groupBy("series", "component").agg((F.sum(F.abs("weight")) * 10).alias("delta"))
    variances = ordered.dimension_variance(
        testbed.vector_series(spark, sf_dir).select(F.lit(0).alias("series"), "embedding")
    )
    return L.temporal_importance(matrix, deltas, variances).select("label_idx", "importance", "variance")


# Scoring


@query
def message_embeddings(spark, sf_dir):
    return long_vector(testbed.messages(spark, sf_dir), ["msg_id"], ENCODER.encode(F.col("msg")))


@query
def label_vectors(spark, sf_dir):
    return long_vector(testbed.messages(spark, sf_dir), ["msg_id"], SCORER.scores(F.col("msg"), LEXICON_LABELS))


@query
def label_score_table(spark, sf_dir):
    sentences = explode_sentences(testbed.messages(spark, sf_dir)).select(*SENTENCE, "msg")
    return scoring.score_pairs(sentences, SCORER, LEXICON_LABELS).select(*SENTENCE, "label", "score")


@query
def memoised_scores(spark, sf_dir):
    """All documents scored through the table in two runs; the second finds everything stored."""
    docs = testbed.documents(spark, sf_dir)
    table = ScoreTable(spark, fresh_path(spark, "scores"))
    scoring.fill_scores(docs.where("lang = 'en'"), SCORER, LEXICON_LABELS, table, "lexical", "run-1", "text")
    scoring.fill_scores(docs, SCORER, LEXICON_LABELS, table, "lexical", "run-2", "text")
    found = scoring.memoised_label_vectors(docs, SCORER, LEXICON_LABELS, table, "lexical", "run-3", ["doc_id"], "text")
    runs = table.entries("lexical", LEXICON_LABELS).groupBy("label").agg(
        F.count_if(F.col("run_id") == "run-1").alias("scored_first"),
        F.count_if(F.col("run_id") == "run-2").alias("scored_second"),
        F.count_if(F.col("run_id") == "run-3").alias("scored_third"),
    )
    per_label = (
        long_vector(found, ["doc_id"])
        .groupBy(F.col("dim").alias("label_idx"))
        .agg(F.count(F.lit(1)).alias("num_docs"), F.sum(F.round(F.col("value").cast("double"), 6)).alias("total"))
        .join(label_table(spark, LEXICON_LABELS), "label_idx")
    )
    return per_label.join(runs, "label").drop("label_idx")


@query
def mock_embeddings(spark, sf_dir):
    rows = testbed.messages(spark, sf_dir).select("msg_id", mock_vector(F.col("msg_id"), 10).alias("embedding"))
    return long_vector(rows, ["msg_id"])


@query
def label_permutations(spark, sf_dir):
    """A seeded order of the labels for each document, by its doc_id."""
    docs = testbed.documents(spark, sf_dir).select(F.col("doc_id").alias("iteration"))
    orders = with_label_order(docs, len(LEXICON_LABELS))
    return orders.select("iteration", F.posexplode("label_order").alias("position", "label_idx"))


# Models behind the batch interfaces: small arithmetic ones, whose results any SQL engine can compute


def _letter_counts(letters: str):
    def load():
        import numpy as np

        return lambda texts: np.array([[t.lower().count(c) for c in letters] for t in texts], np.float32)

    return load


def _pair_logits():
    import numpy as np

    def predict(texts, hypotheses):
        pairs = zip(texts, hypotheses)
        return np.array([[t.count("e") / 8, len(h) / 10, t.count("a") / 8] for t, h in pairs], np.float32)

    return predict


@query
def batch_encoder_vectors(spark, sf_dir):
    """M2: vectors of all messages from a model that is called on batches."""
    encoder = BatchEncoder(_letter_counts("aeiou"), 100)
    return long_vector(testbed.messages(spark, sf_dir), ["msg_id"], encoder.encode(F.col("msg")))


@query
def batch_class_probabilities(spark, sf_dir):
    """M3: class probabilities of all messages; the model's logits are counts of letters."""
    classifier = BatchClassifier(_letter_counts("xyz"), 100)
    return long_vector(testbed.messages(spark, sf_dir), ["msg_id"], classifier.encode(F.col("msg")))


@query
def batch_pair_scores(spark, sf_dir):
    """M4 through the batch interface, for three labels."""
    scorer = BatchPairScorer(_pair_logits, 0, 2, 100)
    return long_vector(testbed.messages(spark, sf_dir), ["msg_id"], scorer.scores(F.col("msg"), ANALYSIS_LABELS[:3]))


@query
def memoised_analyses(spark, sf_dir):
    """Q4 and Q9 through one memo, twice each; the second time nothing is scored."""
    rows, path = testbed.messages(spark, sf_dir), fresh_path(spark, "memo")
    for run_id in ("first", "second"):
        memo = Memo(spark, path, "lexical", run_id)
        analyses.author_slowness(rows, ENCODER, memo=memo).count()
        analyses.slowness_gain_per_label(rows, SCORER, LEXICON_LABELS, 5, memo=memo).count()
    counts = [
        F.count_if(F.col("run_id") == "first").alias("scored_first"),
        F.count_if(F.col("run_id") == "second").alias("scored_second"),
    ]
    vectors = memo.vectors.entries("lexical").agg(*counts).withColumn("kind", F.lit("texts"))
    scores = memo.scores.entries("lexical", LEXICON_LABELS).agg(*counts).withColumn("kind", F.lit("pairs"))
    return vectors.unionByName(scores)


# Full width: equations that models over all 64 dimensions must satisfy


@query
def pca_restores_covariance(spark, sf_dir):
    """Sum of variance times the outer product of each component with itself."""
    model = write_once(fit_pca(moments(testbed.vector_series(spark, sf_dir)), 64), "pca")
    variances = L.component_values(model, "variances", "variance")
    weights = L.weights(model).select("series", "component", F.col("label_idx").alias("i"), "weight")
    others = weights.select("series", "component", F.col("i").alias("j"), F.col("weight").alias("other"))
    terms = weights.join(others, ["series", "component"]).join(variances, ["series", "component"])
    return terms.groupBy("series", "i", "j").agg(F.sum(F.col("variance") * F.col("weight") * F.col("other")).alias("covariance"))


@query
def sfa_restores_difference_covariance(spark, sf_dir):
    """From all slow features W and the covariance C: C Wᵗ diag(delta) W C is the covariance of the differences."""
    both = write_once(series_moments(testbed.vector_series(spark, sf_dir), ["date", "row_id"]), "moments")
    model = write_once(fit_sfa(both, 64, None), "sfa")
    entries = covariance_entries(both).where("kind = 'x'").select("series", "i", "j", "covariance")
    weights = L.weights(model).select("series", "component", F.col("label_idx").alias("j"), "weight")
    seen = write_once(
        weights.join(entries, ["series", "j"]).groupBy("series", "component", "i").agg(F.sum(F.col("weight") * F.col("covariance")).alias("v")),
        "seen",
    )
    terms = seen.join(seen.select("series", "component", F.col("i").alias("j"), F.col("v").alias("w")), ["series", "component"])
    terms = terms.join(L.component_values(model, "deltas", "delta"), ["series", "component"])
    return terms.groupBy("series", "i", "j").agg(F.sum(F.col("delta") * F.col("v") * F.col("w")).alias("covariance"))


# End-to-end analyses


@query
def practice_log_counts(spark, sf_dir):
    """Q1: posts of thread authors in their own practice-log threads."""
    return threads.own_thread_summary(testbed.messages(spark, sf_dir))


@query
def top_practice_log_authors(spark, sf_dir):
    """Q1 as reported: the ten busiest authors."""
    return threads.top_authors(threads.own_thread_summary(testbed.messages(spark, sf_dir), strict=True))


@query
def practice_logs_of_author(spark, sf_dir):
    """Q2."""
    return threads.practice_logs(testbed.messages(spark, sf_dir), "user_3", strict=True)


@query
def time_aggregated_logs(spark, sf_dir):
    """Q3 with weekly windows: pooled vectors."""
    pooled = analyses.time_aggregated_logs(testbed.messages(spark, sf_dir), ENCODER, "1w")
    return long_vector(pooled, ["author", "window_start", "n"])


@query
def time_aggregated_texts(spark, sf_dir):
    """Q3 with weekly windows: joined texts."""
    found = analyses.time_aggregated_logs(testbed.messages(spark, sf_dir), ENCODER, "1w", with_text=True)
    return found.select("author", "window_start", "n", "part", "msg")


@query
def author_slowness(spark, sf_dir):
    """Q4."""
    return analyses.author_slowness(testbed.messages(spark, sf_dir), ENCODER)


@query
def slow_features(spark, sf_dir):
    """Q5 with a 384-dimensional encoder."""
    found = analyses.slow_features(testbed.messages(spark, sf_dir), ENCODER_384)
    return found.select("author", "window_start", "n", "SFA_0", "SFA_1", "SFA_2")


@query
def typical_sentences(spark, sf_dir):
    """Q6."""
    return analyses.typical_sentences(testbed.messages(spark, sf_dir), ENCODER)


def _analysis(spark, sf_dir):
    # lexical scores vary less than a model's: the cutoff is a share of the variance
    return analyses.SlownessAnalysis(testbed.messages(spark, sf_dir), SCORER_69, ANALYSIS_LABELS, cutoff_mode="ratio")


REPORTS = [
    "deltas", "pca_sentences", "sfa_sentences", "whitened_sentences", "label_weights_of_pca", "label_weights_of_sfa",
    "pca_weights_in_sfa", "whitening_weights", "label_importance", "temporal_importance", "explained_variance",
    "explained_variance_of_sfa", "curves", "spectra",
]


def _report(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = getattr(_analysis(spark, sf_dir), name)()
        if "period" in found.columns:
            found = _finite_period(found)
        return show(found)

    run.__doc__ = f"Q7: report {name} of the slowness analysis, all 69 labels."
    return run


QUERIES.update({f"slowness_analysis_{name}": _report(name) for name in REPORTS})


@query
def slowness_over_time_scales(spark, sf_dir):
    """Q8 with a 384-dimensional encoder."""
    return analyses.slowness_over_time_scales(testbed.messages(spark, sf_dir), ENCODER_384)


@query
def slowness_gain_per_label(spark, sf_dir):
    """Q9 with 1000 orders of ten labels."""
    return analyses.slowness_gain_per_label(testbed.messages(spark, sf_dir), SCORER, LEXICON_LABELS)


# The same analyses with all words hashed to two places: closed forms again


@query
def author_slowness_of_two_places(spark, sf_dir):
    """Q4 with a two-dimensional encoder."""
    return analyses.author_slowness(testbed.messages(spark, sf_dir), ENCODER_2D)


@query
def slow_features_of_two_places(spark, sf_dir):
    """Q5 with a two-dimensional encoder, weekly windows at daily steps."""
    found = analyses.slow_features(testbed.messages(spark, sf_dir), ENCODER_2D, keep=None, n_components=2)
    return found.select("author", "window_start", "n", "SFA_0", "SFA_1")


@query
def typical_sentences_of_two_places(spark, sf_dir):
    """Q6 with a two-dimensional encoder."""
    return analyses.typical_sentences(testbed.messages(spark, sf_dir), ENCODER_2D)


@query
def time_scale_slowness_of_two_places(spark, sf_dir):
    """Q8 with a two-dimensional encoder."""
    return analyses.slowness_over_time_scales(testbed.messages(spark, sf_dir), ENCODER_2D)


@query
def label_gains_of_two_labels(spark, sf_dir):
    """Q9 with two labels: mean gains add up to 2 minus the slowness of both."""
    gains = analyses.slowness_gain_per_label(testbed.messages(spark, sf_dir), SCORER, LEXICON_LABELS[:2], 50)
    return gains.groupBy("author").agg(F.sum("mean_delta_diff").alias("total_gain"))


def _two_label_analysis(spark, sf_dir):
    return analyses.SlownessAnalysis(
        testbed.messages(spark, sf_dir), SCORER, LEXICON_LABELS[:2], cutoff=0.0, n_pca=2, n_sfa=2
    )


@query
def two_label_explained_variance(spark, sf_dir):
    """Q7 with two labels: variance shares."""
    return _two_label_analysis(spark, sf_dir).explained_variance()


@query
def two_label_weights_of_pca(spark, sf_dir):
    """Q7 with two labels: ordered label weights of the principal components."""
    return _two_label_analysis(spark, sf_dir).label_weights_of_pca()


@query
def two_label_importance(spark, sf_dir):
    """Q7 with two labels: label importance."""
    return _two_label_analysis(spark, sf_dir).label_importance()


@query
def two_label_deltas(spark, sf_dir):
    """Q7 with two labels: slowness of the slow features of the training windows."""
    return _two_label_analysis(spark, sf_dir).deltas()


@query
def two_label_pca_weights_in_sfa(spark, sf_dir):
    """Q7 with two labels: weights of the principal components in the slow features, as directions of length 1."""
    found = _two_label_analysis(spark, sf_dir).pca_weights_in_sfa()
    length = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(W.partitionBy("author", "component")))
    return found.withColumn("weight", F.coalesce(F.col("weight") / F.nullif(length, F.lit(0.0)), F.lit(0.0)))


@query
def slowness_gain_of_all_labels(spark, sf_dir):
    """Q9 with all 69 labels and 1000 orders."""
    return analyses.slowness_gain_per_label(testbed.messages(spark, sf_dir), SCORER_69, ANALYSIS_LABELS)


@query
def label_scores_of_all_labels(spark, sf_dir):
    """Q11 with all 69 labels."""
    rows = testbed.messages(spark, sf_dir)
    table = ScoreTable(spark, fresh_path(spark, "scores"))
    found = scoring.memoised_label_vectors(rows, SCORER_69, ANALYSIS_LABELS, table, "lexical", "run-1", ["msg_id"])
    return long_vector(found, ["msg_id"])


@query
def score_rows_after_upserts(spark, sf_dir):
    """Every score stored in twelve runs of falling value; readers get the last one's."""
    table = ScoreTable(spark, fresh_path(spark, "scores"))
    keyed = scoring.distinct_texts(testbed.messages(spark, sf_dir))
    scored = write_once(scoring.score_pairs(keyed, SCORER, LEXICON_LABELS[:2], "text").select("text_key", "label", "score"), "scored")
    for run in range(1, 13):
        table.append(scored.withColumn("score", F.col("score") + 13 - run), "lexical", f"run-{run}")
    rows = table.latest("lexical", LEXICON_LABELS[:2]).join(keyed, "text_key")
    return rows.select(F.md5("text").alias("text_md5"), "label", "score")


@query
def collection_profile(spark, sf_dir):
    """Q10."""
    return threads.collection_profile(testbed.messages(spark, sf_dir), "user_3")


@query
def category_top_authors(spark, sf_dir):
    """Q10: the ten busiest writers of the category, in anybody's threads."""
    return threads.top_authors(threads.category_author_counts(testbed.messages(spark, sf_dir)))


@query
def weekly_authors_sketched(spark, sf_dir):
    """A3, approximate: distinct authors per week and category, merged from stored daily sketches."""
    rows = testbed.messages(spark, sf_dir).withColumn("day", F.col("date").cast("date"))
    daily = write_once(threads.author_sketches(rows, ["category", "day"]), "author-sketches")
    weekly = threads.distinct_authors(daily.withColumn("week", F.date_trunc("week", "day")), ["category", "week"])
    return weekly.select("category", F.date_format("week", "yyyy-MM-dd").alias("week"), "num_authors")


@query
def memoised_label_scores(spark, sf_dir):
    """Q11: label scores of all messages through the score table."""
    rows = testbed.messages(spark, sf_dir)
    table = ScoreTable(spark, fresh_path(spark, "scores"))
    found = scoring.memoised_label_vectors(rows, SCORER, LEXICON_LABELS, table, "lexical", "run-1", ["msg_id"])
    return long_vector(found, ["msg_id"])


@query
def smoothed_events(spark, sf_dir):
    """Daily mean event values, smoothed."""
    pooled = windows.pool_windows(vector_events(spark, sf_dir), "1d")
    return smooth(pooled.withColumn("value", F.get("embedding", F.lit(0)) / 100), "value")


@query
def smoothed_hours(spark, sf_dir):
    """Hourly mean event values, smoothed: more rows than waves."""
    pooled = windows.pool_windows(vector_events(spark, sf_dir), "1h")
    return smooth(pooled.withColumn("value", F.get("embedding", F.lit(0)) / 100), "value")


@query
def smoothed_pairs(spark, sf_dir):
    """Daily mean event values, each two days a series of their own, smoothed at a fixed length scale."""
    pooled = windows.pool_windows(vector_events(spark, sf_dir), "1d")
    block = F.expr("datediff(cast(window_start as date), date '1970-01-01') div 2")
    rows = pooled.withColumns({"value": F.get("embedding", F.lit(0)) / 100, "block": block.cast("long")})
    return smooth(rows, "value", series=["series", "block"], bounds=(10.0, 10.0))
