"""Sentences by a splitter learnt from the texts themselves, without labels.

A period ends a sentence unless its word is an abbreviation. Which words are, shows in
counts over a corpus (Kiss & Strunk, "Unsupervised multilingual sentence boundary
detection", 2006): an abbreviation hardly occurs without its period, is short, and may
have periods inside. Words that often follow sentence ends (starters), pairs held together over
a period (collocations, such as numbers with what they count), and the case in
which words occur elsewhere settle the rest.

Learning is one scan of the texts to a table of counts by word and neighbour; likelihood
ratios are columns over that table. Splitting looks decisions up per distinct pair of words around
a period, and only periods that end no sentence travel back to their texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slowtide.operators.skew import BROADCAST_BYTES, join_null_safe, lookup_join
from slowtide.session import write_once

#: Fixed values of the method: least scores of abbreviations, collocations and starters, and the share of an
#: abbreviation's occurrences that have their period.
ABBREVIATION, COLLOCATION, STARTER = 0.3, 7.88, 30.0
CERTAIN = 0.99
NUMBER = "##number##"
_OPENING, _CLOSING = r"""^["'(\[{]+""", r"""["')\]},;:]+$"""
_BREAK = "\u0001"
_WHITE = " \t\n\u000b\f\r"


def _begins(word: str, marks: str) -> Column:
    """Whether a word may begin with one of the marks."""
    return F.contains(F.lit(marks), F.substring(word, 1, 1))


def _ends(word: str, marks: str) -> Column:
    """Whether a word may end with one of the marks, for a pattern's ``$`` also before a line end that is no white space."""
    return F.contains(F.lit(marks + "\u0085\u2028\u2029"), F.substring(word, -1, 1))


def with_token(rows: DataFrame, word: str, name: str) -> DataFrame:
    """Add the token ``name`` of a column's words: ``type`` (lower case, without its end mark), ``end`` (a period, another mark,
    or none), ``upper``, ``lower``.

    Each step is a column of its own, so that it is computed once, and patterns meet only words whose ends they may match.
    """
    opened = F.when(_begins(word, "\"'([{"), F.regexp_replace(word, _OPENING, "")).otherwise(F.col(word))
    closed = F.when(_ends("__open", "\"')]},;:"), F.regexp_replace("__open", _CLOSING, "")).otherwise(F.col("__open"))
    core, marked = F.col("__core"), F.col("__marked")
    bare = F.lower(F.when(marked, F.regexp_replace(core, r"[.!?]+$", "")).otherwise(core))
    end = F.when(marked & core.rlike(r"[!?]$|\.\.$"), "!").when(core.endswith("."), ".").otherwise("")
    number = _begins("__bare", "+-0123456789") & F.col("__bare").rlike(r"^[-+]?[0-9][0-9.,]*$")
    kind = F.when(number, NUMBER).otherwise(F.col("__bare"))
    first = F.substring(core, 1, 1)
    upper, lower = first != F.lower(first), first != F.upper(first)
    token = F.struct(kind.alias("type"), end.alias("end"), upper.alias("upper"), (lower & ~upper).alias("lower"))
    steps = {"__open": opened, "__core": closed, "__marked": _ends("__core", ".!?"), "__bare": bare, name: token}
    for column, value in steps.items():
        rows = rows.withColumn(column, value)
    return rows.drop("__open", "__core", "__marked", "__bare")


def count_words(texts: DataFrame, text: str = "text") -> DataFrame:
    """``type, end, upper, lower, before_end, before, n``: how often words occur, by case, end and what ends before them.

    ``before_end`` is the end mark of the word before (none in a text's first word: ``!``);
    ``before`` names that word if a period ends it. Words without letter or digit do not count. Words as
    written are counted first, in the tasks that read the texts, with the word before if it has a mark; only
    distinct ones are taken apart, and only sums are shuffled.
    """
    # without white space at its start a text has no empty word before another
    own = texts.where(F.col(text).isNotNull()).select(F.split(F.ltrim(F.col(text), F.lit(_WHITE)), r"\s+").alias("w"))
    none = F.array(F.lit(None).cast("string"))
    paired = F.arrays_zip(F.col("w").alias("word"), F.slice(F.concat(none, F.col("w")), 1, F.size("w")).alias("before"))
    each = own.select(F.explode(paired).alias("pair")).select("pair.word", "pair.before")
    before = F.col("before")
    # a word without a mark ends nothing, whatever it is; a text's first word has none before it (null)
    mark = F.contains(before, F.lit(".")) | F.contains(before, F.lit("!")) | F.contains(before, F.lit("?"))
    marked = F.when(before.isNull() | mark, before).otherwise("")
    written = each.select("word", marked.alias("marked")).groupBy("word", "marked").agg(F.count(F.lit(1)).alias("n"))
    # letters and digits are no marks: a word has some if its type has
    written = written.where(F.col("word").rlike(r"[\p{L}\p{N}]"))
    split = with_token(with_token(written, "word", "t"), "marked", "p")
    end = F.when(F.col("marked").isNull(), "!").otherwise(F.col("p.end"))
    return (
        split.select("t.*", end.alias("before_end"), F.when(F.col("p.end") == ".", F.col("p.type")).alias("before"), "n")
        .groupBy("type", "end", "upper", "lower", "before_end", "before")
        .agg(F.sum("n").alias("n"))
    )


def _times_log(n: Column, p: Column) -> Column:
    """n · ln p, zero for n = 0."""
    return F.when(n == 0, 0.0).otherwise(n * F.ln(p))


def abbreviation_score(kind: Column, dotted: Column, plain: Column, all_dotted: Column, total: Column) -> Column:
    """How much better a word's periods fit an abbreviation than chance, less for long words and for each lone occurrence."""
    seen, chance = dotted + plain, all_dotted / total
    by_chance = _times_log(dotted, chance) + _times_log(plain, 1 - chance)
    by_nature = dotted * F.ln(F.lit(CERTAIN)) + plain * F.ln(F.lit(1 - CERTAIN))
    inside = F.length(kind) - F.length(F.replace(kind, F.lit("."), F.lit("")))
    letters = (F.length(kind) - inside).cast("double")
    found = -2 * (by_chance - by_nature) * F.exp(-letters) * (inside + 1) * F.pow(letters, -plain)
    return F.when(seen > 0, found)


def pair_score(first: Column, second: Column, both: Column, total: Column) -> Column:
    """Log-likelihood ratio of two events' joint occurrence: ``both`` of ``first``, and of ``second`` in ``total``."""
    p, p1, p2 = second / total, both / first, (second - both) / (total - first)
    rest = total - first - second + both
    alone = _times_log(both, p) + _times_log(first - both, 1 - p) + _times_log(second - both, p) + _times_log(rest, 1 - p)
    joint = _times_log(both, p1) + _times_log(first - both, 1 - p1) + _times_log(second - both, p2) + _times_log(rest, 1 - p2)
    return -2 * (alone - joint)


@dataclass(frozen=True)
class SplitterModel:
    """Stored tables: what is known of each word, and pairs that a period does not part.

    ``types``: ``type, abbreviation, starter, upper_mid, upper_seen, lower_seen, lower_start``;
    ``collocations``: ``type, next_type``.
    """

    types: DataFrame
    collocations: DataFrame


def learn_splitter(texts: DataFrame, text: str = "text") -> SplitterModel:
    """Learn abbreviations, starters and collocations from the counts of all texts. No texts, no knowledge."""
    counts = write_once(count_words(texts, text), "word-counts")
    when = lambda condition, n=F.col("n"): F.sum(F.when(condition, n).otherwise(0))
    dotted = F.col("end") == "."
    by_type = counts.groupBy("type").agg(when(dotted).alias("dotted"), when(~dotted).alias("plain"))
    totals = by_type.agg(F.sum("dotted").alias("all_dotted"), F.sum(F.col("dotted") + F.col("plain")).alias("total"))
    # one row
    scored = by_type.crossJoin(F.broadcast(totals))
    letters = F.col("type").rlike(r"\p{L}")
    score = abbreviation_score(F.col("type"), F.col("dotted"), F.col("plain"), F.col("all_dotted"), F.col("total"))
    scored = scored.withColumn("abbreviation", (F.col("dotted") > 0) & letters & F.coalesce(score >= ABBREVIATION, F.lit(False)))
    known = write_once(scored, "word-types")

    # words after a period: at a sentence start unless the word before is an abbreviation
    short = known.where("abbreviation").select(F.col("type").alias("before"), F.lit(True).alias("short"))
    after = counts.where(F.col("before_end") == ".").join(short, "before", "left")
    start = (F.col("before_end") == "!") | ((F.col("before_end") == ".") & F.col("short").isNull())
    placed = counts.where(F.col("before_end") != ".").withColumn("short", F.lit(None).cast("boolean")).unionByName(after)
    middle = F.col("before_end") == ""
    # a single letter or a number before the period says little about what follows
    clear = start & (F.col("before_end") == ".") & (F.length("before") > 1) & (F.col("before") != NUMBER)
    cases = placed.groupBy("type").agg(
        when(F.col("upper") & middle).alias("upper_mid"),
        when(F.col("upper")).alias("upper_seen"),
        when(F.col("lower")).alias("lower_seen"),
        when(F.col("lower") & start).alias("lower_start"),
        when(clear).alias("begins"),
    )
    ends = placed.agg(F.coalesce(when(clear), F.lit(0)).alias("ends"))
    joined = known.join(cases, "type").crossJoin(F.broadcast(ends))
    seen = F.col("dotted") + F.col("plain")
    more = F.col("begins") * F.col("total") > seen * F.col("ends")
    usual = pair_score(F.col("ends"), seen, F.col("begins"), F.col("total")) >= STARTER
    starter = F.when((F.col("begins") > 0) & letters & (F.col("total") > F.col("ends")), more & usual).otherwise(False)
    flags = [(F.col(c) > 0).alias(c) for c in ("upper_mid", "upper_seen", "lower_seen", "lower_start")]
    types = write_once(joined.select("type", "abbreviation", starter.alias("starter"), *flags, seen.alias("seen"), "total"), "splitter-types")

    held = (F.length("before") == 1) | (F.col("before") == NUMBER)
    pairs = after.where(held).groupBy("before", "type").agg(F.sum("n").alias("both")).where(F.col("both") > 1)
    first = types.select(F.col("type").alias("before"), F.col("seen").alias("first"))
    pairs = pairs.join(types.where("not starter").select("type", F.col("seen").alias("second"), "total"), "type").join(first, "before")
    apart = F.col("total") * F.col("both") > F.col("first") * F.col("second")
    together = pair_score(F.col("first"), F.col("second"), F.col("both"), F.col("total")) >= COLLOCATION
    pairs = pairs.where((F.col("both") <= F.least("first", "second")) & apart & together)
    collocations = write_once(pairs.select(F.col("before").alias("type"), F.col("type").alias("next_type")), "splitter-pairs")
    return SplitterModel(types.drop("seen", "total"), collocations)


def no_breaks(pairs: DataFrame, model: SplitterModel) -> DataFrame:
    """Of pairs ``type, next_type, next_upper, next_lower`` around a period, those that it does not part."""
    here = model.types.select("type", "abbreviation")
    flags = ("starter", "upper_mid", "upper_seen", "lower_seen", "lower_start")
    there = model.types.select(F.col("type").alias("next_type"), *flags)
    held = model.collocations.withColumn("collocation", F.lit(True))
    known = pairs.join(here, "type", "left").join(there, "next_type", "left").join(held, ["type", "next_type"], "left")
    known = known.fillna(False, ["abbreviation", "collocation", *flags])
    upper, lower = F.col("next_upper"), F.col("next_lower")
    # the case of the next word: that of a sentence's first word, or not, or unclear
    opens = upper & F.col("lower_seen") & ~F.col("upper_mid")
    goes_on = lower & (F.col("upper_seen") | ~F.col("lower_start"))
    initial, number = F.length("type") == 1, F.col("type") == NUMBER
    initial = initial & F.col("type").rlike(r"\p{L}")
    short = F.col("abbreviation")
    kept_together = (
        F.when(F.col("collocation"), True)
        .when(short & ~initial, ~opens & ~(upper & F.col("starter")))
        .when(initial | number, (~opens & goes_on) | (initial & ~opens & upper & ~F.col("lower_seen")) | short)
        .otherwise(False)
    )
    return known.where(kept_together).select(*pairs.columns)


def _bytes(rows: DataFrame) -> int:
    """About the size of a small table in memory."""
    return rows.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*rows.columns))) + 64), F.lit(0))).first()[0]


def _may_hold(borders: DataFrame, model: SplitterModel, spread_by: list[str]) -> DataFrame:
    """Of periods behind words ``type``, those that ``no_breaks`` may hold together: behind abbreviations, initials, numbers, and firsts of collocations."""
    words = model.types.where("abbreviation").select("type").union(model.collocations.select("type")).distinct()
    words = write_once(words.withColumn("holds", F.lit(True)), "holding-words")
    looked = lookup_join(borders, words, ["type"], spread_by, dim_bytes=_bytes(words), how="left")
    return looked.where(F.col("holds") | (F.length("type") == 1) | (F.col("type") == NUMBER)).drop("holds")


def split_learnt(df: DataFrame, model: SplitterModel, key: list[str], text: str = "msg") -> DataFrame:
    """One row per sentence by the learnt model, the other columns repeated, with its position ``sentence_idx``.

    ``key`` tells rows apart. A sentence may end after ``.``, ``!`` or ``?`` (with closing quotes or
    brackets) followed by white space; one period of a word ends it unless the
    model holds the words around together. Sentences are trimmed; texts without any, or
    null, give no row. U+0001 counts as a blank.
    """
    clean = F.replace(F.col(text), F.lit(_BREAK), F.lit(" "))
    texts = df.where(F.col(text).isNotNull())
    parts = F.split(F.regexp_replace(clean, r"""([.!?]+["')\]]*\s+)""", "$1" + _BREAK), _BREAK)
    # the same parts without white space around the breaks
    bare = F.split(F.regexp_replace(clean, r"""([.!?]+["')\]]*)\s+""", "$1" + _BREAK), _BREAK)
    last = F.element_at(F.split(F.substring_index("part", " ", -1), r"\s+"), -1)
    first = F.get(F.split(F.substring_index("next", " ", 1), r"\s+"), F.lit(0))
    each = texts.select(*[F.col(c).alias(f"__{c}") for c in key], bare.alias("parts"))
    following = F.slice("parts", 2, F.size("parts"))
    each = each.select(*[f"__{c}" for c in key], F.posexplode(F.arrays_zip(F.col("parts").alias("part"), following.alias("next"))).alias("at", "two"))
    each = each.select(*[f"__{c}" for c in key], "at", "two.part", "two.next").where(F.col("next").isNotNull())
    each = each.select(*[F.col(f"__{c}").alias(c) for c in key], "at", last.alias("__last"), first.alias("__first"))
    # exploded, not filtered: a filter would move below and take each word apart twice
    ended = F.when((F.col("a.end") == ".") & (F.col("__first") != ""), F.array("a.type"))
    each = with_token(each, "__last", "a").select(*key, "at", "__first", F.explode(ended).alias("type"))
    each = with_token(_may_hold(each, model, [*key, "at"]), "__first", "b")
    each = each.select(
        *key, "at", "type", F.col("b.type").alias("next_type"), F.col("b.upper").alias("next_upper"), F.col("b.lower").alias("next_lower")
    )
    each = write_once(each, "borders")
    pair = ["type", "next_type", "next_upper", "next_lower"]
    kept = write_once(no_breaks(each.select(*pair).distinct(), model), "no-breaks")
    size = 64 * kept.count()
    joined = lookup_join(each, kept, pair, [*key, "at"], dim_bytes=size)
    held = write_once(joined.groupBy(*key).agg(F.collect_set("at").alias("__held")), "held")
    if _bytes(held) <= BROADCAST_BYTES:
        held = F.broadcast(held)
    whole = join_null_safe(texts, held, list(key), "left").withColumn("__parts", parts)
    part = lambda p, i: F.concat(p, F.when(F.array_contains("__held", i), "").otherwise(_BREAK))
    joined_text = F.array_join(F.transform("__parts", part), "")
    pieces = F.when(F.col("__held").isNull(), F.col("__parts")).otherwise(F.split(joined_text, _BREAK))
    sentences = F.transform(pieces, lambda s: F.btrim(s, F.lit(_WHITE)))
    sentences = F.filter(sentences, lambda s: s != "")
    others = [c for c in df.columns if c != text]
    return whole.select(*others, F.posexplode(sentences).alias("sentence_idx", text))
