"""Column expressions over text and time; all of them stay inside the JVM."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SENTENCE_END = r"""([.!?]+["')\]]*)\s+"""
_WHITE = " \t\n\u000b\f\r"
_BREAK = "\u0001"
_HELD_DOT = "\u0002"


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def split_sentences(text: Column, abbreviations: tuple[str, ...] = ()) -> Column:
    """Array of trimmed, non-empty sentences.

    A rule, not a trained model: a sentence ends after ``.``, ``!`` or ``?``
    (with closing quotes or brackets) followed by white space. The dot of a
    listed abbreviation does not end one. Results on prose differ in places
    from a trained splitter. The control characters U+0001 and U+0002 count as
    blanks.
    """
    # the two held characters must not occur in the text itself
    held = F.contains(text, F.lit(_BREAK)) | F.contains(text, F.lit(_HELD_DOT))
    text = F.when(held, F.translate(text, _BREAK + _HELD_DOT, "  ")).otherwise(text)
    if abbreviations:
        # longest first, so that "e.g." wins over "g."
        listed = "|".join(re.escape(a[:-1]) for a in sorted(abbreviations, key=len, reverse=True))
        text = F.regexp_replace(text, rf"(?<![\p{{L}}\p{{N}}])({listed})\.(?=\s)", "$1" + _HELD_DOT)
    marked = F.regexp_replace(text, SENTENCE_END, "$1" + _BREAK)
    parts = F.transform(F.split(marked, _BREAK), lambda s: F.btrim(s, F.lit(_WHITE)))
    if abbreviations:
        parts = F.transform(parts, lambda s: F.replace(s, F.lit(_HELD_DOT), F.lit(".")))
    return F.filter(parts, lambda s: s != "")


def parse_timestamp(text: Column, strict: bool = True) -> Column:
    """Text to a time-zone-free timestamp; bad text is an error, or null if not strict."""
    if strict:
        # ANSI or not, an unreadable value must not pass silently.
        parsed = text.try_cast("timestamp_ntz")
        complaint = F.concat(F.lit("unreadable date: "), text)
        return F.when(text.isNotNull() & parsed.isNull(), F.raise_error(complaint).cast("timestamp_ntz")).otherwise(parsed)
    return text.try_cast("timestamp_ntz")


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970-01-01 of a time-zone-free timestamp, whatever the session zone."""
    days = F.unix_date(ts.cast("date")).cast("long")
    seconds = F.date_part(F.lit("SECOND"), ts)
    return (
        days * 86_400_000_000
        + F.hour(ts).cast("long") * 3_600_000_000
        + F.minute(ts).cast("long") * 60_000_000
        + (seconds * 1_000_000).cast("long")
    )


def epoch_days(ts: Column) -> Column:
    """Fractional days since 1970-01-01."""
    return epoch_micros(ts) / F.lit(86_400_000_000.0)


def hypothesis(label: Column) -> Column:
    """The statement a zero-shot model is asked to judge."""
    return F.format_string("This example is %s.", label)


def softmax(logits: Column) -> Column:
    """Row-wise softmax of an array, shifted by its maximum."""
    powers = lambda l: bind(F.array_max(l), lambda top: F.transform(l, lambda x: F.exp(x - top)))
    total = lambda p: F.aggregate(p, F.lit(0.0), lambda acc, x: acc + x)
    shares = lambda p: bind(total(p), lambda t: F.transform(p, lambda x: x / t))
    return bind(logits, lambda l: bind(powers(l), shares))


def entailment_score(entailment: Column, contradiction: Column) -> Column:
    """Two-way softmax of entailment against contradiction, as a float.

    The exponent is never positive, so neither side overflows.
    """
    gap = (contradiction - entailment).cast("double")
    small = F.exp(-F.abs(gap))
    return F.when(gap <= 0, 1 / (1 + small)).otherwise(small / (1 + small)).cast("float")


def period_of_frequency(frequency: Column) -> Column:
    """1/f, infinite at zero."""
    return F.when(F.abs(frequency) < 1e-6, F.lit(float("inf"))).otherwise(1 / frequency)


def words(text: Column) -> Column:
    """The lower-case words of a text, in order."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")
