"""Periodic runs of words: stretches that repeat with a period, found by Baier grouping.

Every maximal repetition has a Lyndon root: under the order of words, or under
its reverse, each of its full periods begins with the longest Lyndon word of that
place. The first phase of Baier's suffix sorting yields those words directly: it
takes the groups of equal beginnings from the highest down, and hangs each member
on the place left of it that is not yet taken; that place's beginning grows by as many
copies as hang there. When a group is taken, its beginning is the longest Lyndon word
of its members, and the copies that hang in a row are the repeated root. Roots
with enough copies are extended to both sides as far as the text agrees with itself
one period away.

A word inside a run of at least k periods occurs k times in it. Words that occur
less often in their stretch end it, again and again until nothing changes; only what
is left is grouped. No run is lost or cut by that.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slowtide.functions.text import bind
from slowtide.llm.codes import map_texts, offsets, spans

#: A run has at least so many periods and so many words.
LEAST_PERIODS, LEAST_WORDS = 4, 6
#: Fixed value: what stands between words, as a Java character class.
WHITE = r"[\x20\x09-\x0D]+"
_RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
Run = tuple[int, int, int]


def lyndon_roots(word: list[int], ranks: dict[int, int], least: int) -> list[tuple[int, int]]:
    """First places and lengths of the longest Lyndon words that stand ``least`` times in a row.

    The first phase of Baier's sort under the order that ``ranks`` gives the words.
    Places not yet taken are a linked list; a member's longest Lyndon word
    reaches to the next of them. The end of the text is smaller than any word.
    """
    n = len(word)
    # places -1 and n share the last entry, which belongs to no group
    left, right = [*range(-1, n)], [*range(1, n + 1), n]
    order = sorted(ranks, key=ranks.get)
    group = {symbol: g for g, symbol in enumerate(order)}
    member_of = [group[w] for w in word] + [-1]
    members: list[list[int]] = [[] for _ in order]
    for i in range(n):
        members[member_of[i]].append(i)
    below, above = [*range(-1, len(order) - 1)], [*range(1, len(order) + 1)]
    found = []
    top = len(order) - 1
    while top >= 0:
        grown: dict[tuple[int, int], list[int]] = {}
        for i in members[top]:
            if member_of[i] != top or member_of[left[i]] == top:
                continue  # moved to a higher group, or not the first in its row
            copies, after = 1, right[i]
            while member_of[after] == top:
                copies, after = copies + 1, right[after]
            if copies >= least:
                found.append((i, right[i] - i))
            before = left[i]
            left[after], right[before] = before, after
            if before >= 0:
                grown.setdefault((member_of[before], copies), []).append(before)
        # what grew by more copies stands higher, all of it right above its old group
        for own, copies in sorted(grown, key=lambda key: -key[1]):
            new, next_up = len(members), above[own]
            members.append(grown[own, copies])
            for i in members[new]:
                member_of[i] = new
            below.append(own)
            above.append(next_up)
            above[own] = new
            below[next_up] = new
        top = below[top]
    return found


def extend(word: list[int], start: int, period: int) -> tuple[int, int]:
    """The largest stretch around a word and its copy in which words one period apart agree."""
    n, begin, end = len(word), start, start + period
    while end < n and word[end] == word[end - period]:
        end += 1
    while begin and word[begin - 1] == word[begin - 1 + period]:
        begin -= 1
    return begin, end


def runs_of(word: list[int], least_periods: int = LEAST_PERIODS, least_words: int = LEAST_WORDS) -> list[Run]:
    """All runs ``(start, length, period)`` of at least so many periods and words, by start, then period."""
    symbols = sorted(set(word))
    size = len(symbols)
    found = set()
    for ranks in ({s: r for r, s in enumerate(symbols)}, {s: size - r for r, s in enumerate(symbols)}):
        # of k periods, the first and last root may be cut: k - 1 whole ones remain
        for start, period in lyndon_roots(word, ranks, least_periods - 1):
            begin, end = extend(word, start, period)
            if end - begin >= max(least_words, least_periods * period):
                found.add((begin, end - begin, period))
    return sorted(found, key=lambda run: (run[0], run[2]))


def candidate_stretches(ids: np.ndarray, owner: np.ndarray, least: int, words: int) -> list[tuple[int, int]]:
    """Stretches of at least ``words`` words of one owner, each word of which occurs ``least`` times in its stretch."""
    starts, ends = spans(np.ones(len(ids), bool), np.flatnonzero(np.diff(owner)) + 1)
    done: list[tuple[int, int]] = []
    while len(starts):
        sizes = ends - starts
        fit = sizes >= words
        starts, ends, sizes = starts[fit], ends[fit], sizes[fit]
        if not len(starts):
            break
        shift = offsets(sizes)
        at = np.arange(shift[-1]) + np.repeat(starts - shift[:-1], sizes)
        stretch = np.repeat(np.arange(len(starts)), sizes)
        _, which, counts = np.unique(stretch * (int(ids.max()) + 1) + ids[at], return_inverse=True, return_counts=True)
        often = counts[which] >= least
        whole = np.bincount(stretch, weights=often, minlength=len(starts)).astype(np.int64) == sizes
        done += zip(starts[whole].tolist(), ends[whole].tolist())
        # the others are cut at their rare words and looked at again
        again = ~whole[stretch]
        often, at = often[again], at[again]
        begin, end = spans(often, np.flatnonzero(np.diff(at) > 1) + 1)
        kept = np.flatnonzero(np.diff(stretch[again])) + 1
        if len(kept):
            begin, end = spans(often, np.union1d(np.flatnonzero(np.diff(at) > 1) + 1, kept))
        starts, ends = at[begin] if len(begin) else begin, at[end - 1] + 1 if len(end) else end
    return sorted(done)


def find_runs(texts: list[str]) -> tuple[list[list[Run]], list[bytes]]:
    """Runs of each text, and its words without what repeats an earlier period, joined by one space."""
    split = [t.encode("utf-8", "replace").split() for t in texts]
    bounds = offsets(map(len, split))
    table: dict[bytes, int] = {}
    for words in split:
        for w in words:
            if w not in table:
                table[w] = len(table)
    ids = np.fromiter((table[w] for words in split for w in words), np.int64, int(bounds[-1]))
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    runs: list[list[Run]] = [[] for _ in texts]
    dropped = np.zeros(len(ids) + 1, np.int64)
    for begin, end in candidate_stretches(ids, owner, LEAST_PERIODS, LEAST_WORDS):
        document = int(owner[begin])
        first = begin - int(bounds[document])
        for start, length, period in runs_of(ids[begin:end].tolist()):
            runs[document].append((first + start, length, period))
            dropped[begin + start + period] += 1
            dropped[begin + start + length] -= 1
    gone = np.cumsum(dropped[:-1]) > 0
    left = []
    for document, words in enumerate(split):
        own = gone[bounds[document] : bounds[document + 1]]
        kept = [words[i] for i in np.flatnonzero(~own)] if own.any() else words
        left.append(b" ".join(kept))
    return runs, left


def collapse_runs(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``runs``, an array of (start, length, period), and ``collapsed``, the text without repeated periods.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0. A run has at least four
    periods and six words; runs come by start, then period. Of a run its first period
    stays; the words that stay are joined by one space. Null and empty texts have
    no words: no runs, an empty string. Repeated rows are treated alike. Extra
    columns (or those in ``keep``) stay; columns named like an added one are replaced.
    Rows are independent: no shuffle; a task holds one block of texts.
    """

    def work(texts: list[str]) -> list[pa.Array]:
        runs, left = find_runs(texts)
        flat = np.array([r for own in runs for r in own], np.int64).reshape(-1, 3)
        structs = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], names=_RUN.names)
        lists = pa.ListArray.from_arrays(pa.array(offsets(map(len, runs)), pa.int32()), structs)
        return [lists, pa.array(left, pa.binary()).cast(pa.string())]

    targets = {"runs": T.ArrayType(_RUN), "collapsed": T.StringType()}
    return map_texts(df, text, targets, lambda: work, keep)


def strongest(runs: Column) -> Column:
    """The run of greatest length / period, compared exactly; ties: the least start, then period. Null without runs."""

    def better(a: Column, b: Column) -> Column:
        here, there = b["length"] * a["period"], a["length"] * b["period"]
        earlier = (b["start"] < a["start"]) | ((b["start"] == a["start"]) & (b["period"] < a["period"]))
        return F.when(a.isNull() | (here > there) | ((here == there) & earlier), b).otherwise(a)

    return F.aggregate(runs, F.lit(None).cast(_RUN), better)


def repeat_words(text: Column, number: Column, kind: Column) -> Column:
    """The text with its words from a on repeated: word i becomes word a + (i − a) mod p.

    For n words, a = number mod n and p = 1 + floor((n − a) / (3 + kind)). Texts without
    words stay, and so do all if an argument is null.
    """
    words = F.filter(F.split(F.coalesce(text, F.lit("")), WHITE), lambda w: w != "")

    def planted(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = F.pmod(number, F.greatest(n, F.lit(1).cast("long")))
        p = 1 + F.floor((n - a) / (3 + kind)).cast("long")
        place = lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int")
        each = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(w, place(i)))
        return F.when((n > 0) & number.isNotNull() & kind.isNotNull(), F.concat_ws(" ", each)).otherwise(text)

    return bind(words, planted)
