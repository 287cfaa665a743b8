"""Near duplicates by the Jaccard similarity of word shingles: a chosen-path join.

Documents with the same words in the same order are one set. Each set is known
by a sketch of min-hashes, one token per coordinate: two sets share the token of
a coordinate with a probability that is their similarity. A run splits all
sets by the tokens at two sampled coordinates, so a set enters two buckets. Large
buckets are split again at two coordinates of their own; small ones are compared
pair by pair. At the threshold a pair stays together in some bucket with a
probability of at least (2t - 1) / t**2 at any depth, and runs are repeated until
the target recall is reached. A large bucket that holds at least half of the one it
was split from is not split again, and its sets become one candidate group. Candidate
groups of any size are divided into sets whose sketches agree.

Sketches only propose. Proposed pairs form candidate groups, and within a group
all pairs are checked exactly on all shingles, in blocks of bounded size. Only
sums of links and one edge per set leave a block, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slowtide.llm.codes import BASES, Sums, blocks, code_points, groups, mix, offsets, ragged, spans, starts_of
from slowtide.llm.components import connected_components
from slowtide.session import write_once

WORDS = 5
SIMILARITY = 0.8
RECALL = 0.9999
#: Min-hashes per sketch.
COORDINATES = 64
#: A bucket of at most so many sets is compared pair by pair; DEPTH bounds the splits of larger ones.
SMALL = 64
DEPTH = 5
#: Standard deviations by which a sketch may understate a similarity at the threshold.
SLACK = 4.7
#: Sets per block of the exact check.
BLOCK_SETS = 512
#: A table of at most so many rows of three numbers is broadcast.
BROADCAST_ROWS = 200_000

_SEEDS = mix(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_XOR, _ODD = _SEEDS[:COORDINATES], _SEEDS[COORDINATES:] | np.uint64(1)


def runs_needed(similarity: float, recall: float) -> int:
    """Runs of two sampled coordinates per split that find a pair at the threshold with probability ``recall``."""
    if similarity <= 0.5:
        raise ValueError("two coordinates per split need a similarity above one half")
    if similarity >= 1:
        return 1
    kept = (2 * similarity - 1) / similarity**2
    return math.ceil(math.log(1 - recall) / math.log(1 - kept))


def shingles(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all shingles text after text, the texts' bounds in them, and two digests of each text's words.

    Words are what ASCII white space divides. A text of fewer words than a
    shingle has one shingle of all its words; a text without words has none.
    """
    codes, bounds = code_points("\n".join(texts)), offsets(len(t) + 1 for t in texts)
    starts, ends = spans(~((codes == 32) | ((codes >= 9) & (codes <= 13))))
    own = Sums(codes).hashes(starts, ends)
    first = np.searchsorted(starts, bounds[:-1])
    last = np.append(first[1:], len(starts))
    n = last - first
    sums = Sums(own)
    digests = [sums.hashes(first, last), Sums(own, BASES[1]).hashes(first, last)]
    count = np.where(n > 0, np.maximum(n - words + 1, 1), 0)
    begin = ragged(first, count)
    size = np.repeat(np.minimum(n, words), count)
    return sums.hashes(begin, begin + size), np.concatenate([[0], np.cumsum(count)]), *digests


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """``(doc_id, a, b, sketch)``: two digests of the words, and the min-hashes as bytes (null without words)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in blocks(batch, "text"):
                tokens, bounds, a, b = shingles(texts, words)
                full = np.flatnonzero(np.diff(bounds))
                least = np.zeros((len(full), COORDINATES), "<u4")
                for i in range(COORDINATES if len(full) else 0):
                    least[:, i] = np.minimum.reduceat((tokens ^ _XOR[i]) * _ODD[i], bounds[full]) >> np.uint64(32)
                held: list[bytes | None] = [None] * len(texts)
                for i, own in zip(full.tolist(), least):
                    held[i] = own.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(held, pa.binary())],
                    names=["doc_id", "a", "b", "sketch"],
                )

    return docs.mapInArrow(rows, "doc_id long, a long, b long, sketch binary")


def _matrix(column: pa.Array) -> np.ndarray:
    joined = b"".join(column.to_pylist())
    return np.frombuffer(joined, "<u4").reshape(-1, COORDINATES)


def _children(nodes: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two buckets that each row's set enters below its node, by two different coordinates of the node."""
    draw = mix(nodes)
    first = (draw % np.uint64(COORDINATES)).astype(int)
    second = (first + 1 + ((draw >> np.uint64(32)) % np.uint64(COORDINATES - 1)).astype(int)) % COORDINATES
    at = np.arange(len(nodes))
    found = [mix(nodes ^ mix((sketch[at, c].astype(np.uint64) << np.uint64(8)) + c.astype(np.uint64))) for c in (first, second)]
    return found[0], found[1]


def split(rows: DataFrame, roots: list[int] | None = None) -> DataFrame:
    """``(node, set_id, parent)`` one level down, ``parent`` being the size of the bucket that was split.

    From ``(node, set_id, n, sketch)``, or for ``(set_id, sketch)`` from all ``roots``, whose size counts as 0.
    """

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, sketch = batch.column("set_id"), _matrix(batch.column("sketch"))
            own = batch.column("node").to_numpy().view(np.uint64) if roots is None else None
            parent = batch.column("n") if roots is None else pa.array(np.zeros(len(ids), np.int64))
            for root in [None] if roots is None else roots:
                for found in _children(own if root is None else np.full(len(ids), root, np.uint64), sketch):
                    yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), ids, parent], names=["node", "set_id", "parent"])

    return rows.mapInArrow(down, "node long, set_id long, parent long")


def _forest(linked: np.ndarray) -> np.ndarray:
    """The first row number of each row's component, from a symmetric matrix of links."""
    n = len(linked)
    label = np.arange(n)
    held = linked | np.eye(n, dtype=bool)
    while True:
        new = np.where(held, label[None, :], n).min(1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def compare_small(rows: DataFrame, least_equal: int) -> DataFrame:
    """Edges ``(a, b)`` from ``(node, set_id, sketch)``: pairs of a bucket that agree at ``least_equal`` coordinates, as forests."""

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in groups(batches, ["node"], 1 << 14):
            ids, sketch = run.column("set_id").to_numpy(), _matrix(run.column("sketch").combine_chunks())
            found: list[tuple[np.ndarray, np.ndarray]] = []
            at = starts_of(run, ["node"])
            size = np.diff(at)
            for first in at[:-1][size == 2]:
                found.append((np.array([first]), np.array([first + 1])))
            pairs = [tuple(np.concatenate(c) for c in zip(*found))] if found else []
            if pairs:
                a, b = pairs[0]
                same = (sketch[a] == sketch[b]).sum(1) >= least_equal
                pairs = [(ids[a[same]], ids[b[same]])]
            for first, n in zip(at[:-1][size > 2].tolist(), size[size > 2].tolist()):
                own = sketch[first : first + n]
                linked = (own[:, None] == own[None]).sum(2) >= least_equal
                top = _forest(linked)
                rest = np.flatnonzero(top != np.arange(n))
                pairs.append((ids[first + rest], ids[first + top[rest]]))
            if pairs:
                a, b = (np.concatenate(c) for c in zip(*pairs))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return rows.repartition("node").sortWithinPartitions("node").mapInArrow(edges, "a long, b long")


def agreement(similarity: float) -> int:
    """Coordinates at which the sketches of a pair at the threshold agree at least."""
    spread = SLACK * math.sqrt(COORDINATES * similarity * (1 - similarity))
    return max(1, math.floor(COORDINATES * similarity - spread))


def split_by_sketch(found: DataFrame, tight: DataFrame, sets: DataFrame, least_equal: int) -> DataFrame:
    """``(node, component)`` with components divided into sets whose sketches agree, whatever their size.

    Only components that an edge of a large bucket holds (``tight``) can fall apart; the
    edges of all others are pairs whose sketches agree.

    Large buckets make candidates of all their sets. Their sketches are compared here
    pair by pair, in the blocks of the exact check, so that it only gets texts that are
    linked by sketches.
    """
    held = found.join(tight.select(F.col("a").alias("node")).distinct(), "node").select("component").distinct()
    sizes = found.join(held, "component", "left_semi").groupBy("component").agg((F.count(F.lit(1)) + 1).alias("n"))
    sizes = write_once(sizes.select("component", F.ceil(F.col("n") / BLOCK_SETS).cast("int").alias("parts")), "group-sizes")
    if sizes.isEmpty():
        return found
    nodes = found.unionByName(sizes.select(F.col("component").alias("node"), "component")).join(sizes, "component")
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    rows = nodes.select("component", F.col("node").alias("set_id"), "parts", part.alias("part")).join(sets, "set_id")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    keys = ["component", "low", "high"]
    rows = rows.select("component", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "set_id", "sketch")

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in groups(batches, keys, 1 << 12):
            ids, sketch = run.column("set_id").to_numpy(), _matrix(run.column("sketch").combine_chunks())
            at = starts_of(run, keys)
            for first, last in zip(at[:-1].tolist(), at[1:].tolist()):
                agree = np.zeros((last - first, last - first), np.uint8)
                for own in sketch[first:last].T:
                    agree += own[:, None] == own[None]
                top = _forest(agree >= least_equal)
                rest = np.flatnonzero(top != np.arange(last - first))
                yield pa.RecordBatch.from_arrays([pa.array(ids[first + rest]), pa.array(ids[first + top[rest]])], names=["a", "b"])

    linked = rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(edges, "a long, b long")
    return found.join(sizes, "component", "left_anti").select("node", "component").unionByName(connected_components(linked))


def candidate_edges(sets: DataFrame, similarity: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """Edges that join every pair of similar sets into one component, from ``(set_id, sketch)``.

    First pairs whose sketches agree, then the edges of buckets that were not compared.
    """
    least_equal = agreement(similarity)
    roots = mix(np.arange(1, runs_needed(similarity, recall) + 1, dtype=np.uint64)).tolist()
    level = write_once(split(sets, roots), "buckets-1")
    edges, uncompared, n = None, None, F.col("n")
    for depth in range(1, DEPTH + 1):
        sizes = level.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.max("parent").alias("parent"), F.min("set_id").alias("low"))
        shared = write_once(level.drop("parent").join(sizes.where(n > 1), "node"), f"buckets-{depth}-shared")
        found = compare_small(shared.where(n <= SMALL).select("node", "set_id").join(sets, "set_id"), least_equal)
        tight = F.lit(True) if depth == DEPTH else (F.col("parent") > 0) & (2 * n >= F.col("parent"))
        whole = shared.where((n > SMALL) & tight).select(F.col("set_id").alias("a"), F.col("low").alias("b")).where("a <> b")
        edges = found if edges is None else edges.unionByName(found)
        uncompared = whole if uncompared is None else uncompared.unionByName(whole)
        loose = shared.where((n > SMALL) & ~tight).select("node", "set_id", "n")
        if depth == DEPTH or loose.isEmpty():
            break
        level = write_once(split(loose.join(sets, "set_id")), f"buckets-{depth + 1}")
    return edges, uncompared


def check_groups(rows: DataFrame, words: int, similarity: float) -> DataFrame:
    """``(set_id, links, peer)`` from ``(comp, low, high, part, set_id, n_docs, a, text)`` sorted by comp, low, high.

    All pairs of sets of one group, or of its two parts ``low`` and ``high``, are
    compared on all shingles. ``links`` sums the documents of similar sets; ``peer`` is
    the least set that is linked, directly or not, within the group.
    """
    limit = Fraction(similarity).limit_denominator(1000)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in groups(batches, ["comp", "low", "high"], 1 << 13):
            out: list[tuple] = []
            at = starts_of(run, ["comp", "low", "high"])
            table = {c: run.column(c).to_numpy() for c in ("low", "high", "part", "set_id", "n_docs", "a")}
            texts = run.column("text")
            for first, last in zip(at[:-1].tolist(), at[1:].tolist()):
                own = {c: v[first:last] for c, v in table.items()}
                held = [t or "" for t in texts.slice(first, last - first).to_pylist()]
                tokens, bounds, digest, _ = shingles(held, words)
                # a doc_id's other texts, and repeated rows, are not the set's
                right = np.flatnonzero(digest.view(np.int64) == own["a"])
                right = right[np.unique(own["set_id"][right], return_index=True)[1]]
                if len(right) < 2:
                    continue
                linked = _similar([tokens[bounds[i] : bounds[i + 1]] for i in right], limit)
                part = own["part"][right]
                if own["low"][0] != own["high"][0]:
                    linked &= part[:, None] != part[None]
                ids = own["set_id"][right]
                links = linked @ own["n_docs"][right]
                some = np.flatnonzero(linked.any(1))
                out.append((ids[some], links[some], ids[_forest(linked)][some]))
            if out:
                columns = [pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out)]
                yield pa.RecordBatch.from_arrays(columns, names=["set_id", "links", "peer"])

    return rows.mapInArrow(check, "set_id long, links long, peer long")


def _similar(sets: list[np.ndarray], limit: Fraction) -> np.ndarray:
    """Which pairs of token sets reach a Jaccard similarity, as a matrix (false on its diagonal)."""
    sets = [np.unique(s) for s in sets]
    size = np.array([len(s) for s in sets])
    n = len(sets)
    tokens, owner = np.concatenate(sets), np.repeat(np.arange(n), size)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    fresh = np.append(True, tokens[1:] != tokens[:-1])
    number = np.cumsum(fresh) - 1
    shared = np.bincount(number) > 1
    keep = shared[number]
    number, owner = (np.cumsum(shared) - 1)[number[keep]], owner[keep]
    total, width = int(shared.sum()), max(1, (1 << 22) // n)
    common = np.zeros((n, n))
    for first in range(0, total, width):
        a, b = np.searchsorted(number, [first, first + width])
        held = np.zeros((n, min(width, total - first)), np.float32)
        held[owner[a:b], number[a:b] - first] = 1
        common += held @ held.T
    union = size[:, None] + size[None] - common
    linked = limit.denominator * common >= limit.numerator * union
    linked &= size[:, None] > 0
    np.fill_diagonal(linked, False)
    return linked


def near_duplicates(
    df: DataFrame,
    words: int = WORDS,
    similarity: float = SIMILARITY,
    recall: float = RECALL,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``(doc_id, class_id, n_links)``: one row per document.

    Documents are linked if the Jaccard similarity of their sets of ``words``-word
    shingles is at least ``similarity``; classes are the connected components of the
    links, named by their least doc_id. ``n_links`` counts the other documents
    that a document is linked with itself. A text without words (null, empty, white
    space) has no shingles and is a class of its own. Of several texts with one doc_id
    the one with the least digest counts, repeated rows count once, and rows
    without doc_id are left out. Extra columns are ignored; no rows give no rows.
    """
    docs = df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).where("doc_id is not null")
    own = sketches(docs, words).groupBy("doc_id").agg(F.min(F.struct("a", "b", "sketch")).alias("s"))
    own = write_once(own.select("doc_id", "s.a", "s.b", "s.sketch"), "sketches")
    sets = own.where(F.col("sketch").isNotNull()).groupBy("a", "b")
    sets = write_once(
        sets.agg(F.min("doc_id").alias("set_id"), F.count(F.lit(1)).alias("n_docs"), F.max("sketch").alias("sketch")), "sets"
    )
    agreed, tight = candidate_edges(sets.select("set_id", "sketch"), similarity, recall)
    found = connected_components(agreed.unionByName(tight))
    found = split_by_sketch(found, tight, sets.select("set_id", "sketch"), agreement(similarity))
    tops = found.select(F.col("component").alias("node"), "component").distinct()
    members = found.unionByName(tops).join(sets.select(F.col("set_id").alias("node"), "n_docs", "a"), "node")
    sizes = members.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK_SETS).cast("int").alias("parts"))
    members = members.join(sizes, "component").select(
        F.col("component").alias("comp"), F.col("node").alias("set_id"), "n_docs", "a", "parts",
        F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"),
    )
    members = write_once(members, "members")
    small = members.count() <= BROADCAST_ROWS
    joined = docs.join(F.broadcast(members) if small else members, docs["doc_id"] == members["set_id"]).drop("doc_id")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = joined.withColumn("other", other).select(
        "comp", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "set_id", "n_docs", "a", "text"
    )
    dealt = dealt.repartition("comp", "low", "high").sortWithinPartitions("comp", "low", "high")
    checked = write_once(check_groups(dealt, words, similarity), "links")
    classes = connected_components(checked.select(F.col("set_id").alias("a"), F.col("peer").alias("b")))
    links = checked.groupBy("set_id").agg(F.sum("links").alias("links"))
    named = (
        sets.select("set_id", "a", "b", "n_docs")
        .join(links, "set_id", "left")
        .join(classes.withColumnRenamed("node", "set_id"), "set_id", "left")
        .select(
            "a", "b",
            F.coalesce("component", "set_id").alias("class_id"),
            (F.coalesce("links", F.lit(0)) + F.col("n_docs") - 1).alias("n_links"),
        )
    )
    rows = own.select("doc_id", "a", "b", F.col("sketch").isNotNull().alias("has_words"))
    alone = rows.where(~F.col("has_words")).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return rows.where("has_words").join(named, ["a", "b"]).select("doc_id", "class_id", "n_links").unionByName(alone)
