"""Document fingerprints: a Merkle tree over sections and paragraphs.

A paragraph is a line; its digest is a hash of its bytes. A section is a run of
paragraphs that ends at a blank line or after a paragraph whose own digest says
so (one in eight), so an edit never moves the borders of distant sections; its
digest is a hash of its paragraphs' digests. The root hashes the sections.
Equal roots mean equal texts; going down where digests differ finds the edited
paragraphs. Each paragraph also lists marks of its runs of words, cut after
words chosen by their hash, which tell how much of a changed paragraph is left.

As text: ``root|section=paragraph.marks,paragraph.marks;section=..``, in hex.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slowtide.llm.codes import BLOCK, Sums, code_points, map_texts, offsets, spans

SECTION_ONE_IN = 8
RUN_ONE_IN = 4


def _digest(data: bytes, size: int = 8) -> str:
    return hashlib.blake2b(data, digest_size=size).hexdigest()


def fingerprints(texts: list[str]) -> tuple[list[str], list[list[str]]]:
    """Fingerprint of each text, and the marks of its word runs as a sorted list."""
    codes, bounds = code_points("\n".join(texts)), offsets(len(t) + 1 for t in texts)
    line_end = codes == 10
    inside = ~(line_end | (codes == 32) | (codes == 9) | (codes == 13))
    starts, ends = spans(inside)
    sums = Sums(codes)
    # a run of words ends with a chosen word or with its paragraph
    words = sums.hashes(starts, ends)
    paragraph = np.concatenate([[0], np.cumsum(line_end)])
    own = paragraph[starts]
    last = (words % np.uint64(RUN_ONE_IN) == 0) | np.append(own[1:] != own[:-1], True)[: len(own)]
    first = np.append(True, last[:-1])[: len(own)]
    marks = (sums.hashes(starts[first], ends[last]) >> np.uint64(32)).astype(">u4").tobytes().hex()
    at = np.searchsorted(own[first], np.arange(int(paragraph[-1]) + 2)) * 8
    at, number = at.tolist(), paragraph[np.minimum(bounds[:-1], len(codes))].tolist()
    found, runs = [], []
    for text, line in zip(texts, number):
        sections, section, all_marks = [], [], []
        for n, part in enumerate(text.split("\n") if text else []):
            own_marks = marks[at[line + n] : at[line + n + 1]]
            digest = _digest(part.encode("utf-8", "replace"))
            section.append((digest, own_marks))
            all_marks += [own_marks[i : i + 8] for i in range(0, len(own_marks), 8)]
            if not own_marks or int(digest[-2:], 16) % SECTION_ONE_IN == 0:
                sections.append(section)
                section = []
        if section:
            sections.append(section)
        tops = [_digest("".join(d for d, _ in s).encode()) for s in sections]
        root = _digest(f"{len(tops)}:{''.join(tops)}".encode(), 16)
        body = ";".join(f"{top}={','.join(f'{d}.{m}' for d, m in s)}" for top, s in zip(tops, sections))
        found.append(f"{root}|{body}")
        runs.append(sorted(all_marks))
    return found, runs


def _tree(fingerprint: str) -> tuple[str, list[tuple[str, list[tuple[str, str]]]]]:
    root, _, body = fingerprint.partition("|")
    sections = []
    for part in body.split(";") if body else []:
        top, _, paragraphs = part.partition("=")
        sections.append((top, [tuple(p.split(".")) for p in paragraphs.split(",")]))
    return root, sections


def _common(a: list[str], b: list[str]) -> int:
    i = j = n = 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            i, j, n = i + 1, j + 1, n + 1
        elif a[i] < b[j]:
            i += 1
        else:
            j += 1
    return n


def _likeness(root_a: str, a: list[str], root_b: str, b: list[str]) -> float:
    if root_a == root_b:
        return 1.0
    return 2.0 * _common(a, b) / (len(a) + len(b)) if a and b else 0.0


def likeness(a: str, b: str) -> float:
    """Share of word runs that two fingerprints have in common (0 to 1); 1 for equal roots."""
    (root_a, tree_a), (root_b, tree_b) = _tree(a), _tree(b)
    marks = [sorted(m[i : i + 8] for _, s in tree for _, m in s for i in range(0, len(m), 8)) for tree in (tree_a, tree_b)]
    return _likeness(root_a, marks[0], root_b, marks[1])


def edited_paragraphs(a: str, b: str) -> list[tuple[str, int]]:
    """Paragraphs that only one text holds: ``("-", number in a)`` and ``("+", number in b)``.

    Equal roots are not looked into, nor sections that both texts have.
    """
    (root_a, tree_a), (root_b, tree_b) = _tree(a), _tree(b)
    if root_a == root_b:
        return []
    found = []
    for sign, tree, other in (("-", tree_a, tree_b), ("+", tree_b, tree_a)):
        sections: dict[str, int] = {}
        for top, _ in other:
            sections[top] = sections.get(top, 0) + 1
        left: dict[str, int] = {}
        mine: dict[str, int] = {}
        for top, _ in tree:
            mine[top] = mine.get(top, 0) + 1
        for top, s in other:
            if mine.get(top, 0) > 0:
                mine[top] -= 1
                continue
            for digest, _ in s:
                left[digest] = left.get(digest, 0) + 1
        number = 0
        for top, s in tree:
            if sections.get(top, 0) > 0:
                sections[top] -= 1
                number += len(s)
                continue
            for digest, _ in s:
                if left.get(digest, 0) > 0:
                    left[digest] -= 1
                else:
                    found.append((sign, number))
                number += 1
    return found


def with_fingerprint(df: DataFrame, text: str = "text", target: str = "fingerprint") -> DataFrame:
    """Add each text's fingerprint; null counts as empty. Extra columns stay, ``target`` is replaced."""
    return map_texts(df, text, {target: T.StringType()}, lambda: lambda texts: [pa.array(fingerprints(texts)[0], pa.string())])


def in_order(docs: DataFrame, parts: int) -> DataFrame:
    """``(doc_id, text)`` in parts of rising doc_id, each closed by the row that follows its last.

    Rows get ``__part`` and ``__next``; the row of ``__next`` = 1 opens the next
    part (after the last: the first one). Rows without doc_id come last. Only
    the doc_ids at the borders, one per part, pass through the driver, and each
    text is shuffled once.
    """
    at = [i / parts for i in range(parts)]
    found = docs.agg(F.percentile_approx("doc_id", at, max(10_000, 10 * parts)).alias("b")).first()["b"]
    borders = np.array(sorted(set(found or [])), np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            valid = ids.is_valid().to_numpy(zero_copy_only=False)
            values = ids.fill_null(0).to_numpy()
            number = np.where(valid, np.maximum(np.searchsorted(borders, values, side="right") - 1, 0), max(len(borders) - 1, 0))
            if len(borders):
                closes = np.flatnonzero(valid & (borders[number] == values))
            else:  # no row has a doc_id: one part, closed by its own first row
                closes = np.arange(batch.num_rows)
            rows = np.concatenate([np.arange(batch.num_rows), closes])
            part = np.concatenate([number, (number[closes] - 1) % max(len(borders), 1)])
            close = np.repeat([0, 1], [batch.num_rows, len(closes)])
            taken = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays(
                [taken.column("doc_id"), taken.column("text"), pa.array(part, pa.int64()), pa.array(close, pa.int32())],
                names=["doc_id", "text", "__part", "__next"],
            )

    dealt = docs.mapInArrow(deal, "doc_id long, text string, __part long, __next int")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "__part").sortWithinPartitions("__part", "__next", F.asc_nulls_last("doc_id"), "text")


def fingerprint_edits(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of all texts and of their edited texts.

    The edited text has its last floor(n / 4) code points replaced by the first
    as many (or all) of the next document in the order of doc_id; the first
    follows the last. Null texts are empty, whose fingerprint has no section.
    Rows of equal doc_id follow in the order of their texts, rows without one come
    last; a single row follows itself. Extra columns are ignored; no rows
    give no rows. A task holds one block of texts at a time.
    """
    docs = df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    parts = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def rows_of(run: list[tuple]) -> pa.RecordBatch:
        """Result rows of all but the last of some rows that follow each other in one part."""
        texts = [row[1] for row in run]
        edited = []
        for i in range(len(run) - 1):
            cut = len(texts[i]) // 4
            edited.append(texts[i][: len(texts[i]) - cut] + texts[i + 1][:cut])
        plain, marks = fingerprints(texts)
        changed, changed_marks = fingerprints(edited)
        out = []
        for i, new in enumerate(edited):
            root, next_root, new_root = plain[i][:32], plain[i + 1][:32], changed[i][:32]
            near = _likeness(root, marks[i], new_root, changed_marks[i])
            near_next = _likeness(root, marks[i], next_root, marks[i + 1])
            sha = hashlib.sha256(new.encode("utf-8", "replace")).hexdigest()
            out.append((run[i][0], len(texts[i]), sha, plain[i], changed[i], near, near_next))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run: list[tuple] = []
        size, part, closed = 0, None, False
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("doc_id", "text", "__part", "__next"))
            for doc_id, text, own, closing in zip(*columns):
                if own != part:
                    run, size, part, closed = [], 0, own, False
                if closed:
                    continue
                run.append((doc_id, text))
                size += len(text)
                closed = closing == 1
                if closed or size > BLOCK:
                    if len(run) > 1:
                        yield rows_of(run)
                    run, size = run[-1:], len(text)

    schema = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
        " near_edited double, near_next double"
    )
    return in_order(docs, parts).mapInArrow(compare, schema)
