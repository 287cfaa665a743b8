"""Alignment of two tokenizers over whole texts, by vectorised merging in lockstep.

A text's tokens of either tokenizer cover the same bytes. Walking both lists at
once, a pair of tokens that overlap is a link, and a place where both end is a
cut. All documents of a block are walked together: one state vector holds every
document's place in A and in B, a numpy step advances all of them by one link,
and documents that are through leave the vector. Long documents take several
places in it, divided where the pieces they were encoded in end, since both
tokenizers end tokens there.

How often a pair of ids is linked is a count over the corpus. A block sends its
distinct pairs only, gets their counts back, and scores its documents from the
compressed list of pairs it has stored meanwhile.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
import tiktoken
import tokenizers
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slowtide.llm.codes import blocks, offsets, ragged
from slowtide.operators.moments import plain_arrow_schema
from slowtide.session import write_once

#: Bytes of text that are aligned together, tokens after which a document takes another place in the state.
BLOCK_BYTES = 2 << 20
SECTION = 512
#: Characters of stretches whose ids a worker remembers; the memory starts anew beyond it.
REMEMBERED = 3_000_000
#: A pair of ids is a · B_IDS + b.
B_IDS = 1 << 15
SPACE = "▁"
_STRETCHES = re.compile(r"(?<=\S) (?=\S)")
_TOKENIZERS: dict[tuple[str, str], Tokenizers] = {}


def _byte_characters() -> dict[str, int]:
    """The printable stand-ins of a byte-level vocabulary: printable Latin-1 as it is, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def byte_tokens(path: str) -> list[bytes]:
    """The bytes of every id of a byte-level vocabulary; special tokens have none."""
    tokenizer, table = tokenizers.Tokenizer.from_file(path), _byte_characters()
    special = set(tokenizer.get_added_tokens_decoder())
    found = [b""] * tokenizer.get_vocab_size()
    for token, i in tokenizer.get_vocab().items():
        if i not in special:
            found[i] = bytes(table[c] for c in token)
    return found


def piece_tokens(path: str) -> list[bytes]:
    """The bytes of every id of a piece model: U+2581 is a space, ``<0xHH>`` a byte, control pieces have none."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            found.append(bytes([int(piece[3:-1], 16)]))
        else:
            found.append(b"" if model.is_control(i) or model.is_unknown(i) else piece.replace(SPACE, " ").encode())
    return found


class Tokenizers:
    """Ids of both tokenizers for whole texts; stretches between single spaces are encoded once while remembered.

    Neither tokenizer joins characters across a single space with other characters
    than white space on both sides: the byte-level one splits there before it
    merges, and no piece of the other holds a space after another character
    (checked). So a text is the sequence of its stretches, each after a space.
    """

    def __init__(self, byte_path: str, piece_path: str):
        table = byte_tokens(byte_path)
        special = tokenizers.Tokenizer.from_file(byte_path).get_added_tokens_decoder()
        ranks = {token: i for i, token in enumerate(table) if i not in special}
        # the file's merges in its order of ids; their names in a text are plain text
        self.a = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.a_bytes, self.b_bytes = table, piece_tokens(piece_path)
        if any(re.search(b"[^ ] ", piece) for piece in self.b_bytes):
            raise ValueError("a piece goes on over a space")
        if len(self.b_bytes) > B_IDS or len(self.a_bytes) * B_IDS >= 1 << 31:
            raise ValueError("vocabularies too large for 32-bit pairs")
        self.a_size = np.array([len(t) for t in self.a_bytes], np.int64)
        self.b_size = np.array([len(t) for t in self.b_bytes], np.int64)
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.held = 0
        empty = np.zeros(0, np.int64)
        self.ids = {"a": empty.astype(np.int32), "b": empty.astype(np.int32)}
        self.count = {"a": empty, "b": empty}
        self.first = {"a": empty, "b": empty}
        self.same = np.zeros(0, bool)

    def stretches(self, text: str) -> list[str]:
        if "  " in text or text[0] == " " or text[-1] == " ":
            return _STRETCHES.split(text)
        return text.split(" ")

    def look(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Places of all stretches of the texts in memory, and the texts' bounds among them; empty texts have none."""
        if self.held > REMEMBERED:
            self.forget()
        place, fresh, found, counts = self.place, [], [], []
        for text in texts:
            parts = self.stretches(text) if text else []
            counts.append(len(parts))
            for part in parts:
                at = place.get(part)
                if at is None:
                    at = place[part] = len(place)
                    fresh.append(part)
                found.append(at)
        if fresh:
            self._encode(fresh)
        return np.array(found, np.int64), offsets(counts)

    def _encode(self, fresh: list[str]) -> None:
        self.held += sum(map(len, fresh))
        spaced = [" " + part for part in fresh]
        lists = {"a": [self.a.encode_ordinary(part) for part in spaced], "b": self.b.encode(fresh, num_threads=1)}
        join = b"".join
        wanted = [part.encode("utf-8", "replace") for part in spaced]
        same = [
            join([self.a_bytes[i] for i in a]) == want == join([self.b_bytes[i] for i in b])
            for a, b, want in zip(lists["a"], lists["b"], wanted)
        ]
        self.same = np.concatenate([self.same, np.array(same, bool)])
        for side, found in lists.items():
            flat = np.fromiter((i for ids in found for i in ids), np.int32)
            counts = np.fromiter(map(len, found), np.int64, len(found))
            starts = len(self.ids[side]) + np.cumsum(counts) - counts
            self.ids[side] = np.concatenate([self.ids[side], flat])
            self.count[side] = np.concatenate([self.count[side], counts])
            self.first[side] = np.concatenate([self.first[side], starts])


def tokenizers_of(byte_path: str, piece_path: str) -> Tokenizers:
    """The worker's pair of tokenizers."""
    key = byte_path, piece_path
    if key not in _TOKENIZERS:
        _TOKENIZERS[key] = Tokenizers(*key)
    return _TOKENIZERS[key]


@dataclass
class Links:
    """Positions of linked A and B tokens, in no order, and whether each token ends at a cut."""

    a: np.ndarray
    b: np.ndarray
    a_cut: np.ndarray
    b_cut: np.ndarray


def merge_in_lockstep(a_ends: np.ndarray, b_ends: np.ndarray, a_first: np.ndarray, b_first: np.ndarray) -> Links:
    """Walk all sections at once; section s starts with tokens ``a_first[s]`` and ``b_first[s]``.

    ``a_ends`` and ``b_ends`` are where the tokens end in the bytes of the whole
    block. Sections follow each other and each has tokens; both lists end
    together in each of them.
    """
    a, b = a_first.copy(), b_first.copy()
    until = np.append(a_first[1:], len(a_ends))
    a_cut, b_cut = np.zeros(len(a_ends), bool), np.zeros(len(b_ends), bool)
    links_a, links_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(a):
        links_a.append(a)
        links_b.append(b)
        a_end, b_end = a_ends[a], b_ends[b]
        cut = a_end == b_end
        a_cut[a[cut]] = True
        b_cut[b[cut]] = True
        a, b = a + (a_end <= b_end), b + (b_end <= a_end)
        going = a < until
        if not going.all():
            a, b, until = a[going], b[going], until[going]
    return Links(np.concatenate(links_a), np.concatenate(links_b), a_cut, b_cut)


def sections(sizes: np.ndarray, bounds: np.ndarray, limit: int) -> np.ndarray:
    """Which stretches open a section: the first of a document, and the first at or past each ``limit`` tokens of it."""
    before = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    within = before - before[bounds[:-1][owner]] if len(sizes) else before
    part = within // limit
    opens = np.ones(len(sizes), bool)
    opens[1:] = (owner[1:] != owner[:-1]) | (part[1:] != part[:-1])
    return np.flatnonzero(opens)


class GroupWriter:
    """Groups as text: ``a1,a2|b1;a3|b2,b3``, from tables of ids with the mark that follows them."""

    def __init__(self, size: int):
        self.size = size
        self.table = np.array([f"{i}{mark}".encode() for mark in ",|;" for i in range(size)], "S6")

    def write(self, links: Links, a_ids: np.ndarray, b_ids: np.ndarray, a_bounds: np.ndarray, b_bounds: np.ndarray) -> list[bytes]:
        """The groups of each document."""
        # a token stands after all tokens of earlier groups, B's also after A's of their own
        a_group = np.cumsum(links.a_cut) - links.a_cut
        b_group = np.cumsum(links.b_cut) - links.b_cut
        a_before = np.concatenate([[0], np.flatnonzero(links.a_cut) + 1])
        b_before = np.concatenate([[0], np.flatnonzero(links.b_cut) + 1])
        total = len(a_ids) + len(b_ids)
        code = np.empty(total, np.int64)
        code[np.arange(len(a_ids)) + b_before[a_group]] = a_ids + self.size * links.a_cut
        code[np.arange(len(b_ids)) + a_before[b_group + 1]] = b_ids + self.size * 2 * links.b_cut
        found = []
        bounds = (a_bounds + b_bounds).tolist()
        for begin, end in zip(bounds[:-1], bounds[1:]):
            cells = self.table[code[begin:end]].view(np.uint8)
            found.append(cells[cells != 0].tobytes()[:-1])
        return found


def _align_block(own: Tokenizers, writer: GroupWriter, texts: list[str], digest: bool) -> tuple[dict, dict]:
    """Counts and groups of each text, and the block's distinct pairs with what the second pass needs."""
    place, bounds = own.look(texts)
    good = np.ones(len(texts), bool)
    bad = np.flatnonzero(~own.same[place])
    good[np.searchsorted(bounds, bad, side="right") - 1] = False
    keep = np.repeat(good, np.diff(bounds))
    place, bounds = place[keep], offsets(np.where(good, np.diff(bounds), 0))
    ids, starts, token_bounds = {}, {}, {}
    for side in "ab":
        counts = own.count[side][place]
        ids[side] = own.ids[side][ragged(own.first[side][place], counts)].astype(np.int64)
        starts[side] = np.concatenate([[0], np.cumsum(counts)])
        token_bounds[side] = starts[side][bounds]
    opens = sections(own.count["a"][place], bounds, SECTION)
    links = merge_in_lockstep(
        np.cumsum(own.a_size[ids["a"]]), np.cumsum(own.b_size[ids["b"]]), starts["a"][opens], starts["b"][opens]
    )
    owner = np.repeat(np.arange(len(texts)), np.diff(token_bounds["a"]))[links.a]
    pair = ids["a"][links.a] * B_IDS + ids["b"][links.b]
    entry, times = np.unique(owner << 31 | pair, return_counts=True)
    entry_owner, entry_pair = entry >> 31, entry & ((1 << 31) - 1)
    distinct, which = np.unique(entry_pair, return_inverse=True)
    cuts = np.concatenate([[0], np.cumsum(links.a_cut)])
    groups = writer.write(links, ids["a"], ids["b"], token_bounds["a"], token_bounds["b"])
    if digest:
        groups = [hashlib.sha256(g).hexdigest() if g else "" for g in groups]
    else:
        groups = [g.decode() for g in groups]
    documents = {
        "n_a": np.diff(token_bounds["a"]),
        "n_b": np.diff(token_bounds["b"]),
        "n_groups": np.diff(cuts[token_bounds["a"]]),
        "n_links": np.bincount(owner, minlength=len(texts)),
        "groups": groups,
    }
    squeeze = zstandard.ZstdCompressor(level=1).compress
    held = {
        "entries": np.bincount(entry_owner, minlength=len(texts)).astype(np.int32),
        # positions among the block's pairs, as differences; they begin anew with each document
        "gaps": squeeze(np.diff(which, prepend=0).astype("<i4").tobytes()),
        "times": squeeze(times.astype("<i4").tobytes()),
        "pair": distinct.astype(np.int32),
        "total": np.bincount(which, weights=times, minlength=len(distinct)).astype(np.int64),
    }
    return documents, held


_COUNTS = {"n_a": T.LongType(), "n_b": T.LongType(), "n_groups": T.LongType(), "n_links": T.LongType()}


def align_blocks(
    df: DataFrame, byte_path: str, piece_path: str, text: str = "text", keep: list[str] | None = None, digest: bool = False
) -> DataFrame:
    """The first pass, a row per block: ``block, docs, entries, gaps, times, pair, total``."""
    target = "groups_sha256" if digest else "groups"
    added = _COUNTS | {target: T.StringType()}
    stay = [c for c in (df.columns if keep is None else keep) if c not in (*added, "n_best", "count_sum")]
    rows = df.select(*[f"`{c}`" for c in stay], *([] if text in stay else [f"`{text}`"]))
    document = T.StructType([df.schema[c] for c in stay] + [T.StructField(c, kind) for c, kind in added.items()])
    schema = T.StructType(
        [
            T.StructField("block", T.LongType()),
            T.StructField("docs", T.ArrayType(document)),
            T.StructField("entries", T.ArrayType(T.IntegerType())),
            T.StructField("gaps", T.BinaryType()),
            T.StructField("times", T.BinaryType()),
            T.StructField("pair", T.ArrayType(T.IntegerType())),
            T.StructField("total", T.ArrayType(T.LongType())),
        ]
    )
    kinds = plain_arrow_schema(T.StructType(list(document)[len(stay) :]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizers_of(byte_path, piece_path)
        writer = GroupWriter(max(len(own.a_bytes), len(own.b_bytes)))
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part, texts in blocks(batch, text, BLOCK_BYTES):
                documents, held = _align_block(own, writer, texts, digest)
                columns = [part.column(c) for c in stay] + [pa.array(v, f.type) for v, f in zip(documents.values(), kinds)]
                docs = pa.StructArray.from_arrays(columns, names=document.names)
                lists = {c: held[c] for c in ("entries", "pair", "total")}
                values = {c: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v)) for c, v in lists.items()}
                values |= {c: pa.array([held[c]], pa.binary()) for c in ("gaps", "times")}
                values |= {"block": pa.array([block], pa.int64())}
                values |= {"docs": pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs)}
                yield pa.RecordBatch.from_arrays([values[c] for c in schema.names], names=schema.names)
                block += 1

    return rows.mapInArrow(run, schema)


def align_tokens(
    df: DataFrame, byte_path: str, piece_path: str, text: str = "text", keep: list[str] | None = None, digest: bool = False
) -> DataFrame:
    """Align the ids of space + text by a byte-level tokenizer (A) with those of a piece model (B), which adds the space.

    Adds ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum`` (long) and
    ``groups`` (``a1,a2|b1;a3|b2,b3``, a string), or with ``digest`` its lowercase hex SHA-256
    as ``groups_sha256``. A link is a pair of tokens whose bytes overlap; a
    pair of ids counts as often as it is linked in all rows of ``df``. ``n_best`` counts
    the links whose pair has its B id's highest count, ``count_sum`` adds up the
    links' counts. Special tokens' names are plain text.

    Null and empty texts, and texts whose bytes either tokenizer does not give back
    (U+2581 becomes a space), have no tokens: zeros and an empty string. Repeated rows
    count as often as they occur. Extra columns (or those in ``keep``) stay; columns
    named like an added one are replaced.

    Blocks of texts are stored once with their distinct pairs. Only (block, pair)
    rows are shuffled, to be counted by pair and to come back; nothing is
    collected, and the one broadcast has a row per B id at most.
    """
    stored = write_once(align_blocks(df, byte_path, piece_path, text, keep, digest), "aligned-blocks")
    exploded = stored.select(F.col("block").alias("at"), F.explode(F.arrays_zip("pair", "total")).alias("p"))
    pairs = exploded.select("at", "p.pair", "p.total")
    totals = pairs.groupBy("pair").agg(F.sum("total").alias("total")).withColumn("b", F.col("pair") % B_IDS)
    highest = totals.groupBy("b").agg(F.max("total").alias("highest"))
    scored = totals.join(F.broadcast(highest), "b").select("pair", "total", (F.col("total") == F.col("highest")).alias("top"))
    back = pairs.select("at", "pair").join(scored, "pair")
    document = stored.schema["docs"].dataType.elementType
    stay = [f for f in document if f.name not in _COUNTS]
    added = [T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())]
    counts = [document[c] for c in _COUNTS]
    schema = T.StructType([*stay[:-1], *counts, *added, stay[-1]])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        expand = zstandard.ZstdDecompressor().decompress
        order = np.argsort(right["pair"].to_numpy())
        total, top = right["total"].to_numpy()[order], right["top"].to_numpy()[order]
        tables = []
        for i in range(left.num_rows):
            docs = left["docs"].combine_chunks()[i].values
            entries = np.array(left["entries"][i].values)
            which = np.cumsum(np.frombuffer(expand(left["gaps"][i].as_py()), "<i4").astype(np.int64))
            times = np.frombuffer(expand(left["times"][i].as_py()), "<i4").astype(np.int64)
            bounds = np.concatenate([[0], np.cumsum(entries)])
            sums = [np.concatenate([[0], np.cumsum(v)])[bounds] for v in (times * top[which], times * total[which])]
            columns = {f.name: docs.field(f.name) for f in document}
            columns |= {f.name: pa.array(np.diff(s)) for f, s in zip(added, sums)}
            tables.append(pa.Table.from_arrays([columns[f.name] for f in schema], names=schema.names))
        return pa.concat_tables(tables)

    held = stored.select("block", "docs", "entries", "gaps", "times")
    return held.groupBy("block").cogroup(back.groupBy("at")).applyInArrow(score, schema)


def tokenizer_paths() -> tuple[str, str]:
    """The two public vocabularies that the registered query aligns."""
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
