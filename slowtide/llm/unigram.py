"""A SentencePiece model file read as a unigram vocabulary.

The public model file holds pieces with integer scores, learned as merges. Read
as a unigram model, a text's segmentation is the one with the largest sum of
scores. Runs of white space carry a placeholder far below all other scores;
they get the lowest regular score instead, so that sums stay exact.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from sentencepiece import sentencepiece_model_pb2

from slowtide.llm.codes import code_points, offsets

NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE, UNUSED = 1, 2, 3, 4, 6, 5
UNIGRAM = 1
SPACE = "▁"
#: A placeholder score, and how far an unknown character lies below the lowest piece.
PLACEHOLDER = -1e9
UNKNOWN_PENALTY = 10.0


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by id. ``byte_ids[b]`` is the id of byte b, ``texts[i]`` what id i decodes to."""

    ids: list[int]
    pieces: list[str]
    scores: list[float]
    unknown: float
    byte_ids: list[int]
    texts: list[bytes]

    @property
    def longest(self) -> int:
        return max(map(len, self.pieces))


def unigram_proto(path: str) -> sentencepiece_model_pb2.ModelProto:
    """The model file as a unigram model, for ``SentencePieceProcessor(model_proto=..)`` too."""
    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        proto.ParseFromString(file.read())
    spec = proto.normalizer_spec
    if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not spec.escape_whitespaces:
        raise ValueError("only models without normalisation are read")
    if not proto.trainer_spec.byte_fallback:
        raise ValueError("only models with byte fallback are read")
    proto.trainer_spec.model_type = UNIGRAM
    lowest = min(p.score for p in proto.pieces if p.type == NORMAL and p.score > PLACEHOLDER)
    for piece in proto.pieces:
        if piece.type == NORMAL and piece.score <= PLACEHOLDER:
            piece.score = lowest
    return proto


def load_vocabulary(path: str) -> Vocabulary:
    """The pieces of a model file; runs on the driver, the tasks get the lists."""
    proto = unigram_proto(path)
    normal = [(i, p.piece, float(p.score)) for i, p in enumerate(proto.pieces) if p.type == NORMAL]
    byte_ids, texts = [0] * 256, []
    for i, piece in enumerate(proto.pieces):
        if piece.type == BYTE:
            byte_ids[int(piece.piece[3:5], 16)] = i
            texts.append(bytes([int(piece.piece[3:5], 16)]))
        elif piece.type == CONTROL:
            texts.append(b"")
        elif piece.type == UNKNOWN:
            texts.append(" ⁇ ".encode())
        else:
            texts.append(piece.piece.replace(SPACE, " ").encode())
    ids, pieces, scores = (list(x) for x in zip(*normal))
    return Vocabulary(ids, pieces, scores, min(scores) - UNKNOWN_PENALTY, byte_ids, texts)


def escaped(text: str) -> str:
    """The text as the model sees it: spaces as marks, and one in front of a text that is not empty."""
    return SPACE + text.replace(" ", SPACE) if text else ""


class Cutter:
    """Cuts texts where no piece goes across, so that each part has its own best segmentation."""

    def __init__(self, vocabulary: Vocabulary):
        longer = [code_points(p) for p in vocabulary.pieces if len(p) > 1]
        #: true for code points that no piece joins to another
        self.alone = np.ones(0x110000, bool)
        self.alone[np.concatenate(longer)] = False
        before = np.concatenate([p[:-1] for p in longer])
        after = np.concatenate([p[1:] for p in longer])
        mark = ord(SPACE)
        if ((before != mark) & (after == mark)).any():
            raise ValueError("a piece goes across the start of a word")
        #: pairs below 256 that some piece holds side by side
        self.joined = np.zeros((256, 256), bool)
        low = (before < 256) & (after < 256)
        self.joined[before[low], after[low]] = True

    def cut(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Code points of all texts, starts and ends of the parts, and the texts' bounds among the parts."""
        seen = [escaped(t) for t in texts]
        codes, bounds = code_points("".join(seen)), offsets(map(len, seen))
        edge = np.zeros(len(codes) + 1, bool)
        if len(codes):
            mark, alone, low = codes == ord(SPACE), self.alone[codes], codes < 256
            pair = np.minimum(codes, 255).astype(np.uint16)
            apart = low[1:] & low[:-1] & ~self.joined.ravel()[(pair[:-1] << np.uint16(8)) | pair[1:]]
            edge[1:-1] = (mark[1:] & ~mark[:-1]) | alone[1:] | alone[:-1] | apart
        edge[bounds] = True
        at = np.flatnonzero(edge)
        starts, ends = at[:-1], at[1:]
        return codes, starts, ends, np.searchsorted(starts, bounds)
