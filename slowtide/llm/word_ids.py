"""Token ids of whole texts from a tokenizer that never looks across words.

The tokenizer encodes each distinct word once per Python worker; numpy finds the
words, looks them up by hash and strings their ids together.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import tokenizers

from slowtide.llm.codes import Memory, Sums, code_points, offsets, ragged

#: Words whose ids a worker remembers (about 40 bytes each); the memory starts anew beyond it.
REMEMBERED = 1_500_000
SPACE, LETTER, DIGIT, SYMBOL, ODD = range(5)
#: Fixed value: what may follow an apostrophe as a word of its own.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
_ENCODERS: dict[str, WordEncoder] = {}


def _kind(code: int) -> int:
    char, group = chr(code), unicodedata.category(chr(code))
    if char in " \t\n\r":
        return SPACE
    if group.startswith("Z") or group == "Cc":
        return ODD
    return LETTER if group.startswith("L") else DIGIT if group.startswith("N") else SYMBOL


KIND = np.array([_kind(i) for i in range(256)] + [ODD], np.uint8)
LOWER = np.array([ord(chr(i).lower()) for i in range(256)], np.uint32)


class WordEncoder:
    """Ids of texts from the tokenizer of a vocabulary whose words end in marked tokens.

    Words of Latin-1 characters are found here as the tokenizer finds them: runs of
    letters, single digits, runs of other marks, and endings after an
    apostrophe, all in lower case. A stretch between spaces that holds anything
    else (other scripts, control characters, a special token's name) is handed
    to the tokenizer whole.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.memory = Memory(remembered)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and the texts' bounds in it (one more than texts)."""
        codes = code_points("\n".join(texts))
        kind = KIND[np.minimum(codes, 256)]
        odd = kind == ODD
        names = np.flatnonzero((codes[:-1] == ord("<")) & (codes[1:] == ord("|"))) if len(codes) > 1 else []
        odd[names] = True
        if odd.any():
            space = kind == SPACE
            word = np.cumsum(space)
            taken = np.zeros(int(word[-1]) + 1, bool)
            taken[word[odd]] = True
            odd = taken[word] & ~space
            kind[odd] = ODD
        codes = np.where(odd, codes, LOWER[np.minimum(codes, 255)])
        starts, ends = self._words(codes, kind)
        raw = kind[starts] == ODD
        hashes = Sums(codes).hashes(starts, ends) ^ (raw.astype(np.uint64) * np.uint64(0x5851F42D4C957F2D))
        distinct, at, which = np.unique(hashes, return_index=True, return_inverse=True)
        new = np.flatnonzero(self.memory.missing(distinct))
        if len(new):
            part = list(zip(starts[at[new]].tolist(), ends[at[new]].tolist()))
            words = [codes[s:e].tobytes().decode("utf-32-le") for s, e in part]
            self.memory.add(distinct[new], *self._encode_words(words, raw[at[new]]))
        found = self.memory.look(distinct)[0][which]
        counts = self.memory.count[found]
        ids = self.memory.values[ragged(self.memory.first[found], counts)].astype(np.uint32)
        bounds = np.searchsorted(starts, offsets(len(t) + 1 for t in texts))
        return ids, np.concatenate([[0], np.cumsum(counts)])[bounds]

    def _words(self, codes: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        edge = np.ones(len(codes) + 1, bool)
        if len(codes):
            edge[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        at = np.flatnonzero((codes == ord("'")) & (kind == SYMBOL))
        at = at[edge[at] & edge[at + 1]]
        for own in at[kind[np.minimum(at + 1, len(codes) - 1)] == LETTER]:
            following = "".join(map(chr, codes[own + 1 : own + 3]))
            ending = next((e for e in ENDINGS if following.startswith(e)), None)
            if ending and (kind[own + 1 : own + 1 + len(ending)] == LETTER).all():
                edge[own + 1], edge[own + 1 + len(ending)] = False, True
        bounds = np.flatnonzero(edge)
        keep = kind[bounds[:-1]] != SPACE
        return bounds[:-1][keep], bounds[1:][keep]

    def _encode_words(self, words: list[str], raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(words)
        for i in np.flatnonzero(raw):
            found[i] = np.array(self.tokenizer.encode(words[i], add_special_tokens=False).ids, np.uint32)
        plain = np.flatnonzero(~raw)
        for first in range(0, len(plain), 1024):
            part = plain[first : first + 1024]
            ids = np.array(self.tokenizer.encode(" ".join([words[i] for i in part]), add_special_tokens=False).ids, np.uint32)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(part):
                raise ValueError("the tokenizer does not mark the ends of its words")
            for i, own in zip(part, np.split(ids, ends[:-1])):
                found[i] = own
        return np.concatenate(found), np.array([len(f) for f in found], np.int64)


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
