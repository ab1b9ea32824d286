"""Token ids of whole texts with a given tokenizer file, each distinct piece of text encoded once a worker.

A byte-level BPE file splits a text by a pattern before it merges bytes, so a text may be cut where the pattern always
ends a part, whatever stands around. Texts are cut there by numpy, equal pieces are told by their very bytes, and only pieces
that a worker has not met go through the tokenizers library. Files of other kinds are encoded text by text.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd

from townledger.llm.common import U64, mix

#: Pieces that a worker keeps; beyond, it begins anew.
PIECES = 400_000
#: New pieces that are encoded before their ids go from lists to an array.
ENCODED = 1 << 13
#: Bytes of a piece that numpy compares (in words of 8); a longer piece is looked up by itself.
WIDE = 32

_OTHER, _LETTER, _DIGIT, _PUNCT, _BLANK, _SPACE, _QUOTE = range(7)
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=U64)


def _classes() -> np.ndarray:
    """The class of each byte; control characters and what is not ASCII are _OTHER, of which nothing is known."""
    kind = np.full(256, _OTHER, np.uint8)
    for b in range(33, 127):
        kind[b] = _LETTER if chr(b).isalpha() else _DIGIT if chr(b).isdigit() else _PUNCT
    kind[ord("'")], kind[32], kind[9:14] = _QUOTE, _BLANK, _SPACE
    return kind


def _cuts() -> np.ndarray:
    """Whether a text may be cut between two bytes of given classes: a part of it never goes on there.

    What is no white space ends before white space; letters end before what is no letter, digits likewise, and punctuation
    before letters and digits. A quote may open a contraction, so nothing is cut after one; nor after white space, which is
    split by what follows.
    """
    cut = np.zeros((8, 8), bool)
    for a in (_LETTER, _DIGIT, _PUNCT, _QUOTE):
        cut[a, [_BLANK, _SPACE]] = True
    cut[_LETTER, [_DIGIT, _PUNCT, _QUOTE]] = True
    cut[_DIGIT, [_LETTER, _PUNCT, _QUOTE]] = True
    cut[_PUNCT, [_LETTER, _DIGIT]] = True
    return cut.ravel()


_KIND, _CUT = _classes(), _cuts()
_ODD = np.isin(np.arange(7), (_OTHER, _SPACE, _QUOTE))
#: The characters that such files write bytes as.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_CHARS = {b: chr(b) for b in _SHOWN} | {b: chr(256 + i) for i, b in enumerate(sorted({*range(256)} - {*_SHOWN}))}


class Encoder:
    """Ids of texts, equal to encode(text, add_special_tokens=False); strings of special tokens are ordinary text."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_file(path)
        self._tok.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        # Texts are cut only where the file is a plain byte-level BPE: no normalizer, no prefix space.
        self._apart = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
        self.forget()

    def forget(self) -> None:
        """Give up the kept pieces; a task does so at its end, since what runs next in its worker may not need them."""
        # Hashes of the kept pieces in order, and each one's number: in arrays, which take a tenth of a dict's memory.
        self._known, self._number = np.zeros(0, U64), np.zeros(0, np.int32)
        self._long: dict[bytes, int] = {}
        self._n = 0
        self._size = np.zeros(1 << 16, np.int64)
        self._words = np.zeros((WIDE // 8, 1 << 16), U64)
        self._at, self._ids = np.zeros((1 << 16) + 1, np.int64), np.zeros(1 << 17, np.uint32)

    def _encode(self, pieces: list[bytes], plain: list[bool]) -> int:
        """Keep the ids of new pieces, of which plain ones are one part of a text by the pattern; the number of the first."""
        model, tok = self._tok.model.tokenize, self._tok.encode
        flat, sizes = [], []
        for lo in range(0, len(pieces), ENCODED):
            some, ones = pieces[lo : lo + ENCODED], plain[lo : lo + ENCODED]
            parts = iter(b"\n".join(p for p, one in zip(some, ones) if one).decode("latin-1").translate(_CHARS).split(_CHARS[10]))
            found = [[t.id for t in model(next(parts))] if one else tok(p.decode(), add_special_tokens=False).ids for p, one in zip(some, ones)]
            flat.append(np.fromiter(chain.from_iterable(found), np.uint32))
            sizes.append(np.array([len(x) for x in found], np.int64))
        first, ids = self._n, np.concatenate(flat)
        self._n += len(pieces)
        at = self._at[first] + np.cumsum(np.concatenate(sizes))
        for name, n in (("_size", self._n), ("_words", self._n), ("_at", self._n + 1), ("_ids", int(at[-1]))):
            old = getattr(self, name)
            if old.shape[-1] < n:
                setattr(self, name, np.concatenate([old, np.zeros((*old.shape[:-1], n), old.dtype)], axis=-1))
        self._at[first + 1 : self._n + 1] = at
        self._ids[self._at[first] : at[-1]] = ids
        return first

    def ids(self, text: str) -> np.ndarray:
        data = np.frombuffer(text.encode(), np.uint8)
        return self.batch(data, np.array([0, len(data)]))[0]

    def batch(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids as unsigned 32-bit numbers, where each text's begin and end) for UTF-8 texts data[offs[i]:offs[i + 1]]."""
        if not self._apart:
            raw = data.tobytes()
            found = self._tok.encode_batch([raw[a:b].decode() for a, b in zip(offs[:-1], offs[1:])], add_special_tokens=False)
            at = np.concatenate([[0], np.cumsum([len(x.ids) for x in found], dtype=np.int64)])
            return np.array([i for x in found for i in x.ids], np.uint32), at
        n = len(data)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        if self._n > PIECES:
            self.forget()
        start, size, plain = _pieces(data, offs)
        number = self._numbers(data, start, size, plain)
        count = self._at[number + 1] - self._at[number]
        end = np.cumsum(count)
        place = np.arange(end[-1]) + np.repeat(self._at[number] - (end - count), count)
        before = np.concatenate([[0], end])
        return self._ids[place], before[np.searchsorted(start, offs)]

    def _numbers(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, plain: np.ndarray) -> np.ndarray:
        """The number of each piece among the kept ones, new ones encoded."""
        words, h = _key(data, start, size)
        code, hashes = pd.factorize(h)
        first = np.empty(len(hashes), np.int64)
        first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
        number = np.full(len(hashes), -1, np.int64)
        if len(self._known):
            by = np.argsort(hashes)
            i = np.minimum(np.searchsorted(self._known, hashes[by]), len(self._known) - 1)
            number[by] = np.where(self._known[i] == hashes[by], self._number[i], -1)
        new = np.flatnonzero((number < 0) & (size[first] <= WIDE))
        if len(new):
            at = first[new]
            base = self._encode([data[a : a + k].tobytes() for a, k in zip(start[at].tolist(), size[at].tolist())], plain[at].tolist())
            self._size[base : self._n] = size[at]
            for k, (some, w) in enumerate(words):
                self._words[k, base : self._n] = w[at] if some is None else _placed(some, w, at)
            number[new] = np.arange(base, self._n)
            by = np.argsort(hashes[new])
            i = np.searchsorted(self._known, hashes[new][by])
            self._known, self._number = np.insert(self._known, i, hashes[new][by]), np.insert(self._number, i, number[new][by])
        out = number[code]
        same = (size <= WIDE) & (self._size[out] == size)
        for k, (some, w) in enumerate(words):
            if some is None:
                same &= self._words[k, out] == w
            else:
                same[some] &= self._words[k, out[some]] == w
        for i in np.flatnonzero(~same).tolist():  # long pieces, and what merely has the hash of another
            piece = data[start[i] : start[i] + size[i]].tobytes()
            if (k := self._long.get(piece)) is None:
                k = self._long[piece] = self._encode([piece], [False])
            out[i] = k
        return out


def _pieces(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and size of the pieces of each text, and whether each is one part: letters, digits or punctuation after a blank at most."""
    n = len(data)
    kind = _KIND[data]
    # U+00C0 to U+017F are letters, but for the signs of multiplication and division.
    led = (data[:-1] >= 0xC3) & (data[:-1] <= 0xC5)
    at = np.flatnonzero(led) + 1
    at = at[~((data[at - 1] == 0xC3) & ((data[at] == 0x97) | (data[at] == 0xB7)))]
    kind[at] = _LETTER
    cut = np.zeros(n + 1, bool)
    cut[1:n] = _CUT[(kind[:-1] << 3) | kind[1:]]
    cut[offs] = True
    cut[n] = False
    start = np.flatnonzero(cut)
    odd = _ODD[kind]
    odd[at - 1] = False
    odd[1:] |= (kind[1:] == _BLANK) & ~cut[1:n]
    return start, np.diff(np.append(start, n)), ~np.logical_or.reduceat(odd, start)


def _key(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[list[tuple[np.ndarray | None, np.ndarray]], np.ndarray]:
    """The first WIDE bytes of the pieces as words of 8, each with the pieces that are so long (None: all), and a hash of words and size."""
    buf = np.zeros(len(data) + WIDE + 8, np.uint8)
    buf[: len(data)] = data
    view = np.ndarray((len(data) + WIDE,), dtype="<u8", buffer=buf, strides=(1,))
    w = view[start] & _MASKS[np.minimum(size, 8)]
    words: list[tuple[np.ndarray | None, np.ndarray]] = [(None, w)]
    h = mix(size.astype(U64) * U64(0x9FB21C651E98DF25) ^ w)
    for k in range(8, WIDE, 8):
        some = np.flatnonzero(size > k)
        w = view[start[some] + k] & _MASKS[np.minimum(size[some] - k, 8)]
        words.append((some, w))
        h[some] = mix(h[some] ^ w)
    return words, h


def _placed(some: np.ndarray, w: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The words of the pieces at, 0 where a piece is shorter; some is in order."""
    if not len(some):
        return np.zeros(len(at), U64)
    i = np.minimum(np.searchsorted(some, at), len(some) - 1)
    return np.where(some[i] == at, w[i], U64(0))


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
