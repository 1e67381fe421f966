"""Exact token ids of a word-level BPE tokenizer, with one tokenization for each distinct word.

The tokenizer's pre-tokenizer never joins what white space parts, and its normalizer maps each word
on its own, so the ids of a text are the ids of its white-space-separated words in order. A worker
keeps the ids of words it has met, by a 64-bit hash of their bytes; only unseen words reach the
tokenizer.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import regex

from . import hashing

#: Words that a worker remembers (some 50 bytes each) before it starts afresh; a bound on memory only, never on results.
CACHE_WORDS = 1_500_000
#: Ids of remembered words, likewise: long words have many.
CACHE_IDS = 8_000_000
#: Pieces of words that a worker remembers as Python objects; likewise only a bound on memory.
CACHE_PIECES = 50_000
#: Text bytes that are tokenized at once.
TOKENIZED_BYTES = 1 << 20
#: Words that are only these characters need no normalizer: it would only lower their case.
_SAFE = re.compile("[!-~¡-ÿ]+")
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where this machine keeps the public vocabulary file; executors call it for themselves."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else 256 + k."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b) if b in shown else chr(next(rest)) for b in range(256)}


class WordIds:
    """Ids of words: sorted hashes, with the place of each word's ids in one flat array."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.letters = _byte_letters()
        self.clear()

    def clear(self) -> None:
        empty = (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))
        self.known, self.recent = empty, empty
        self.flat = np.empty(1 << 16, np.uint32)
        self.used = 0
        self.pieces: dict[str, list[int]] = {}

    def of_word(self, word: str) -> list[int]:
        core, stop = (word[:-1], word[-1]) if word[-1] in ".,!?" else (word, "")
        if core.isalpha() and (core.isascii() or _SAFE.fullmatch(core)):
            return self.of_piece(core.lower()) + (self.of_piece(stop) if stop else [])
        if not _SAFE.fullmatch(word) or "<|" in word:
            return self.tokenizer.encode(word, add_special_tokens=False).ids
        return [i for p in _SPLIT.findall(word.lower()) for i in self.of_piece(p)]

    def of_piece(self, piece: str) -> list[int]:
        ids = self.pieces.get(piece)
        if ids is None:
            shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
            ids = [t.id for t in self.tokenize(shown)]
            if len(self.pieces) >= CACHE_PIECES:
                self.pieces.clear()
            if len(piece) < 24:
                self.pieces[piece] = ids
        return ids

    @staticmethod
    def _find(store: tuple, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(store[0], h)
        at[at == len(store[0])] = 0
        return at, store[0][at] == h if len(store[0]) else np.zeros(len(h), bool)

    def _learn(self, h: np.ndarray, words: list[bytes]) -> None:
        ids = [self.of_word(w.decode()) for w in words]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        more = int(size.sum())
        if self.used + more > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty(max(more, len(self.flat)), np.uint32)])
        self.flat[self.used : self.used + more] = np.fromiter(itertools.chain.from_iterable(ids), np.uint32, more)
        place = self.used + np.cumsum(size) - size
        self.used += more
        new = (h, place, size)
        merged = [np.concatenate(x) for x in zip(self.recent, new, strict=True)]
        order = np.argsort(merged[0], kind="stable")
        self.recent = tuple(x[order] for x in merged)
        if 8 * len(self.recent[0]) > len(self.known[0]):
            merged = [np.concatenate(x) for x in zip(self.known, self.recent, strict=True)]
            order = np.argsort(merged[0], kind="stable")
            self.known = tuple(x[order] for x in merged)
            self.recent = tuple(x[:0] for x in merged)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and where each text's ids start (and the end)."""
        if len(self.known[0]) + len(self.recent[0]) > CACHE_WORDS or self.used > CACHE_IDS:
            self.clear()
        data, at = hashing.join_texts([t.encode() for t in texts])
        starts, ends = hashing.space_words(data)
        h, first, which = np.unique(hashing.word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        _, old = self._find(self.known, h)
        _, lately = self._find(self.recent, h)
        missing = np.flatnonzero(~(old | lately))
        if len(missing):
            raw = data.tobytes()
            s, e = starts[first[missing]].tolist(), ends[first[missing]].tolist()
            self._learn(h[missing], [raw[a:b] for a, b in zip(s, e, strict=True)])
        k, old = self._find(self.known, h)
        r, lately = self._find(self.recent, h)
        place, size = np.empty(len(h), np.int64), np.empty(len(h), np.int64)
        for at_store, hit, store in ((k, old, self.known), (r, lately & ~old, self.recent)):
            place[hit], size[hit] = store[1][at_store[hit]], store[2][at_store[hit]]
        n = size[which]
        end = np.cumsum(n)
        total = int(end[-1]) if len(end) else 0
        ids = self.flat[np.arange(total) + np.repeat(place[which] - (end - n), n)]
        word_at = np.concatenate([[0], end])
        return ids, word_at[np.searchsorted(starts, at)]


_LOADED: dict[str, WordIds] = {}


def word_ids(path: str | None = None) -> WordIds:
    """The tokenizer of this Python worker, loaded once."""
    path = path or tokenizer_path()
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]
