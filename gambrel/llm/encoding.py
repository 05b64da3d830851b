"""Encoding with a public tokenizer file, each distinct chunk of text once.

A chunk is a run of white space with what follows it up to the next white space. Byte-level pre-tokenizers never join
characters across the start of a chunk, so the ids of a text are those of its chunks, end to end. What the library gives
for a chunk is kept in a bounded table of the worker process. Texts with special strings, or with white space other than
the four plain kinds, go to the library whole.
"""

from __future__ import annotations

import re
import sys
from array import array
from functools import lru_cache
from operator import itemgetter

import numpy as np

#: Chunks of a generation. A worker process remembers two at most: what the younger one lacks and the older one has moves
#: over, and the older one goes when the younger is full, which changes speed only.
MEMO_CHUNKS = 400_000
#: Longer chunks are encoded each time.
MEMO_CHARS = 48
#: White space and invisible characters on whose class two libraries may differ.
ODD = [chr(c) for c in (0, 11, 12, *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF)]
_ASCII_ODD = [c for c in ODD if c.isascii()]
_CHUNK = re.compile("[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+")
#: Letters, then ASCII signs other than the apostrophe (contractions): two pieces for every tokenizer at hand.
_SIGNS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")
_PROBES = ["a", "the", "House", "zebra", "été", "Über", "ñandú", "qwertyuiop", "THTH", "x"]


class _Run(Exception):
    """A run of white space: the text needs the careful split."""


class _Memo(dict):
    """From a chunk to what ``make`` gives for it. A word with signs behind it is the sum of both, as is one white-space
    character with a word behind it; signs and such characters have a small table of their own.
    """

    def __init__(self, make, word, bare: bool):
        super().__init__()
        self.make, self.word, self.bare, self.parts, self.older = make, word, bare, {}, {}

    def part(self, text: str):
        value = self.parts.get(text)
        if value is None:
            if len(self.parts) >= MEMO_CHUNKS // 16:
                self.parts.clear()
            value = self.parts[text] = self.make("", text)
        return value

    def __missing__(self, chunk: str):
        value = self.older.get(chunk)
        if value is None:
            value = self._made(chunk)
        if len(chunk) <= MEMO_CHARS:
            if len(self) >= MEMO_CHUNKS:
                self.older = dict(self)
                self.clear()
            self[chunk] = value
        return value

    def _made(self, chunk: str):
        if _plain(chunk):
            return self.word(" ", chunk)
        if not chunk or chunk.isspace():
            raise _Run
        if chunk[0].isspace():
            return self.part(chunk[0]) + self.word("", chunk[1:]) if self.bare and _plain(chunk[1:]) else self.make("", chunk)
        word = chunk.rstrip(_SIGNS)
        if len(word) < len(chunk) and _plain(word):
            return self[word] + self.part(chunk[len(word) :])
        return self.make(" ", chunk)


def _plain(word: str) -> bool:
    """Whether a word is all Latin letters."""
    return word.isalpha() and (word.isascii() or max(word) <= "\xff")


def _look(memo: _Memo, chunks: list[str]):
    """The memo's values, in order; one C call for all chunks."""
    return itemgetter(*chunks)(memo) if len(chunks) > 1 else [memo[c] for c in chunks]


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.width = 2 if self.tok.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.dtype = np.dtype("<u2" if self.width == 2 else "<u4")
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        rest = (b for b in range(256) if b not in plain)
        self._byte_chars = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}
        self._lower = bool(self.tok.normalizer) and self.tok.normalizer.normalize_str("House") == "house"
        self._direct = False
        self._direct = all(self._word(g, w) == self._library(g + w) for g in ("", " ") for w in _PROBES)
        bare = all(self._library(g + w) == self._library(g) + self._library(w) for g in "\n\t\r" for w in _PROBES)
        word = self._word if self._direct else self._ids
        self.packed = _Memo(lambda gap, chunk: self._pack(self._ids(gap, chunk)), lambda gap, chunk: self._pack(word(gap, chunk)), bare)
        self.counts = _Memo(lambda gap, chunk: len(self._ids(gap, chunk)), lambda gap, chunk: len(word(gap, chunk)), bare)

    def _library(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def _word(self, gap: str, word: str) -> list[int]:
        """The library's merges for one word of Latin letters, which is one piece; probes at the start prove that."""
        gap, word = ("", word.lower()) if self._lower else (gap, word)
        if word.isascii():
            chars = self._byte_chars[ord(gap)] + word if gap else word
        else:
            chars = (gap + word).encode().decode("latin-1").translate(self._byte_chars)
        return [t.id for t in self.tok.model.tokenize(chars)]

    def _pack(self, ids: list[int]) -> bytes:
        packed = array("H" if self.width == 2 else "I", ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def _ids(self, gap: str, chunk: str) -> list[int]:
        if self._direct and _plain(chunk):
            return self._word(gap, chunk)
        return self._library(gap + chunk)

    def _whole(self, text: str) -> bool:
        odd = _ASCII_ODD if text.isascii() else ODD
        return any(c in text for c in odd) or any(s in text for s in self.special)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned integers of ``width`` bytes, without added special tokens."""
        if not text:
            return b""
        if self._whole(text):
            return self._pack(self._library(text))
        plain = text
        for space in "\n\t\r":
            if space in plain:
                plain = plain.replace(space, " " + space)
        first, *chunks = plain.split(" ")
        try:
            if not first:
                raise _Run
            return self._first(first) + b"".join(_look(self.packed, chunks))
        except _Run:
            return b"".join(map(self._first, _CHUNK.findall(text)))

    def _first(self, chunk: str) -> bytes:
        """A chunk as it stands: one that starts with a single space and no more is looked up without it."""
        if chunk[0] == " " and len(chunk) > 1 and not chunk[1].isspace():
            return self.packed[chunk[1:]]
        return self._pack(self._ids("", chunk))

    def count(self, text: str) -> int:
        """The number of ids, for tokenizers that drop white space."""
        if self._whole(text):
            return len(self._library(text))
        for space in "\n\t\r":
            if space in text:
                text = text.replace(space, " ")
        return sum(_look(self.counts, list(filter(None, text.split(" ")))))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def widen(packed: bytes, width: int) -> np.ndarray:
    return np.frombuffer(packed, "<u2" if width == 2 else "<u4").astype("<u4")
