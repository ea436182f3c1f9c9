"""Encoders for the public vocabularies, fast on running text and equal to the libraries.

Dictionaries of words only save work: a word that is not held is encoded, one that grows beyond
its room lets its older half go, and every text is encoded whole.
"""

from __future__ import annotations

import base64
import os
import re
import unicodedata
from functools import lru_cache

import numpy as np


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def packed(ids) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return np.asarray(ids, dtype="<u4").tobytes()


#: Where no white space follows white space, the look-ahead of the public pattern decides nothing
#: and may be left out; the expression is then matched by an automaton.
_DOUBLE_SPACE = re.compile(r"\s\s")


class ByteLevel:
    """Byte-level BPE of a rank file, as ``encode_ordinary`` of the tiktoken library."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = pattern = public_tokenizers.PATTERN
        lean = pattern.replace(r"|\s+(?!\S)", "")
        self.full = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.lean = tiktoken.Encoding(path, pat_str=lean, mergeable_ranks=ranks, special_tokens={})
        self.raw = {i: b for b, i in ranks.items()}

    def encode(self, text: str) -> list[int]:
        return (self.full if _DOUBLE_SPACE.search(text) else self.lean).encode_ordinary(text)

    def encode_with(self, text: str, added: dict[str, int]) -> list[int]:
        """As ``encode``, but each string of ``added`` in a text is its id; what lies between is encoded by itself."""
        if not any(a in text for a in added):
            return self.encode(text)
        out: list[int] = []
        for part in re.split("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")", text):
            out += [added[part]] if part in added else self.encode(part)
        return out

    def decode(self, ids: list[int]) -> bytes:
        """The raw bytes of the ids, one after the other."""
        return b"".join(map(self.raw.__getitem__, ids))

    def decode_packed(self, ids: bytes) -> bytes:
        return self.decode(np.frombuffer(ids, dtype="<u4").tolist())


class _Kept(dict):
    """A dictionary that computes what it misses and forgets what it has not used lately."""

    def __init__(self, compute, room: int):
        super().__init__()
        self.compute, self.room, self.older = compute, room, {}

    def __missing__(self, key):
        if len(self) >= self.room:
            self.older = dict(self)
            self.clear()
        value = self.older.get(key)
        self[key] = value = self.compute(key) if value is None else value
        return value


#: Latin text: letter and number tables of all engines agree here, and case mapping needs no context.
_BEYOND_LATIN = re.compile("[^\x00-\u017f]")
_LATIN = [chr(c) for c in range(0x180)]


def _class(*kinds: str) -> str:
    return "".join(re.escape(c) for c in _LATIN if unicodedata.category(c)[0] in kinds)


_SPACE = "\t\n\v\f\r \x85\xa0"
#: Fixed value: the pattern of the word-level vocabulary, for Latin text.
_WORD_PATTERN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_class('L')}]+|[{_class('N')}]|[^{_SPACE}{_class('L', 'N')}]+")


@lru_cache(maxsize=1)
def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


class WordLevel:
    """The lower-cased vocabulary with word ends, as the tokenizers library encodes it.

    Latin text is cut at spaces, into words by the vocabulary's pattern, and each word is merged by
    the library's model; any other text, and one that holds an added token, goes to the library whole.
    """

    def __init__(self, path: str, parts: int = 400_000, words: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.words = _Kept(self._word, words)
        self.parts = _Kept(self._part, parts)

    def _word(self, word: str) -> bytes:
        letters = word if word.isascii() and word.isalnum() else word.encode().decode("latin-1").translate(_byte_letters())
        return packed([t.id for t in self.model.tokenize(letters)])

    def _part(self, part: str) -> bytes:
        return b"".join(map(self.words.__getitem__, _WORD_PATTERN.findall(part.lower())))

    def encode(self, text: str) -> bytes:
        """Packed ids of a whole text."""
        if any(a in text for a in self.added) or _BEYOND_LATIN.search(text):
            return packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self.parts.__getitem__, text.split(" ")))


@lru_cache(maxsize=None)
def byte_level(name: str) -> ByteLevel:
    """The encoder of a rank file; one per Python worker."""
    return ByteLevel(vocabulary(name))


@lru_cache(maxsize=None)
def word_level(name: str) -> WordLevel:
    return WordLevel(vocabulary(name))
