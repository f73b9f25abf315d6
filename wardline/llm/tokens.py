"""Token ids and counts as the tokenizers library gives them, word by word.

Byte-pair merges never cross the pieces that a vocabulary's pattern cuts a text
into, so a text's ids are those of its pieces side by side.  Each task keeps a bounded
number of the pieces it has met; the library merges every piece.
"""

from __future__ import annotations

import hashlib
import re
import struct
from functools import lru_cache, partial

# The pattern that the byte-level vocabulary splits text with, the
# special string both vocabularies know, and white space outside ASCII.
BYTE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPECIAL = "<|"
WIDE_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
# A space beside other white space or at an end of the text.
LOOSE_SPACE = re.compile(r" [\t-\r ]|[\t-\r] |^ | $")
# A word of plain letters and a tail of plain signs; the apostrophe has its own rules.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")

KEPT_PIECES = 150_000


@lru_cache(maxsize=1)
def _byte_signs() -> list[str]:
    """The sign that byte-level vocabularies write each byte as: itself where it is a visible Latin-1 sign, else the next from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in visible else next(others)) for b in range(256)]


def _signs(piece: str) -> str:
    return piece.encode().decode("latin-1").translate(_byte_signs())


@lru_cache(maxsize=4)
def load(path: str):
    """The tokenizer of a file, neither cutting nor padding texts."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def version(path: str) -> str:
    """Digest of everything that decides a count: the file, the library and the options."""
    import tokenizers

    with open(path, "rb") as file:
        content = hashlib.sha256(file.read()).hexdigest()
    return hashlib.sha256(f"{content} {tokenizers.__version__} add_special_tokens=False".encode()).hexdigest()


class _Bounded(dict):
    """A dictionary that fills itself; when it holds too much it starts anew beside what it held last.

    ``make`` must not lead back to the dictionary or its owner: a task's pieces, up to
    100 MB, would then stay in the worker after the task until all objects are searched
    for cycles, beside those of the tasks that follow.
    """

    def __init__(self, make):
        super().__init__()
        self.make = make
        self.last: dict = {}

    def __missing__(self, key):
        if len(self) >= KEPT_PIECES:
            self.last = dict(self)
            self.clear()
        value = self.last.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


def _word_count(split, by_piece: _Bounded, word: str) -> int:
    """Tokens of a word after a lone space."""
    return sum(map(by_piece.__getitem__, split(" " + word)))


class ByteCounter:
    """Counts tokens of the byte-level vocabulary.

    A lone space between two other characters always starts a new piece, so a text
    is cut before each of them.  Texts with other spacing are cut by the whole
    pattern, texts with special strings go through the library as they are.
    """

    def __init__(self, path: str):
        import regex

        self.tokenizer = load(path)
        self.split = regex.compile(BYTE_PATTERN).findall
        # A piece of the pattern goes straight to the merges.
        merge = self.tokenizer.model.tokenize
        self.by_piece = _Bounded(lambda piece: len(merge(_signs(piece))))
        self.by_word = _Bounded(partial(_word_count, self.split, self.by_piece))

    def _sum(self, text: str) -> int:
        return sum(map(self.by_piece.__getitem__, self.split(text)))

    def count(self, text: str) -> int:
        if SPECIAL in text:
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if LOOSE_SPACE.search(text) or WIDE_SPACE.search(text):
            return self._sum(text)
        head, *words = text.split(" ")
        return self._sum(head) + sum(map(self.by_word.__getitem__, words))


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _word_ids(tokenizer, by_piece: _Bounded, word: bytes) -> bytes:
    if word.isalpha():
        return by_piece[word.lower().decode()]
    text = word.decode()
    plain = PLAIN.fullmatch(text)
    if plain is None:
        return _packed(tokenizer.encode(text, add_special_tokens=False).ids)
    letters, signs = plain.groups()
    return by_piece[letters.lower()] + (by_piece[signs] if signs else b"")


class WordEncoder:
    """Ids of the lower-casing vocabulary with word ends, as little-endian 32-bit numbers.

    White space never belongs to a token and always ends a piece, so a text is cut
    at it.  A plain word is its letters and then its signs; any other word goes
    through the library as it is.
    """

    def __init__(self, path: str):
        self.tokenizer = load(path)
        merge = self.tokenizer.model.tokenize
        # Letters and signs of ASCII are written as themselves.
        self.by_piece = _Bounded(lambda piece: _packed([token.id for token in merge(piece if piece.isascii() else _signs(piece))]))
        self.by_word = _Bounded(partial(_word_ids, self.tokenizer, self.by_piece))

    def encode(self, text: bytes) -> bytes:
        return b"".join(map(self.by_word.__getitem__, text.split()))

