"""Token ids of whole texts by a public tokenizer file, remembered word by word.

A pre-tokenizer never lets a token cross from white space into the next word, so a text's ids
are those of its chunks in order. Chunks repeat; each task remembers those seen lately. New
chunks of plain letters and trailing marks are cut by rule and go to the tokenizer's model at
once; all others take the tokenizer's whole way of normalising and cutting.
"""

from __future__ import annotations

import array
import os
import re
import sys
from collections.abc import Callable
from functools import lru_cache

from tokenizers import Tokenizer

CHUNKS = 250_000  # chunks of one generation that a task remembers
#: The code points of Unicode's White_Space property, as the byte-level pattern has them.
SPACE = ("\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
         "\u2028\u2029\u202f\u205f\u3000")
#: Letters without accents of their own, and marks that no pattern joins with letters.
PLAIN_LETTERS, MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", ".,!?;:*%&$#|"
#: A space belongs to the word after it; of other white space the last character stands alone before a word.
BYTE_LEVEL = re.compile(
    f" ?[{PLAIN_LETTERS}]++(?=[{SPACE}{MARKS}]|$)|[{MARKS}]++(?=[{SPACE}]|$)"
    f"| ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
WORD_LEVEL = re.compile(f"[{PLAIN_LETTERS}]++(?=[{SPACE}{MARKS}]|$)|[{MARKS}]++(?=[{SPACE}]|$)|[^{SPACE}]+")
ODD_CASE = "Σİ"  # letters that Python lowers by their place or into two, the tokenizer does not


def word_chunks(text: str) -> list[str]:
    """Chunks for tokenizers that lower the case and drop white space."""
    return WORD_LEVEL.findall(text if any(c in text for c in ODD_CASE) else text.lower())


#: Letters, then marks: two pre-tokens for either kind of pattern.
PLAIN = re.compile(f"( ?[{PLAIN_LETTERS}]+)([{MARKS}]*)")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1
    characters for themselves, the others numbered on from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + others.index(b)) for b in range(256)]


LETTERS = byte_letters()


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def packed(ids: list[int]) -> bytes:
    out = array.array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Encoder(dict):
    """Chunk to its ids as little-endian unsigned 32-bit integers, in two generations."""

    def __init__(self, path: str, byte_level: bool, known: int = CHUNKS, special_as_text: bool = False):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        # By default, as the plain call does, the strings of added tokens in a raw text are those
        # tokens: they are cut out first and the pieces between are encoded alone, where such a
        # string (made by lower-casing, say) is text. ``special_as_text`` reads them all as text.
        self.tokenizer.encode_special_tokens = True
        added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.added = None if special_as_text or not added else (
            re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))),
            {k: packed([v]) for k, v in added.items()})
        self.split = BYTE_LEVEL.findall if byte_level else word_chunks
        self.lowers, self.known, self.older = not byte_level, known, {}

    def plain(self, chunk: str) -> bytes | None:
        """The ids of a chunk of plain letters and marks; None if it is another."""
        found = PLAIN.fullmatch(chunk)
        if not found:
            return None
        word, marks = found.groups()
        if marks:
            return self[word] + self[marks]
        if self.lowers and (low := word.lower()) != word:
            return self[low]
        letters = "".join([LETTERS[b] for b in word.encode()])
        return packed([t.id for t in self.tokenizer.model.tokenize(letters)])

    def __missing__(self, chunk: str) -> bytes:
        value = self.older.get(chunk)
        if value is None:
            value = self.plain(chunk)
        if value is None:
            value = packed(self.tokenizer.encode(chunk, add_special_tokens=False).ids)
        if len(self) >= self.known:
            self.older = dict(self)
            self.clear()
        self[chunk] = value
        return value

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.added is None or not self.added[0].search(text):
            return b"".join(map(self.__getitem__, self.split(text)))
        found, token = self.added
        out, start = [], 0
        for m in found.finditer(text):
            piece = text[start:m.start()]
            if piece:
                out.append(b"".join(map(self.__getitem__, self.split(piece))))
            out.append(token[m.group()])
            start = m.end()
        if start < len(text):
            out.append(b"".join(map(self.__getitem__, self.split(text[start:]))))
        return b"".join(out)


@lru_cache(maxsize=4)
def encoder(path: str, byte_level: bool, special_as_text: bool = False) -> Encoder:
    """The encoder of this process; later tasks of the same worker find its chunks again."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Encoder(path, byte_level, special_as_text=special_as_text)


def end_mark(token: int) -> bytes:
    return token.to_bytes(4, "little")
