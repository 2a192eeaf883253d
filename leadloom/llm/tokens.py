"""Token ids of whole texts by a public tokenizer file, many texts at a time.

Made for a tokenizer that splits at white space and at a pattern, and knows words by their end (BPE over byte
symbols). Its ids of a text are those of its blank-separated chunks in order, and those of a chunk are the ids of its
pieces. Each Python worker keeps the ids of chunks and pieces it has met (`CACHE` of each at most, then it starts
anew; none after a task), so that only new pieces go through the tokenizer's model. A chunk with characters beyond Latin letters, or
with one of the tokenizer's special strings, goes through the whole tokenizer.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import regex
from tokenizers import Tokenizer

CACHE = 200_000  # about 80 MB for both
#: Fixed value: how the tokenizer cuts a chunk into pieces.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: Characters that its normalisation only lower-cases, one by one.
LATIN = re.compile("[!-~¡-įı-ſ]+")
SPECIAL = re.compile(r"<\|(?:startoftext|endoftext)\|>")


def byte_symbols() -> list[str]:
    """The letter that stands for each byte: printable ones for themselves, the others from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


@lru_cache(maxsize=2)
def loaded(path: str) -> Chunks:
    return Chunks(path)


class Chunks:
    """Packed unsigned 32-bit ids of blank-separated chunks under one tokenizer file."""

    def __init__(self, path: str) -> None:
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.symbols = dict(enumerate(byte_symbols()))
        self.chunks: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def forget(self) -> None:
        """Gives back what was kept: Python workers outlive their task, and later stages need the memory."""
        self.chunks.clear()
        self.pieces.clear()

    def piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            if len(self.pieces) >= CACHE:
                self.pieces.clear()
            text = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.symbols)
            found = self.pieces[piece] = array("I", [t.id for t in self.model.tokenize(text)]).tobytes()
        return found

    def chunk(self, chunk: bytes) -> bytes:
        if chunk.isalpha():  # ASCII letters alone: one piece
            return self.piece(chunk.lower().decode())
        if chunk[:-1].isalpha() and chunk[-1] in b".,":
            return self.piece(chunk[:-1].lower().decode()) + self.piece(chr(chunk[-1]))
        text = chunk.decode()
        if LATIN.fullmatch(text) and not SPECIAL.search(text):
            if text.isalpha():
                return self.piece(text.lower())
            return b"".join(map(self.piece, PIECES.findall(text.lower())))
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def ids(self, text: bytes) -> bytes:
        split = text.split()
        known = self.chunks
        for chunk in set(split).difference(known):
            known[chunk] = self.chunk(chunk)
        found = b"".join(map(known.__getitem__, split))
        if len(known) > CACHE:
            known.clear()
        return found
