"""Byte-level BPE tokenization with the tokenizers library, one model call per distinct word piece.

The model splits a text into pieces by a fixed pattern before any merge, and merges never cross a piece. So each
distinct piece goes through the library's model once and is kept (in a bounded table); a text's ids are its pieces'
ids in order. Texts with characters outside the plain ranges below, or with a special token's string, are encoded
whole by the library. Tests hold both forms against each other.
"""

from __future__ import annotations

import array
import functools
import json
import os
import re
import sys
import unicodedata

from . import work

#: Kept pieces before the table starts anew, and characters of a piece that is kept: with some 200 bytes a piece, 120 MB.
KEPT, KEPT_CHARS = 600_000, 64
#: Code points whose classes are the same in all Unicode versions in use (Latin, common punctuation).
PLAIN = [(0x0000, 0x001B), (0x0020, 0x024F), (0x2010, 0x2027), (0x2030, 0x205E)]
#: White space among them.
SPACES = "\t\n\x0b\x0c\r \x85\xa0"


def _class(points: list[int]) -> str:
    return "".join(f"\\u{c:04x}" for c in points)


def _splitter() -> tuple[re.Pattern, re.Pattern]:
    """The model's split pattern with its classes written out over the plain ranges; and what lies outside these."""
    plain = [c for a, b in PLAIN for c in range(a, b + 1)]
    letters = _class([c for c in plain if unicodedata.category(chr(c))[0] == "L"])
    numbers = _class([c for c in plain if unicodedata.category(chr(c))[0] == "N"])
    spaces = _class([ord(c) for c in SPACES])
    pieces = rf"'(?:[sdmt]|ll|ve|re)| ?[{letters}]+| ?[{numbers}]+| ?[^{spaces}{letters}{numbers}]+|[{spaces}]+(?![^{spaces}])|[{spaces}]+"
    return re.compile(pieces), re.compile(f"[^{_class(plain)}]")


def _byte_letters() -> list[str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for letters from 256 on, in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in printable)}
    return [chr(hidden.get(b, b)) for b in range(256)]


class _Pieces(dict):
    """Piece to its ids as bytes; a missing one is encoded by the library's model."""

    def __init__(self, model, limit: int):
        super().__init__()
        self.limit = limit
        self.tokenize, self.letters = model.tokenize, _byte_letters()
        self.space = self.letters[32]

    def __missing__(self, piece: str) -> bytes:
        if piece[0] == " " and piece.isascii() and piece[1:].isalpha():
            coded = self.space + piece[1:]
        else:
            coded = "".join([self.letters[b] for b in piece.encode("utf-8", "surrogatepass")])
        ids = array.array("I", [t.id for t in self.tokenize(coded)])
        if sys.byteorder != "little":
            ids.byteswap()
        out = ids.tobytes()
        if len(piece) <= KEPT_CHARS:
            if len(self) >= self.limit:
                self.clear()
            self[piece] = out
        return out


class PieceEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str, kept: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        kind = spec.get("pre_tokenizer") or {}
        self.splits = kind.get("type") == "ByteLevel" and not kind.get("add_prefix_space") and not spec.get("normalizer")
        self.pieces, self.odd = _splitter()
        self.kept = _Pieces(self.model.model, kept)

    def whole(self, text: str) -> bytes:
        """The library's own encoding of the whole text."""
        return array.array("I", self.model.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of one whole text as bytes, 4 for each id."""
        if not self.splits or not text.isascii() and self.odd.search(text) or any(s in text for s in self.special):
            return self.whole(text)
        return b"".join(map(self.kept.__getitem__, self.pieces.findall(text)))


@functools.cache
def encoder(path: str, kept: int | None = None) -> PieceEncoder:
    """One encoder for each worker process. kept: pieces it keeps, where executors have less memory to spare."""
    return PieceEncoder(path, kept or KEPT)


work.CACHES["tokens"] = encoder.cache_clear


def default_tokenizer() -> str:
    """The production tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
