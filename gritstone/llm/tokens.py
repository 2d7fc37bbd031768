"""Token ids of whole texts with a `tokenizers` file, each distinct white-space piece encoded once per worker.

Both public tokenizers cut a text at white space before they merge, so the ids of a text are those of its pieces in
turn. A piece is looked up in a bounded per-worker table and only a new one goes through the library. Texts with white
space other than single spaces and newlines go through the library whole, and so do texts that hold the string of an
added token, which the library turns into that token's id.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

#: Distinct pieces a worker remembers before it starts afresh: about 150 MB.
MAX_PIECES = 800_000
_ODD_SPACE = [c for c in map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)) if c != "\n"]
_ODD_ASCII = [c for c in _ODD_SPACE if c.isascii()]
_DOUBLE = ("  ", " \n", "\n ", "\n\n")


def _byte_characters() -> dict[int, str]:
    """The printable stand-ins of byte-level BPE: printable Latin-1 stands for itself, the rest follows U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class _Pieces(dict):
    """piece -> its ids as bytes."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= MAX_PIECES:
            self.clear()
        self[piece] = ids = self.encode(piece)
        return ids


class PieceTokenizer:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.characters = _byte_characters()
        self.space = self.characters[32]
        whole = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        self.whole = whole
        self.drops_space = whole("a b") == whole("a\nb") == whole("a") + whole("b")
        self.lowers = whole("A") == whole("a")
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)), re.IGNORECASE) if added else None
        self.marks = _Pieces(lambda p: self._bytes(self.whole(p)))
        self.inner = _Pieces(lambda p: self._ids("", p) if self.drops_space or p[0] == "\n" else self._ids(" ", p))

    def _bytes(self, ids) -> bytes:
        return array(self.code, ids).tobytes()

    def _ids(self, before: str, piece: str) -> bytes:
        word = piece.rstrip(".,;:!?#$%&*")
        if not word.isalpha() or not word.isascii() and max(word) > "ÿ":
            return self._bytes(self.whole(before + piece))
        mark = piece[len(word) :]
        word = word.lower() if self.lowers else word
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.characters)
        ids = [t.id for t in self.model.tokenize(self.space + word if before else word)]
        return self._bytes(ids) + self.marks[mark] if mark else self._bytes(ids)

    def encode(self, text: str) -> bytes:
        """The ids of one text, little-endian, of this tokenizer's dtype."""
        if not text:
            return b""
        if any(c in text for c in (_ODD_ASCII if text.isascii() else _ODD_SPACE)) or self.added and self.added.search(text):
            return self._bytes(self.whole(text))
        if self.drops_space:
            return b"".join(map(self.inner.__getitem__, text.split()))
        if any(pair in text for pair in _DOUBLE):
            return self._bytes(self.whole(text))
        first, *rest = text.replace("\n", " \n").split(" ") if "\n" in text else text.split(" ")
        if rest and not rest[-1]:
            return self._bytes(self.whole(text))
        head = self._bytes(self.whole(first)) if first else b""
        return head + b"".join(map(self.inner.__getitem__, rest))


_loaded: dict[str, PieceTokenizer] = {}


def piece_tokenizer(path: str) -> PieceTokenizer:
    """One tokenizer per worker process and file."""
    if path not in _loaded:
        _loaded.clear()
        _loaded[path] = PieceTokenizer(path)
    return _loaded[path]
