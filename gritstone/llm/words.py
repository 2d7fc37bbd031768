"""Words of many texts at once, as numpy arrays over the texts' UTF-8 bytes.

A word is a run of code points other than space and U+0009 to U+000D; A-Z count as a-z on request. All
whitespace of this definition is ASCII, so bytes can stand for code points when words are cut.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_BYTES = np.arange(256)
IS_SPACE = (_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D))
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)

U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_LOWER_CODE = BYTE_CODE[LOWER]
GRAM_CODE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * U(2) + U(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, U), np.ones(1, U))


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = 1 << int(n - 1).bit_length()
        made = []
        for base in (_BASE, _INVERSE):
            table = np.full(size, base, U)
            table[0] = 1
            made.append(np.multiply.accumulate(table))
        if size > 1 << 23:  # for one very long text only; not kept
            return made[0], made[1]
        _powers = (made[0], made[1])
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a large_string array without nulls and the n + 1 offsets of its texts in them."""
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    held = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return held, offsets - offsets[0]


@dataclass
class Words:
    """start, end: byte positions; doc: the text's number; bounds: each text's first word, and the total."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    bounds: np.ndarray

    @property
    def per_doc(self) -> np.ndarray:
        return np.diff(self.bounds)

    def hashes(self, lower: bool = True) -> np.ndarray:
        """64-bit hashes of the words: a polynomial over random byte codes, mixed with the length."""
        if not len(self.start):
            return np.zeros(0, U)
        up, down = power_tables(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, U)
        np.cumsum((_LOWER_CODE if lower else BYTE_CODE)[self.data] * up[: len(self.data)], out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * down[self.start] + (self.end - self.start).astype(U) * U(0xD6E8FEB86659FD93))


def words_of(texts: pa.Array) -> Words:
    data, offsets = text_bytes(texts)
    solid = ~IS_SPACE[data]
    starts = solid.copy()
    starts[1:] &= ~solid[:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    starts[inner] = solid[inner]
    ends[inner - 1] = solid[inner - 1]
    start = np.flatnonzero(starts)
    end = np.flatnonzero(ends) + 1
    bounds = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    return Words(data, offsets, start, end, doc, bounds)


def gram_hashes(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words within a text, and the position of each run's first word."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    total = np.full(m, n, U)
    for j in range(n):
        total += hashes[j : j + m] * GRAM_CODE[j]
    at = np.flatnonzero(doc[:m] == doc[n - 1 : n - 1 + m])
    return mix(total[at]), at
