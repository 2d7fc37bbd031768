"""Quality rules: word, symbol, line and window counts, and repeated substrings from a suffix array.

The suffix array of a text is built over its 3-word windows by prefix doubling, for many texts at once; only positions
whose window occurs again enter it, since no other position starts a repeat of three words. Longest common prefixes of
neighbours give, for each position, the longest substring there that occurs elsewhere in the text; these are the
maximal repeats, and the union of their spans is what the text repeats. A text is rejected when the repeats of at
least `min_words` words cover more than `max_covered` of its words, or when one is longer than `max_repeat` words.

Memory in a task is that of about a megabyte of text, or of the longest text: a few numbers per word, and for the
positions in repeats one number per doubling.

Cases: null text counts as empty (no words, so it fails the base rule); texts are judged whole and alone, so ties and
repeated rows get the same result each; an empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gritstone.llm.common import clipped, slices_with_texts, text_slices
from gritstone.llm.words import BYTE_CODE, IS_SPACE, U, Words, power_tables, gram_hashes, mix, words_of

WINDOW = 3
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_DOC_CODE = U(0xA24BAED4963EE407)


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set between consecutive offsets."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def duplicate_lines(words: Words) -> np.ndarray:
    """Per text, the lines with a word that equal an earlier line of the text."""
    data, offsets = words.data, words.offsets
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(n, np.int64)
    start = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], np.flatnonzero(data[:-1] == 10) + 1]))
    end = np.append(start[1:], len(data))
    end = end - (data[end - 1] == 10)
    has_word = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    start, end = start[has_word], end[has_word]
    doc = np.searchsorted(offsets, start, "right") - 1
    up, down = power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(BYTE_CODE[data] * up[: len(data)], out=sums[1:])
    line = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93)) + doc.astype(U) * _DOC_CODE
    order = np.argsort(line, kind="stable")
    again = np.zeros(len(line), bool)
    again[order[1:]] = line[order[1:]] == line[order[:-1]]
    return np.bincount(doc[again], minlength=n)


@dataclass
class Repeats:
    """at: positions (of words) that start a repeat; length: words of the longest one there."""

    at: np.ndarray
    length: np.ndarray

    def covered(self, n_words: int, min_words: int) -> np.ndarray:
        """Which words lie in a repeat of at least min_words words."""
        long = self.length >= min_words
        edge = np.zeros(n_words + 1, np.int64)
        np.add.at(edge, self.at[long], 1)
        np.add.at(edge, self.at[long] + self.length[long], -1)
        return np.cumsum(edge[:-1]) > 0


def maximal_repeats(hashes: np.ndarray, doc: np.ndarray) -> Repeats:
    """The longest repeated substring of at least WINDOW words at each position, within each text."""
    symbols, at = gram_hashes(hashes, doc, WINDOW)
    n = len(hashes)
    if not len(at):
        return Repeats(np.zeros(0, np.int64), np.zeros(0, np.int64))
    symbols = symbols + doc[at].astype(U) * _DOC_CODE
    order = np.argsort(symbols)
    ordered = symbols[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    size = np.diff(np.append(first, len(ordered)))
    rank = np.full(n, -1, np.int64)
    rank[at[order]] = np.repeat(first, size)
    active = at[order][np.repeat(size > 1, size)]
    if not len(active):
        return Repeats(np.zeros(0, np.int64), np.zeros(0, np.int64))
    kept = np.sort(active)
    place = np.full(n, -1, np.int32)  # of a position among those kept
    place[kept] = np.arange(len(kept))
    levels, length = [rank[kept]], 1
    while len(active):
        later = active + length
        inside = later < n
        inside[inside] = doc[later[inside]] == doc[active[inside]]
        second = np.full(len(active), -1, np.int64)
        second[inside] = rank[later[inside]]
        pair = rank[active] * (n + 1) + second + 1
        order = np.argsort(pair)
        active, pair = active[order], pair[order]
        old = rank[active]
        new_old = np.concatenate([[True], old[1:] != old[:-1]])
        new_pair = np.concatenate([[True], pair[1:] != pair[:-1]])
        index = np.arange(len(active))
        old_start = np.maximum.accumulate(np.where(new_old, index, 0))
        pair_start = np.maximum.accumulate(np.where(new_pair, index, 0))
        rank[active] = old + pair_start - old_start
        starts = np.flatnonzero(new_pair)
        size = np.diff(np.append(starts, len(active)))
        active = active[np.repeat(size > 1, size)]
        levels.append(rank[kept])
        length *= 2
    suffixes = kept[np.argsort(rank[kept])]
    left, right = suffixes[:-1], suffixes[1:]
    same = np.zeros(len(left), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        a, b = left + same, right + same
        a, b = np.where(a < n, place[np.minimum(a, n - 1)], -1), np.where(b < n, place[np.minimum(b, n - 1)], -1)
        both = (a >= 0) & (b >= 0)
        both[both] = levels[k][a[both]] == levels[k][b[both]]
        same += np.where(both, 1 << k, 0)
    most = np.zeros(len(suffixes), np.int64)
    most[:-1] = same
    most[1:] = np.maximum(most[1:], same)
    return Repeats(suffixes, most + WINDOW - 1)


def verdicts(texts: pa.Array, min_words: int, max_covered: float, max_repeat: int) -> dict[str, np.ndarray]:
    """Counts and verdict of each text."""
    words = words_of(texts)
    n = len(words.start)
    repeats = maximal_repeats(words.hashes(lower=False), words.doc)
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, words.doc[repeats.at], repeats.length)
    n_words = words.per_doc
    repeated = _per_text(repeats.covered(n, WINDOW), words.bounds)
    covered = _per_text(repeats.covered(n, min_words), words.bounds)
    failed = (n_words < 50) | (100 * repeated > 50 * n_words)
    return {
        "n_words": n_words,
        "word_chars": _per_text(_starts_code_point(words), words.offsets),
        "n_symbols": _per_text(_SYMBOL[words.data], words.offsets),
        "n_dup_lines": duplicate_lines(words),
        "n_repeat_words": repeated,
        "base_failed": failed,
        "covered_words": covered,
        "longest_repeat": longest,
        "kept": ~failed & (covered <= max_covered * n_words) & (longest <= max_repeat),
    }


def quality_rules(docs: DataFrame, *, min_words: int = 8, max_covered: float = 0.4, max_repeat: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and verdict per document: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    covered_words, longest_repeat, kept. No shuffle."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            counts = verdicts(batch.column(1), min_words, max_covered, max_repeat)
            yield pa.record_batch([batch.column(0), *(pa.array(v) for v in counts.values())], names=["id", *counts])

    rows = clipped(docs, id_col, text_col).toDF("id", "text")
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(judge, f"id {kind}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, covered_words bigint, longest_repeat bigint, kept boolean")


def good_documents(docs: DataFrame, *, min_words: int = 8, max_covered: float = 0.4, max_repeat: int = 100, text_col: str = "text") -> DataFrame:
    """The documents that the rules keep, with all their columns; decided in place, without a join."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices_with_texts(batches, text_col):
            yield batch.filter(pa.array(verdicts(texts, min_words, max_covered, max_repeat)["kept"]))

    return docs.mapInArrow(keep, docs.schema)


def _starts_code_point(words: Words) -> np.ndarray:
    return ((words.data & 0xC0) != 0x80) & ~IS_SPACE[words.data]


def op10(docs: DataFrame) -> DataFrame:
    return quality_rules(docs).withColumnRenamed("id", "doc_id")
