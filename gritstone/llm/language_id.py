"""Language identification with language-bitmask n-gram filters.

Each language has a Bloom filter of its most frequent character 4-grams. The filters are stored bit-sliced: entry j of
the table holds bit j of every language's filter, so looking up an n-gram's few entries and and-ing them gives the mask of
all languages that contain it. A text's mask bits are counted per language; the counts are corrected for the filters'
false positives, and the language with the most n-grams wins.

Learning takes about `max_rows` labelled texts per language (chosen by a hash of the id), whole; prediction takes every
text whole and needs no shuffle. The table's size depends on the number of languages only.

Cases: null texts and texts without a letter are 'und' with score 0; texts with letters but no known n-gram get the
language with most labelled rows, score 0; null labels teach nothing; ties go to the first language in order; without labelled rows
everything is 'und'; repeated rows are predicted each; an empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gritstone.llm.common import clipped, text_slices
from gritstone.llm.words import GRAM_CODE, U, mix

GRAM = 4
#: n-grams per language, table entries and hashes: false positives near 0.2 %.
PROFILE, ENTRIES, HASHES = 20_000, 1 << 19, 3
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def text_grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all character n-grams, the text of each, and which texts have a letter.

    Lower case; each run of other characters counts as one space, and a text is padded with one.
    """
    points = np.frombuffer("\0".join(["", *pc.utf8_lower(texts).to_pylist(), ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    # a text's own U+0000 is no boundary: boundaries are counted from the lengths
    lengths = pc.utf8_length(pc.utf8_lower(texts)).to_numpy(zero_copy_only=False).astype(np.int64)
    edges = np.cumsum(np.append(0, lengths + 1))
    letter = letters()[points]
    edge = np.zeros(len(points), bool)
    edge[edges] = True
    keep = letter | edge
    keep[1:] |= letter[:-1]
    place = np.cumsum(edge) - 1
    values = np.where(letter, points, 32).astype(np.uint32)[keep]
    doc, edge, letter = place[keep], edge[keep], letter[keep]
    has_letter = np.bincount(doc[letter], minlength=len(texts))[: len(texts)] > 0
    m = len(values) - GRAM + 1
    if m <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64), has_letter
    total = np.zeros(m, U)
    for j in range(GRAM):
        total += values[j : j + m].astype(U) * GRAM_CODE[j]
    # an edge may be a gram's first character (the text's leading space), or its last (that of the next)
    inside = ~np.logical_or.reduce([edge[j : j + m] for j in range(1, GRAM - 1)]) & ~(edge[:m] & edge[GRAM - 1 : GRAM - 1 + m])
    return mix(total[inside]), doc[:m][inside], has_letter


def _gram_counts(rows: DataFrame) -> DataFrame:
    """lang, gram, n, pre-aggregated per slice of texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            names = np.array(batch.column(1).to_pylist(), object)
            grams, doc, _ = text_grams(batch.column(0))
            for name in sorted(set(names)):
                found, n = np.unique(grams[(names == name)[doc]], return_counts=True)
                yield pa.record_batch([pa.array([name] * len(found), pa.string()), pa.array(found.view(np.int64)), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    return rows.select("text", "lang").mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class BitSlicedFilters:
    """Bloom filters of up to 64 languages in one table of masks."""

    def __init__(self, grams: list[np.ndarray]):
        bits = next(b for b in (8, 16, 32, 64) if b >= len(grams))
        self.n, self.table = len(grams), np.zeros(ENTRIES, f"u{bits // 8}")
        for k, own in enumerate(grams):
            for at in self._entries(own):
                self.table[at] |= self.table.dtype.type(1 << k)
        fill = np.array([np.count_nonzero(self.table >> k & 1) for k in range(self.n)]) / ENTRIES
        self.false_positive = fill**HASHES

    @staticmethod
    def _entries(grams: np.ndarray) -> Iterator[np.ndarray]:
        """Positions from slices of the hash."""
        for k in range(HASHES):
            yield ((grams >> U(20 * k)) & U(ENTRIES - 1)).astype(np.int64)

    def masks(self, grams: np.ndarray) -> np.ndarray:
        """The languages that contain each n-gram, as bits."""
        found = np.full(len(grams), self.table.dtype.type(~self.table.dtype.type(0)))
        for at in self._entries(grams):
            found &= self.table[at]
        return found

    def counts(self, grams: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
        """n-grams per text and language, without the false positives to be expected."""
        masks, total = self.masks(grams), np.bincount(doc, minlength=n_docs)[:n_docs]
        raw = np.stack([np.bincount(doc, masks >> k & 1, n_docs)[:n_docs] for k in range(self.n)], 1)
        return np.maximum(0, (raw - total[:, None] * self.false_positive) / (1 - self.false_positive))


def learn_filters(docs: DataFrame, may_learn: Column, *, max_rows: int = 4000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], str, list[BitSlicedFilters]]:
    """Languages, the most frequent one, and the filters (64 languages each).

    The driver holds PROFILE n-grams for each language.
    """
    known = clipped(docs.where(may_learn), id_col, text_col, lang_col).toDF("id", "text", "lang").where("lang IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return [], "und", []
    share = F.create_map(*(x for k, n in sizes.items() for x in (F.lit(k), F.lit(max_rows / n))))
    sample = known.where(F.pmod(F.xxhash64("id", "text"), F.lit(1 << 20)) < F.element_at(share, F.col("lang")) * (1 << 20))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = _gram_counts(sample).withColumn("place", F.row_number().over(best)).where(F.col("place") <= PROFILE).select("lang", "gram").toPandas()
    langs = sorted(sizes)
    profiles = [top.loc[top["lang"] == k, "gram"].to_numpy(np.int64).view(U) for k in langs]
    usual = max(langs, key=lambda k: sizes[k])
    return langs, usual, [BitSlicedFilters(profiles[at : at + 64]) for at in range(0, len(langs), 64)]


def identify(docs: DataFrame, model: tuple[list[str], str, list[BitSlicedFilters]], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score (the winner's share of all languages' n-grams)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, usual, filters = held.value
        for batch in text_slices(batches, "text"):
            grams, doc, has_letter = text_grams(batch.column(1))
            n = batch.num_rows
            counts = np.concatenate([f.counts(grams, doc, n) for f in filters], 1) if filters else np.zeros((n, 1))
            best, total = counts.argmax(1), counts.sum(1)
            score = np.where(total > 0, counts[np.arange(n), best] / np.maximum(total, 1e-300), 0.0)
            names = [(langs[b] if t > 0 else usual) if ok else "und" for b, t, ok in zip(best.tolist(), total.tolist(), has_letter.tolist(), strict=True)]
            yield pa.record_batch([batch.column(0), pa.array(names, pa.string()), pa.array(np.where(has_letter, score, 0.0))], names=["id", "lang_pred", "score"])

    rows = clipped(docs, id_col, text_col).toDF("id", "text")
    return rows.mapInArrow(predict, f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double")


def op2(spark: SparkSession, docs: DataFrame) -> DataFrame:
    held_out = lambda c: F.coalesce(F.crc32(F.col(c).cast("string").cast("binary")) % 3 == 1, F.lit(False))
    found = identify(docs, learn_filters(docs, ~held_out("doc_id")))
    return found.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "lang_pred", "score")
