"""Fill-in-the-middle transformation: each text is cut at two token ranks, found by overlapping chunks.

A token ends after a byte that is no white space where white space or the text's end follows, and at the text's end.
That looks at two adjacent bytes only (white space is ASCII, so UTF-8 bytes do), so every chunk of a text, read with one
byte of the next, counts its own token ends independently of all others. Prefix sums over the counts tell which chunk
owns each of the two cut ranks; only those chunks are scanned again for the place itself. Positions of tokens are never
kept, and counts are taken a span of chunks at a time, so that memory beyond the texts themselves stays bounded.

Cases: a null text counts as empty; an empty text or one that contains a marker stays plain; a text of white space only
is one token; a null id seeds as the word null; repeated ids are cut by the same numbers; an empty table gives no rows;
extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritstone.llm.common import clipped, text_slices

#: The markers of the three parts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKER = "<[PSM]>"
#: Bytes of a chunk, and chunks whose counts are taken at once.
CHUNK, SPAN_CHUNKS = 4096, 256
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


class Chunks:
    """Texts that lie one after the other in `data`, text i from bounds[i] to bounds[i + 1], cut into chunks."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, chunk: int = CHUNK):
        self.data, self.bounds = data, bounds
        per_doc = -(-np.diff(bounds) // chunk)
        self.first = np.concatenate([[0], np.cumsum(per_doc)])  # a text's first chunk
        doc = np.repeat(np.arange(len(per_doc)), per_doc)
        self.start = bounds[doc] + (np.arange(len(doc)) - self.first[doc]) * chunk
        self.end = np.minimum(self.start + chunk, bounds[doc + 1])
        self.closes = self.end == bounds[doc + 1]
        ends, chars = np.zeros(len(doc) + 1, np.int64), np.zeros(len(doc) + 1, np.int64)
        for a in range(0, len(doc), SPAN_CHUNKS):
            b = min(a + SPAN_CHUNKS, len(doc))
            marks, own = self._marks(a, b), self.start[a:b] - self.start[a]
            ends[a + 1 : b + 1] = np.add.reduceat(marks, own, dtype=np.int64)
            chars[a + 1 : b + 1] = np.add.reduceat(self._leads(self.start[a], self.end[b - 1]), own, dtype=np.int64)
        self.ends_before, self.chars_before = np.cumsum(ends), np.cumsum(chars)
        self.tokens = np.diff(self.ends_before[self.first])

    def _marks(self, a: int, b: int) -> np.ndarray:
        """For each byte of the chunks a to b - 1 whether a token ends after it; the byte behind them is looked at too."""
        low, high = int(self.start[a]), int(self.end[b - 1])
        space = SPACE[self.data[low : high + 1]]
        following = space[1:] if len(space) > high - low else np.append(space[1:], True)
        marks = ~space[: high - low] & following
        marks[self.end[a:b][self.closes[a:b]] - 1 - low] = True
        return marks

    def _leads(self, low: int, high: int) -> np.ndarray:
        """Whether each byte is the first of a code point."""
        return (self.data[low:high] & 0xC0) != 0x80

    def place(self, doc: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the first `rank` tokens of each text end: the byte within all data, and the code points up to there."""
        byte, chars = self.bounds[doc].copy(), np.zeros(len(doc), np.int64)
        asked = np.flatnonzero(rank > 0)
        wanted = self.ends_before[self.first[doc[asked]]] + rank[asked]
        owner = np.searchsorted(self.ends_before, wanted) - 1
        for k, chunk, end in zip(asked.tolist(), owner.tolist(), wanted.tolist(), strict=True):
            low = int(self.start[chunk])
            at = low + int(np.flatnonzero(self._marks(chunk, chunk + 1))[end - self.ends_before[chunk] - 1]) + 1
            byte[k] = at
            chars[k] = self.chars_before[chunk] - self.chars_before[self.first[doc[k]]] + np.count_nonzero(self._leads(low, at))
        return byte, chars


def _transform(texts: pa.Array, digests: list[str], percent: int, percent_spm: int) -> pa.RecordBatch:
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None else np.zeros(0, np.uint8)
    bounds = offsets - offsets[0]
    chunks = Chunks(data, bounds)
    n = chunks.tokens
    seeds = np.array([[int(d[k : k + 8], 16) for k in (0, 8, 16, 24)] for d in digests], np.int64).reshape(-1, 4)
    marked = pc.match_substring_regex(texts, MARKER).to_numpy(zero_copy_only=False).astype(bool)
    cut = np.flatnonzero((np.diff(bounds) > 0) & ~marked & (seeds[:, 2] % 100 < percent))
    spm = seeds[:, 3] % 100 < percent_spm
    ranks = np.sort(seeds[cut, :2] % (n[cut] + 1)[:, None], axis=1)
    (a, a_chars), (b, b_chars) = chunks.place(cut, ranks[:, 0]), chunks.place(cut, ranks[:, 1])
    raw = memoryview(data)
    out: list[bytes] = [raw[x:y].tobytes() for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    form, prefix_chars, middle_chars = ["plain"] * len(out), [None] * len(out), [None] * len(out)
    for k, x, y, p, m in zip(cut.tolist(), (a - bounds[cut]).tolist(), (b - bounds[cut]).tolist(), a_chars.tolist(), (b_chars - a_chars).tolist(), strict=True):
        prefix, middle, suffix = out[k][:x], out[k][x:y], out[k][y:]
        parts = (SUFFIX, suffix, PREFIX, prefix) if spm[k] else (PREFIX, prefix, SUFFIX, suffix)
        out[k] = b"".join(v.encode() if isinstance(v, str) else v for v in (*parts, MIDDLE, middle))
        form[k], prefix_chars[k], middle_chars[k] = "spm" if spm[k] else "psm", p, m
    columns = [pa.array(n, pa.int64()), pa.array(form), pa.array(prefix_chars, pa.int64()), pa.array(middle_chars, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())]
    return pa.record_batch(columns, names=["n", "form", "prefix_chars", "middle_chars", "output"])


def fill_in_middle(docs: DataFrame, *, percent: int = 50, percent_spm: int = 80, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n (tokens), form (plain, psm or spm), prefix_chars, middle_chars (code points, null if plain) and the output text.

    `percent` of the texts are transformed, `percent_spm` of those with the suffix first; all choices come from the
    SHA-256 of seed and id. Nothing is shuffled.
    """
    if not 0 <= percent <= 100 or not 0 <= percent_spm <= 100:
        raise ValueError("percent and percent_spm must be from 0 to 100")
    rows = clipped(docs, id_col, text_col).toDF("id", "text")
    rows = rows.withColumn("digest", F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null"))), 256))

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            found = _transform(batch.column(1), batch.column(2).to_pylist(), percent, percent_spm)
            yield pa.record_batch([batch.column(0), *found.columns], names=["id", *found.schema.names])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(transform, f"id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. A text with a marker stays plain, so the three markers found are ours."""
    parts = F.split(output, MARKER, -1)
    prefix, suffix = (F.when(form == "psm", parts[a]).otherwise(parts[b]) for a, b in ((1, 2), (2, 1)))
    return F.when(form == "plain", output).otherwise(F.concat(prefix, parts[3], suffix))


def op13(docs: DataFrame) -> DataFrame:
    found = fill_in_middle(docs)
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return found.select(F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", *digests)


OP13_SQL = r"""
WITH t AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS h,
           regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tokens
    FROM documents),
s AS (
    SELECT doc_id, text, tokens, len(tokens) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
           ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
    FROM t),
c AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
           CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
    FROM s),
p AS (
    SELECT doc_id, text, n, form, array_to_string(tokens[:a], '') AS prefix, array_to_string(tokens[a + 1:b], '') AS middle,
           array_to_string(tokens[b + 1:], '') AS suffix
    FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p"""
