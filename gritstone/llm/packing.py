"""Packing of token pieces into sequences of bounded length: exact-complement hashing, then best fit.

All that decides a packing is how many pieces there are of each length, at most `capacity` numbers however many
documents there are. The plan is made from these counts: which combinations of lengths fill a sequence, and how often
each is used. A piece (largest first) takes every combination of one, two or three lengths that exactly fills its gap, the
fewest and most balanced first, as often as the counts of all its members allow; what stays open takes the largest lengths
that fit. Exact triples use up short pieces, which can leave worse fits for the rest where there are few pieces, so the
plan is also made with exact pairs and with exact singles only, and the one with the fewest sequences is kept. Documents then meet the plan by the rank of a piece among those of its length, which needs no sort: a rank is
what the task has seen, plus what earlier tasks of the same write have counted. Only lengths and ranks are shuffled,
never texts or ids.

Cases: a null or empty text is one piece with the end id alone; repeated rows and repeated ids are packed as separate
pieces; an empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gritstone.llm.common import clipped, text_slices, written
from gritstone.llm.tokens import piece_tokenizer


def cut_lengths(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: only longer documents are cut, the first piece is the short one."""
    first = (n - 1) % capacity + 1
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """id, piece, start, length, ids (little-endian 32-bit), task, rank (among the task's pieces of that length)."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen, task = piece_tokenizer(tokenizer), defaultdict(int), TaskContext.get().partitionId()
        end = np.array([end_id], encoder.dtype).tobytes()
        for batch in text_slices(batches, "text"):
            row, piece, start, length, ids, rank = [], [], [], [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                held = np.frombuffer(encoder.encode(text) + end, encoder.dtype).astype("<u4")
                for p, (at, n) in enumerate(cut_lengths(len(held), capacity)):
                    row.append(k)
                    piece.append(p)
                    start.append(at)
                    length.append(n)
                    ids.append(held[at : at + n].tobytes())
                    rank.append(seen[n])
                    seen[n] += 1
            yield pa.record_batch(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()), pa.array([task] * len(row), pa.int32()), pa.array(rank, pa.int64())],
                names=["id", "piece", "start", "length", "ids", "task", "rank"],
            )

    rows = clipped(docs, id_col, text_col).toDF("id", "text")
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(pieces, f"id {kind}, piece int, start bigint, length bigint, ids binary, task int, rank bigint")


def fillings(present: np.ndarray, gap: int, largest: int, size: int) -> np.ndarray:
    """All rows of `size` present lengths that add up to the gap, ascending, none above the largest; the most balanced first."""
    lengths = np.flatnonzero(present)
    low, heads = lengths[lengths * 2 <= gap], np.zeros((1, 0), np.int64)
    if size == 2:
        heads = low[:, None]
    if size == 3:
        least = lengths[lengths * 3 <= gap][:, None]
        i, j = np.nonzero((least <= low) & (least + 2 * low <= gap))
        heads = np.column_stack([least[i, 0], low[j]])
    last = gap - heads.sum(axis=1)
    rows = np.column_stack([heads, last])[(last <= largest) & present[last]]
    return rows[np.argsort(rows[:, -1] - rows[:, 0], kind="stable")]


def tightest_plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """The plan with the fewest sequences of those with exact fillings of up to three, two or one length."""
    return min((plan_sequences(counts, capacity, most) for most in (3, 2, 1)), key=lambda plan: sum(times for _, times in plan))


def plan_sequences(counts: dict[int, int], capacity: int, most: int = 3) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of one sequence, how many such sequences), covering the counts exactly; gaps are filled by up to `most` lengths.

    Once all combinations of a length are tried, no more of them can open up, as counts only fall. So the combinations
    of up to most + 1 lengths that fill a sequence are each met at their largest length, and none is left out.
    """
    left, plan = np.zeros(capacity + 1, np.int64), []
    for x, n in counts.items():
        left[x] = n

    def use(parts: tuple[int, ...]) -> bool:
        times = min(int(left[x]) // parts.count(x) for x in set(parts))
        if times:
            plan.append((parts, times))
            for x in parts:
                left[x] -= times
        return times > 0

    use((capacity,))
    for length in sorted((k for k in counts if k < capacity), reverse=True):
        for size in range(1, most + 1):
            if not left[length]:
                break
            rows = fillings(left > 0, capacity - length, length, size)
            rows = np.column_stack([rows, np.full(len(rows), length)])
            # how many of a length a row needs, up to each of its places
            need = np.ones_like(rows)
            for k in range(1, size + 1):
                need[:, k] += need[:, k - 1] * (rows[:, k] == rows[:, k - 1])
            while (open_rows := (left[rows] >= need).all(axis=1)).any():
                rows, need = rows[open_rows], need[open_rows]
                use(tuple(map(int, rows[0, ::-1])))
    lengths = sorted((k for k in counts if left[k]), reverse=True)
    while lengths := [k for k in lengths if left[k]]:
        parts, room = [lengths[0]], capacity - lengths[0]
        while room and (fits := [k for k in lengths if k <= room and left[k] > parts.count(k)]):
            parts.append(fits[0])
            room -= fits[0]
        use(tuple(parts))
    return plan


def plan_slots(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """length -> (first rank, first sequence, offset) of the runs of ranks that the plan's places take, in order."""
    found, used, sequence = defaultdict(list), defaultdict(int), 0
    for parts, times in plan:
        offset = 0
        for x in parts:
            found[x].append((used[x], sequence, offset))
            used[x] += times
            offset += x
        sequence += times
    return {x: tuple(np.array(v, np.int64) for v in zip(*runs, strict=True)) for x, runs in found.items()}


def pack_documents(docs: DataFrame, tokenizer: str, *, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", payload: dict[str, Column] | None = None) -> DataFrame:
    """Every piece of every document with its place: id, piece, start, length, the payload, sequence_id, offset.

    payload: columns made from ``ids`` (little-endian 32-bit) where the pieces are read; the ids themselves by default.
    The pieces are written once to the shared folder. The driver holds one count per length, the
    plan, which has at most a few combinations per length, and one length's combinations (under capacity ** 2 / 12); all are
    bounded by `capacity`, not by the number of documents.
    """
    spark = docs.sparkSession
    pieces, _ = written(token_pieces(docs, tokenizer, capacity, end_id, id_col, text_col), "pieces")
    by_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = spark.sparkContext.broadcast(plan_slots(tightest_plan(counts, capacity)))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    firsts = by_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        lengths, ranks = lengths.to_numpy(), ranks.to_numpy()
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for x in np.unique(lengths):
            at = np.flatnonzero(lengths == x)
            first_rank, first_sequence, place_offset = slots.value[int(x)]
            run = np.searchsorted(first_rank, ranks[at], "right") - 1
            sequence[at] = first_sequence[run] + ranks[at] - first_rank[run]
            offset[at] = place_offset[run]
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    payload = {"ids": F.col("ids")} if payload is None else payload
    kept = pieces.select("id", "piece", "start", "length", "task", "rank", *(c.alias(k) for k, c in payload.items()))
    placed = kept.join(firsts, ["length", "task"]).withColumn("place", place("length", F.col("rank") + F.col("first")))
    return placed.select("id", "piece", "start", "length", *payload, "place.sequence_id", "place.offset")


def op4(spark: SparkSession, docs: DataFrame, tokenizer: str) -> DataFrame:
    return pack_documents(docs, tokenizer, payload={"ids_crc32": F.crc32("ids")}).withColumnRenamed("id", "doc_id")
