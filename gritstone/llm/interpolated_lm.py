"""Bigram language model with deleted interpolation, trained and applied on the whole table.

p(w | h) = a2 c(h, w) / c(h) + a1 c(w) / N + a0 / (V + 1): maximum-likelihood estimates of order two and one and a uniform
one, mixed by weights that depend on the context's frequency, one set for each power of two of c(h). The weights
are learned by expectation-maximisation on held-out counts: one fold of the training texts is deleted from the
counts, and the mixture is fitted to that fold. The final counts are those of all training texts.

Texts are held in blocks of about BLOCK_BYTES, coded by the block's own vocabulary. A block asks for the counts of its
distinct words and bigrams: each goes to the bucket of its hash, packed into binary columns, once per block however
often the block has it, so a frequent word costs a bucket one entry per block. Buckets add up what all blocks sent and
answer in the order of the questions. Counts are exact and grow with the corpus; words are told apart by 64-bit hashes, of
which a request holds what the bucket's number leaves open.

What the driver holds: the totals, and for EM the held-out tokens counted by (context bucket, both estimates in
steps of a quarter power of two), at most some 300,000 rows whatever the input.

Cases: a null or empty text is the end token alone; repeated rows count as often as they occur; a null id counts as
training; without training texts every probability is 1 / (V + 1) = 1; an empty table gives no rows; extra columns are
left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gritstone.llm.common import clipped, free_name, key_width, packed_keys, text_slices, unpacked_keys, written
from gritstone.llm.words import GRAM_CODE, U, mix, words_of

BLOCK_BYTES, BUCKET_KEYS = 8 << 20, 1_000_000
REST, FOLD, HELD_OUT = 0, 1, 2
END = 0x5851F42D4C957F2D
STEPS = 4  # of a power of two
CONTEXTS = 48


def _pack(x: np.ndarray, kind: str) -> bytes:
    return x.astype(kind).tobytes()


def packed_counts(x: np.ndarray) -> bytes:
    """Counts in four bytes each, or in eight where one needs them."""
    return _pack(x, "<u4" if x.max(initial=0) < 1 << 32 else "<u8")


def unpacked_counts(packed: bytes, n: int) -> np.ndarray:
    return np.frombuffer(packed, "<u4" if len(packed) == 4 * n else "<u8").astype(np.int64)


def _blocks(docs: DataFrame, kind: Column, id_col: str, text_col: str) -> DataFrame:
    """One row per block of texts of one kind: block, kind, ids, lengths, vocabulary, and its index of each token.

    lengths count tokens, each text's end included; the vocabulary is in order of frequency, its indices are split
    into a low and a high half, which compress well.
    """

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {k: [] for k in (REST, FOLD, HELD_OUT)}
        size, made, task = dict.fromkeys(held, 0), 0, TaskContext.get().partitionId()

        def block(k: int) -> pa.RecordBatch:
            nonlocal made
            ids = pa.chunked_array([x[0] for x in held[k]]).combine_chunks()
            lengths, tokens = (np.concatenate([x[j] for x in held[k]]) for j in (1, 2))
            held[k], size[k], made = [], 0, made + 1
            vocabulary, index, count = np.unique(tokens, return_inverse=True, return_counts=True)
            order = np.argsort(-count, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            index = place[index]
            row = ((task << 32) + made, k, ids, _pack(lengths, "<u4"), _pack(vocabulary[order], "<u8"), _pack(index & 0xFFFF, "<u2"), _pack(index >> 16, "<u2"))
            one = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            return pa.record_batch([pa.array([row[0]], pa.int64()), pa.array([k], pa.int32()), one, *(pa.array([x], pa.binary()) for x in row[3:])], names=["block", "kind", "ids", "lengths", "vocabulary", "low", "high"])

        for batch in text_slices(batches, "text"):
            words = words_of(batch.column(1))
            hashes, lengths = words.hashes(), words.per_doc + 1
            tokens = np.full(len(hashes) + len(lengths), END, U)
            tokens[np.arange(len(hashes)) + words.doc] = hashes
            kinds = np.array(batch.column(2).to_pylist())
            doc = np.repeat(np.arange(len(lengths)), lengths)
            for k in np.unique(kinds):
                own = kinds == k
                mine = tokens[own[doc]]
                held[k].append((batch.column(0).filter(pa.array(own)), lengths[own], mine))
                size[k] += len(mine)
                if size[k] * 6 >= BLOCK_BYTES:
                    yield block(k)
        for k in held:
            if held[k]:
                yield block(k)

    name = free_name(docs, "kind")
    rows = clipped(docs.withColumn(name, kind), id_col, text_col, name).toDF("id", "text", "kind")
    id_kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(code, f"block bigint, kind int, ids array<{id_kind}>, lengths binary, vocabulary binary, low binary, high binary")


class _Block:
    """The keys of a block in the order in which it asks: per bucket, its words, then its bigrams."""

    def __init__(self, row: dict, buckets: int):
        self.lengths = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
        vocabulary = np.frombuffer(row["vocabulary"], U)
        self.index = np.frombuffer(row["low"], "<u2").astype(np.int64) | (np.frombuffer(row["high"], "<u2").astype(np.int64) << 16)
        self.ends = np.cumsum(self.lengths)
        self.end = int(self.index[self.ends[0] - 1])
        before = np.empty_like(self.index)  # the end token stands for the start of a text
        before[1:] = self.index[:-1]
        before[0] = self.end
        self.before = before
        n = len(vocabulary)
        pairs = before * n + self.index
        order = np.argsort(pairs)
        ordered = pairs[order]
        first = np.ones(len(pairs), bool)
        first[1:] = ordered[1:] != ordered[:-1]
        number = np.cumsum(first) - 1
        self.pair = np.empty(len(pairs), np.int64)
        self.pair[order] = number
        pairs = ordered[first]
        hashes = np.concatenate([vocabulary, mix(vocabulary[pairs // n] * GRAM_CODE[0] + vocabulary[pairs % n] * GRAM_CODE[1])])
        self.counts = np.concatenate([np.bincount(self.index, minlength=n), np.bincount(number)])
        self.bucket = (hashes % U(buckets)).astype(np.int64)
        self.keys = hashes // U(buckets)
        self.n = n
        self.order = np.argsort(self.bucket, kind="stable")
        ordered = self.bucket[self.order]
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        #: bucket -> the part of `order` that it is asked for; only buckets that the block needs
        self.parts = dict(zip(ordered[first].tolist(), zip(first.tolist(), np.append(first[1:], len(ordered)).tolist(), strict=True), strict=True))

    def totals(self, answers: list[dict], name: str) -> tuple[np.ndarray, np.ndarray]:
        """Counts of each token and of each token's bigram, from the buckets' answers."""
        found = np.zeros(len(self.keys), np.int64)
        for x in answers:
            first, last = self.parts[x["bucket"]]
            found[self.order[first:last]] = unpacked_counts(x[name], last - first)
        return found[: self.n], found[self.n :]


def _requests(blocks: DataFrame, buckets: int) -> DataFrame:
    width = key_width(buckets)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own, out = _Block(row, buckets), []
                for b, (first, last) in own.parts.items():
                    at = own.order[first:last]
                    out.append((b, row["block"], row["kind"], int((at < own.n).sum()), packed_keys(own.keys[at], width), _pack(own.counts[at], "<u4")))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 2), strict=True)], names=["bucket", "block", "kind", "words", "keys", "counts"])

    return blocks.select("block", "kind", "lengths", "vocabulary", "low", "high").mapInArrow(ask, "bucket int, block bigint, kind int, words int, keys binary, counts binary")


def _answers(requests: DataFrame, buckets: int) -> DataFrame:
    """Per bucket and block the counts in training (and in the fold, for its blocks); one row per bucket has totals."""
    width = key_width(buckets)

    def answer(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        sizes = [len(x["keys"]) // width for x in rows]
        keys = np.concatenate([unpacked_keys(x["keys"], width) for x in rows])
        counts = np.frombuffer(b"".join(x["counts"] for x in rows), "<u4").astype(np.int64)
        kind = np.repeat([x["kind"] for x in rows], sizes)
        starts = np.cumsum([0, *sizes])
        word = np.zeros(len(keys), bool)
        for x, at in zip(rows, starts, strict=False):
            word[at : at + x["words"]] = True
        order = np.concatenate([at[np.argsort(keys[at])] for at in (np.flatnonzero(~word), np.flatnonzero(word))])
        ordered, words_last = keys[order], word[order]
        new = np.ones(len(keys), bool)
        new[1:] = (ordered[1:] != ordered[:-1]) | (words_last[1:] != words_last[:-1])
        first, number = np.flatnonzero(new), np.empty(len(keys), np.int64)
        number[order] = np.cumsum(new) - 1
        fold = np.add.reduceat(np.where(kind == FOLD, counts, 0)[order], first)
        training = np.add.reduceat(np.where(kind != HELD_OUT, counts, 0)[order], first)
        is_word = word[order][first]
        totals = {"n": int(training[is_word].sum()), "n_fold": int(fold[is_word].sum()), "v": int((training[is_word] > 0).sum())}
        training, fold = training[number], fold[number]
        out = [{"block": -1, "kind": -1, "bucket": rows[0]["bucket"], **totals}]
        for x, a, b in zip(rows, starts, starts[1:], strict=False):
            out.append({"block": x["block"], "kind": x["kind"], "bucket": x["bucket"], "training": packed_counts(training[a:b]), "fold": packed_counts(fold[a:b]) if x["kind"] == FOLD else None})
        return pa.Table.from_pylist(out, schema=pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("training", pa.binary()), ("fold", pa.binary()), ("n", pa.int64()), ("n_fold", pa.int64()), ("v", pa.int64())]))

    return requests.groupBy("bucket").applyInArrow(answer, "block bigint, kind int, bucket int, training binary, fold binary, n bigint, n_fold bigint, v bigint")


def _context(c: np.ndarray) -> np.ndarray:
    """The frequency bucket of a context: 0 if it was not seen, else one more than floor(log2(c))."""
    return np.minimum(np.frexp(c.astype(float))[1], CONTEXTS - 1)


def _level(p: np.ndarray) -> np.ndarray:
    """-log2(p) in STEPS, and -1 for 0."""
    return np.where(p > 0, np.rint(-np.log2(np.where(p > 0, p, 1)) * STEPS), -1).astype(np.int64)


def learn_weights(context: np.ndarray, level2: np.ndarray, level1: np.ndarray, count: np.ndarray, uniform: float, rounds: int = 60) -> np.ndarray:
    """Weights (contexts x orders 2, 1, 0) by EM; rows without held-out tokens take those of the nearest that has some."""
    p2, p1 = (np.where(x < 0, 0.0, 2.0 ** (-x / STEPS)) for x in (level2, level1))
    p = np.stack([p2, p1, np.full(len(p1), uniform)], 1)
    weights = np.full((CONTEXTS, 3), 1 / 3)
    weights[0] = 0, 0.5, 0.5
    seen = np.bincount(context, count, CONTEXTS)
    for _ in range(rounds):
        part = weights[context] * p
        part *= (count / np.maximum(part.sum(1), 1e-300))[:, None]
        for k in range(3):
            weights[:, k] = np.where(seen > 0, np.bincount(context, part[:, k], CONTEXTS) / np.maximum(seen, 1e-300), weights[:, k])
    weights = np.maximum(weights, [0, 0, 1e-6])
    weights[1:] = np.maximum(weights[1:], 1e-6)
    weights /= weights.sum(1, keepdims=True)
    known = np.flatnonzero(seen[1:] > 0) + 1
    if len(known):
        for c in range(1, CONTEXTS):
            weights[c] = weights[known[np.argmin(abs(known - c))]]
    return weights


def score_texts(docs: DataFrame, held_out: Column, fold: Column, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score of every text.

    held_out: which texts the counts leave out; fold: which training texts the mixture weights are learned on.
    """
    spark = docs.sparkSession
    kind = F.when(held_out, HELD_OUT).when(fold, FOLD).otherwise(REST)
    blocks, _ = written(_blocks(docs, kind, id_col, text_col), "blocks")
    keys = blocks.agg(F.sum(F.octet_length("low") / 2 + F.octet_length("vocabulary") / 8)).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(-(-keys // BUCKET_KEYS)))
    answers, _ = written(_answers(_requests(blocks, buckets).repartition(buckets, "bucket"), buckets), "answers")
    total = answers.where("block = -1").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "n_fold", "v"))).first()
    n, n_fold, v = total["n"], total["n_fold"], total["v"]
    uniform = 1 / (v + 1)

    def met(which: Column) -> DataFrame:
        replies = answers.where((F.col("block") >= 0) & which).groupBy("block").agg(F.collect_list(F.struct("bucket", "training", "fold")).alias("answers"))
        return blocks.where(which).join(replies, "block")

    def held_out_levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = _Block(row, buckets)
                (c1, c2), (f1, f2) = own.totals(row["answers"], "training"), own.totals(row["answers"], "fold")
                c1, c2 = c1 - f1, c2 - f2
                h = c1[own.before]
                levels = [_context(h), _level(c2[own.pair] / np.maximum(h, 1)), _level(c1[own.index] / max(1, n - n_fold))]
                code = (levels[0] * 1024 + levels[1] + 1) * 1024 + levels[2] + 1
                code, count = np.unique(code, return_counts=True)
                yield pa.record_batch([pa.array(code >> 20), pa.array((code >> 10) % 1024 - 1), pa.array(code % 1024 - 1), pa.array(count)], names=["context", "level2", "level1", "n"])

    levels = met(F.col("kind") == FOLD).mapInArrow(held_out_levels, "context bigint, level2 bigint, level1 bigint, n bigint")
    found = levels.groupBy("context", "level2", "level1").agg(F.sum("n").alias("n")).toPandas()
    weights = learn_weights(*(found[c].to_numpy(np.int64) for c in ("context", "level2", "level1", "n")), uniform)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, row in enumerate(batch.drop_columns(["ids"]).to_pylist()):
                own = _Block(row, buckets)
                c1, c2 = own.totals(row["answers"], "training")
                c, h = c1[own.index], c1[own.before]
                a = weights[_context(h)]
                p = a[:, 0] * c2[own.pair] / np.maximum(h, 1) + a[:, 1] * c / max(n, 1) + a[:, 2] * uniform
                first = own.ends - own.lengths
                add = lambda x, at=first: np.add.reduceat(x, at)
                ids = batch.column("ids")[k].values
                yield pa.record_batch(
                    [ids, pa.array(np.full(len(first), row["kind"] == HELD_OUT)), pa.array(own.lengths), pa.array(add((c > 0).astype(np.int64))), pa.array(np.full(len(first), n)), pa.array(add(np.log10((c + 1) / (n + v + 1)))), pa.array(add(np.log10(p)))],
                    names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    id_kind = docs.schema[id_col].dataType.simpleString()
    return met(F.lit(True)).mapInArrow(score, f"id {id_kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def remainder(id_col: str, n: int) -> Column:
    """crc32 of the id's text modulo n."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def op6(spark: SparkSession, docs: DataFrame) -> DataFrame:
    rest = remainder("doc_id", 7)
    return score_texts(docs, rest == 2, rest == 3).withColumnRenamed("id", "doc_id")
