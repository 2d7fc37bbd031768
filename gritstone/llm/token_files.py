"""Token ids as Arrow stream files of fixed-size-list batches.

A shard file is an Arrow IPC stream. Each record batch has ``input_ids`` and ``attention_mask``, fixed-size lists of
``sequence_length`` ids (uint16 or uint32, by vocabulary size) and of bits. All batches but a shard's last have
``BATCH_SEQUENCES`` rows, so row r of a shard is row r % BATCH_SEQUENCES of batch r // BATCH_SEQUENCES, and a memory
map gives any sequence and mask without a copy. A shard's texts follow each other without gaps; only its last sequence
is padded, with mask 0. A task goes on to its next shard after the document with which one reaches SHARD_TOKENS, so shards
are as large at any size of the corpus, and a reader of another store holds one of them at most. Shards follow each other
in ascending order of the document id; a shard's number is its task's times SHARDS_PER_TASK plus its place there. Beside
the shards lies a Parquet index: one row per document with its shard, its position there in tokens, and its number of
tokens.

Cases: a null or empty text is an end id alone; a null id sorts first; repeated ids stay separate rows, ordered by a
hash of their text; an empty table makes an index without rows and no shard; extra columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gritstone.llm.common import clipped, scratch_path, text_slices
from gritstone.llm.tokens import piece_tokenizer

BATCH_SEQUENCES = 256
#: Tokens with which a shard is full (128 MB of 16-bit ids, and a document more), and numbers that a task has for its shards.
SHARD_TOKENS, SHARDS_PER_TASK = 1 << 26, 1 << 24


def shard_name(shard: int) -> str:
    return f"shard-{shard // SHARDS_PER_TASK:06d}-{shard % SHARDS_PER_TASK:06d}"


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def shard_schema(dtype: np.dtype, sequence_length: int) -> pa.Schema:
    ids = pa.uint16() if dtype.itemsize == 2 else pa.uint32()
    return pa.schema([("input_ids", pa.list_(ids, sequence_length)), ("attention_mask", pa.list_(pa.bool_(), sequence_length))])


class ShardWriter:
    """Writes ids as they come; holds at most one batch besides the document at hand."""

    def __init__(self, directory: str, shard: int, attempt: int, dtype: np.dtype, sequence_length: int):
        self.files, root = _file_system(directory)
        self.files.create_dir(root, recursive=True)
        self.path, self.part = f"{root}/{shard_name(shard)}.arrow", f"{root}/_{shard_name(shard)}.{attempt}"
        self.schema, self.dtype, self.length = shard_schema(dtype, sequence_length), dtype, sequence_length
        self.out, self.writer, self.held, self.n = None, None, [], 0
        self.batch = BATCH_SEQUENCES * sequence_length

    def add(self, ids: bytes) -> None:
        self.held.append(ids)
        self.n += len(ids) // self.dtype.itemsize
        if self.n >= self.batch:
            flat = np.frombuffer(b"".join(self.held), self.dtype)
            whole = len(flat) // self.batch * self.batch
            for at in range(0, whole, self.batch):
                self._write(flat[at : at + self.batch], self.batch)
            self.held, self.n = [flat[whole:].tobytes()], len(flat) - whole

    def _write(self, ids: np.ndarray, real: int) -> None:
        if self.writer is None:
            self.out = self.files.open_output_stream(self.part)
            self.writer = pa.ipc.new_stream(self.out, self.schema)
        mask = pa.array(np.arange(len(ids)) < real)
        kinds = self.schema.types
        values = pa.array(ids, type=kinds[0].value_type)
        columns = [pa.FixedSizeListArray.from_arrays(v, self.length) for v in (values, mask)]
        self.writer.write_batch(pa.record_batch([c.cast(k) for c, k in zip(columns, kinds, strict=True)], schema=self.schema))

    def close(self) -> None:
        rest = np.frombuffer(b"".join(self.held), self.dtype)
        if len(rest):
            padded = np.zeros(-(-len(rest) // self.length) * self.length, self.dtype)
            padded[: len(rest)] = rest
            self._write(padded, len(rest))
        if self.writer is not None:
            self.writer.close()
            self.out.close()
            self.files.move(self.part, self.path)  # a repeated task replaces the file by the same bytes


def write_token_files(docs: DataFrame, directory: str, tokenizer: str, *, end_id: int = 2, sequence_length: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts into shard files under `directory`, a folder that driver and executors share.

    Returns the index (id, shard, position, n_tokens), already written. One range shuffle puts the texts in order of
    their ids, by (id, hash of text) so that a repeated id spreads too; each task then writes its shards, each under a
    name of its own until it is whole.
    """

    full = SHARD_TOKENS

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, encoder = TaskContext.get(), piece_tokenizer(tokenizer)
        end = np.array([end_id], encoder.dtype).tobytes()
        number, position, writer = task.partitionId() * SHARDS_PER_TASK, 0, None
        for batch in text_slices(batches, "text"):
            places = []
            for text in batch.column(1).to_pylist():
                if position >= full:
                    writer.close()
                    number, position, writer = number + 1, 0, None
                writer = writer or ShardWriter(f"{directory}/shards", number, task.taskAttemptId(), encoder.dtype, sequence_length)
                ids = encoder.encode(text) + end
                n = len(ids) // encoder.dtype.itemsize
                places.append((number, position, n))
                position += n
                writer.add(ids)
            yield pa.record_batch([batch.column(0), *(pa.array(c, pa.int64()) for c in zip(*places, strict=True))], names=["id", "shard", "position", "n_tokens"])
        if writer is not None:
            writer.close()

    rows = clipped(docs, id_col, text_col).toDF("id", "text")
    kind = rows.schema["id"].dataType.simpleString()
    order = ["id", F.xxhash64("text")]
    index = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(shard, f"id {kind}, shard bigint, position bigint, n_tokens bigint")
    index.write.parquet(f"{directory}/index")
    return read_index(docs.sparkSession, directory)


def read_index(spark: SparkSession, directory: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/index")


class ShardReader:
    """Random access to one shard: memory-mapped where it is a local file."""

    def __init__(self, directory: str, shard: int):
        files, root = _file_system(directory)
        path = f"{root}/shards/{shard_name(shard)}.arrow"
        source = pa.memory_map(path) if files.type_name == "local" else files.open_input_file(path)
        self.batches = list(pa.ipc.open_stream(source))
        kind = self.batches[0].schema.field("input_ids").type
        self.length, self.size = kind.list_size, BATCH_SEQUENCES * kind.list_size

    def sequence(self, row: int) -> tuple[np.ndarray, pa.Array]:
        """Ids (no copy) and mask of one sequence."""
        batch, at = self.batches[row // BATCH_SEQUENCES], row % BATCH_SEQUENCES
        ids = batch.column(0).values.to_numpy(zero_copy_only=True)
        return ids[at * self.length : (at + 1) * self.length], batch.column(1)[at].values

    def tokens(self, position: int, n: int) -> Iterator[np.ndarray]:
        """The ids of a document as views, one for each batch that it touches."""
        while n > 0:
            ids = self.batches[position // self.size].column(0).values.to_numpy(zero_copy_only=True)
            at = position % self.size
            take = min(n, self.size - at)
            yield ids[at : at + take]
            position, n = position + take, n - take


def read_documents(spark: SparkSession, directory: str) -> DataFrame:
    """Every document read back from the shard files: id, shard, position, start, n_tokens, ids_crc32.

    start counts the ids of all documents before it. The window for it runs over one row per shard, not per document.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, reader = None, None
        for batch in batches:
            crcs = []
            for k, position, n in zip(*(batch.column(c).to_pylist() for c in ("shard", "position", "n_tokens")), strict=True):
                if k != shard:
                    shard, reader = k, ShardReader(directory, k)
                crc = 0
                for ids in reader.tokens(position, n):
                    crc = zlib.crc32(ids.astype("<u4"), crc)
                crcs.append(crc)
            yield pa.record_batch([*batch.columns, pa.array(crcs, pa.int64())], names=[*batch.schema.names, "ids_crc32"])

    index = read_index(spark, directory)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = index.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    kind = index.schema["id"].dataType.simpleString()
    found = index.mapInArrow(read, f"id {kind}, shard bigint, position bigint, n_tokens bigint, ids_crc32 bigint")
    return found.join(starts, "shard").select("id", (F.col("first") + F.col("position")).alias("start"), "n_tokens", "ids_crc32", "shard", "position")


def op1(spark: SparkSession, docs: DataFrame, tokenizer: str) -> DataFrame:
    directory = scratch_path(spark, "tokens")
    write_token_files(docs, directory, tokenizer)
    return read_documents(spark, directory).withColumnRenamed("id", "doc_id")
