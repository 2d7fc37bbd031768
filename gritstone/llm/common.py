"""Session, scratch-folder and Arrow helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir, or in local mode one of our own where it is unset."""
    folder = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_KEY} must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="gritstone-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/gritstone-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Cut the lineage by writing a table to the shared folder; returns what reads it and its path."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Remove scratch tables that no result reads any more."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def text_slices(batches: Iterator[pa.RecordBatch], text: str, max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of about max_bytes of text each; a longer text makes a slice of its own. Nulls become ''."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(text)
        column = pc.fill_null(batch.column(at), "").cast(pa.large_string())
        batch = batch.set_column(at, pa.field(text, pa.large_string()), column)
        sizes = pc.binary_length(column).to_pylist()
        first = total = 0
        for row, size in enumerate(sizes):
            if total and total + size > max_bytes:
                yield batch.slice(first, row - first)
                first, total = row, 0
            total += size
        yield batch.slice(first)


def slices_with_texts(batches: Iterator[pa.RecordBatch], text: str, max_bytes: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """As text_slices, but the slices keep the column as it is; the texts come beside them."""
    for batch in batches:
        if not batch.num_rows:
            continue
        first = 0
        at = batch.schema.get_field_index(text)
        for part in text_slices(iter([batch]), text, max_bytes):
            yield batch.slice(first, part.num_rows), part.column(at)
            first += part.num_rows


def free_name(df: DataFrame, name: str) -> str:
    """The name, lengthened until the table has no such column (upper and lower case alike)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def key_width(parts: int) -> int:
    """Bytes that hold a 64-bit hash divided by `parts`."""
    return max(5, -(-((2**64 - 1) // max(parts, 1)).bit_length() // 8))


def packed_keys(keys: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of each key, byte place after byte place."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpacked_keys(packed: bytes, width: int) -> np.ndarray:
    held = np.zeros((len(packed) // width, 8), np.uint8)
    held[:, :width] = np.frombuffer(packed, np.uint8).reshape(width, -1).T
    return held.view("<u8").ravel()


#: A key with more than one in HOT_SHARE of the rows is hot, so fewer than HOT_SHARE keys are; HOT_ROWS narrow rows are no
#: burden to a task however they are shared.
HOT_SHARE, HOT_ROWS = 10_000, 50_000


def join_hot(rows: DataFrame, table: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """rows joined to a table that has one row per key and, in `size`, how many of the `total` rows have that key.

    No task gathers a hot key: keys with more than total / HOT_SHARE rows, of which there are fewer than HOT_SHARE, are
    broadcast, so their rows stay where they are; the others meet by a shuffle. Either way gives the same rows.
    """
    limit = max(HOT_ROWS, total // HOT_SHARE)
    if total <= limit:  # no key can be hot
        return rows.join(table.drop(size), key)
    hot, rest = table.where(F.col(size) > limit).drop(size), table.where(F.col(size) <= limit).drop(size)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key)
    return rows.join(F.broadcast(hot), key).unionByName(cold)


def clipped(df: DataFrame, *columns: str) -> DataFrame:
    """Only the columns an operator works on, so that extra columns can't clash with its own names."""
    return df.select(*(df[c] for c in columns))
