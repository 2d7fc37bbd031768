"""Reading, previewing, sampling and profiling tables; writing them."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: How files of other kinds begin.
SIGNATURES = {b"PAR1": "Parquet", b"PK\x03\x04": "zip or Excel", b"\xd0\xcf\x11\xe0": "old Excel", b"\x1f\x8b": "gzip"}


def first_bytes(spark: SparkSession, path: str, n: int = 64) -> bytes:
    """The first bytes of a file, or of the first data file of a folder, by the file system of its path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getFileStatus(where).isDirectory():
        held = sorted((s.getPath() for s in fs.listStatus(where) if s.isFile() and not s.getPath().getName().startswith(("_", "."))), key=lambda p: p.getName())
        if not held:
            return b""
        where = held[0]
    stream = fs.open(where)
    try:
        return bytes(stream.readNBytes(n))
    finally:
        stream.close()


def content_kind(spark: SparkSession, path: str) -> str:
    """What a file's first bytes say: a known kind, `binary` for other bytes that are no text, or `text`."""
    head = first_bytes(spark, path)
    known = next((kind for mark, kind in SIGNATURES.items() if head.startswith(mark)), None)
    return known or ("binary" if b"\x00" in head else "text")


def load_table(source: SparkSession | DataFrame, path: str | None = None) -> DataFrame:
    """A table as it is, or a CSV (header, inferred types) or Parquet table by its suffix, from any path Spark can read.

    Other content under a CSV name, a table without columns and a table without rows are errors.
    """
    if isinstance(source, DataFrame):
        table, path = source, "the table"
    elif path.rstrip("/").lower().endswith((".csv", ".csv.gz", ".txt")):
        kind = content_kind(source, path)
        if kind not in ("text", "gzip"):
            raise ValueError(f"{path} holds {kind} content, not CSV")
        table = source.read.csv(path, header=True, inferSchema=True)
    else:
        table = source.read.parquet(path)
    if not table.columns or table.isEmpty():
        raise ValueError(f"{path} has no {'rows' if table.columns else 'columns'}")
    return table


def table_facts(table: DataFrame) -> DataFrame:
    """position, column, type and the table's rows; counting rows reads no column (of Parquet, footers only)."""
    n = table.count()
    return table.sparkSession.createDataFrame([(k, f.name, f.dataType.simpleString(), n) for k, f in enumerate(table.schema.fields, 1)], "position int, column string, type string, rows bigint")


def projected(table: DataFrame, columns: list[str], path: str, compression: str = "zstd") -> DataFrame:
    """The needed columns written as Parquet and read again; missing ones are an error that names them."""
    if missing := [c for c in columns if c not in table.columns]:
        raise ValueError(f"the table lacks {missing}")
    table.select(*columns).write.mode("overwrite").option("compression", compression).parquet(path)
    return table.sparkSession.read.parquet(path)


def preview(table: DataFrame, rows: int, columns: list[str] | None = None) -> DataFrame:
    return (table.select(*columns) if columns else table).limit(rows)


def hash_sample(table: DataFrame, key: str, rows: int, multiplier: int = 7919, modulus: int = 1_000_003) -> DataFrame:
    """A fixed number of rows in a pseudo-random but reproducible order of a unique integer key (a top-k, no full sort)."""
    return table.orderBy(F.pmod(F.col(key) * multiplier, F.lit(modulus)), F.col(key)).limit(rows)


def profile(table: DataFrame, columns: list[str]) -> DataFrame:
    """column, rows, nulls, distinct and five quantiles of numeric columns over the whole table; quantiles by ranges of the values."""
    from gritstone.operators.quantiles import quantiles_of

    points = (0.01, 0.25, 0.5, 0.75, 0.99)
    held = table.agg(F.count("*").alias("rows"), *(e for c in columns for e in (F.sum(F.col(c).isNull().cast("long")).alias(f"{c}__nulls"), F.count_distinct(c).alias(f"{c}__distinct"))))
    found = quantiles_of(table, {c: F.col(c) for c in columns}, {c: list(points) for c in columns})
    each = (F.struct(F.lit(c).alias("column"), F.col("rows"), F.col(f"{c}__nulls").alias("nulls"), F.col(f"{c}__distinct").alias("distinct"), *(F.lit(q).cast("double").alias(f"p{int(100 * p):02d}") for p, q in zip(points, found[c], strict=True))) for c in columns)
    return held.select(F.explode(F.array(*each)).alias("x")).select("x.*")


def csv_to_parquet(spark: SparkSession, source: str, target: str, compression: str = "zstd") -> DataFrame:
    load_table(spark, source).write.mode("overwrite").option("compression", compression).parquet(target)
    return spark.read.parquet(target)


def export(table: DataFrame, path: str, kind: str = "parquet", partition_by: tuple[str, ...] = ()) -> None:
    """Write as Parquet or CSV; nested columns become JSON text in CSV."""
    if kind == "csv":
        nested = {c: F.to_json(c) for c, t in table.dtypes if t.startswith(("array", "map", "struct"))}
        table = table.withColumns(nested) if nested else table
    table.write.mode("overwrite").partitionBy(*partition_by).option("header", True).format(kind).save(path)


def fingerprint(table: DataFrame) -> DataFrame:
    """rows and an order-insensitive checksum of all columns."""
    return table.agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*table.columns).cast("decimal(38,0)")).alias("checksum"))


def schema_hash(table: DataFrame) -> str:
    """SHA-256 of the columns' names and types, in their order."""
    return hashlib.sha256(",".join(f"{c}:{t}" for c, t in table.dtypes).encode()).hexdigest()


def portable_fingerprint(table: DataFrame, columns: list[str]) -> DataFrame:
    """rows, and the sum over the rows of a number from the SHA-256 of the columns as text (nulls as the word null): the same
    in any engine, whatever the order of rows. Whole numbers, text and booleans only."""
    text = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns))
    part = F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("decimal(38,0)")
    return table.agg(F.count("*").alias("rows"), F.coalesce(F.sum(part), F.lit(0)).cast("string").alias("checksum"))
