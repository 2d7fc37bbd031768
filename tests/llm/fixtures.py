"""A small documents table with the cases every operator must handle: nulls, empty and long texts, ties, odd columns."""

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
ODD = [
    (1, None, "en", "a", None),
    (2, "", None, "a", 0),
    (3, " \t\n ", "en", None, 4),
    (4, "one two\x0bthree  four\n\nfive six", "en", "b", 30),
    (5, "one two\x0bthree  four\n\nfive six", "en", "b", 30),
    (6, "Ünïcode \U0001f600 text here, don't stop; <|endoftext|>", "fr", "b", 40),
    (7, "word " * 20000, "en", "c", 100000),
    (8, "x" * 50000, "en", "c", 50000),
    (9, "solo", "en", "c", 4),
]


def odd_documents(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def empty_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df):
    """The same rows with extra columns named like an operator's own."""
    from pyspark.sql import functions as F

    names = ("id", "start", "n", "rank", "length", "shard", "position", "bucket", "block", "key", "kind", "score", "piece", "task", "keep")
    return df.withColumns({c: F.lit(f"extra {c}") for c in names})
