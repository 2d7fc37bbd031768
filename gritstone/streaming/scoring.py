"""The same fitted expressions over a stream, and windowed counts of late-arriving events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scored_stream(stream: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """A row-wise projection, so it needs no state."""
    return stream.withColumns(columns)


def windowed(stream: DataFrame, time: str, key: str, value: str, length: str = "1 day", late: str = "2 hours") -> DataFrame:
    """key, window start, n and mean; a stream drops what comes later than `late`. Times without a zone are taken in the session's."""
    kind = dict(stream.dtypes)[time]
    held = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if stream.isStreaming else stream
    counted = held.groupBy(F.window(time, length).alias("w"), key).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return counted.select(F.col("w.start").cast(kind).alias("start"), key, "n", "mean")
