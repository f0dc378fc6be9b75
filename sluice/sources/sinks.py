"""Sinks: where flows end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def write_text(df: DataFrame, path: str, column: str = "value") -> DataFrame:
    """Appends one line per row below ``path``, and passes the rows on."""
    df.select(F.col(column).cast("string").alias("value")).write.mode("append").text(path)
    return df


def capture_first(df: DataFrame, name: str, column: str = "list") -> DataFrame:
    """The sink's name and the first vector that came, at most one row."""
    return df.limit(1).select(F.lit(name).alias("sink"), F.col(column))


def foreach_batch(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """A sink called with each micro-batch and its number; exactly once if it is idempotent for a number."""
    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def foreach_row(df: DataFrame, sink: object, checkpoint: str) -> DataStreamWriter:
    """A sink object with open(partition, epoch), process(row) and close(error)."""
    return df.writeStream.foreach(sink).option("checkpointLocation", checkpoint)


def memory(df: DataFrame, name: str, mode: str = "append") -> DataStreamWriter:
    """A table on the driver, for tests."""
    return df.writeStream.format("memory").queryName(name).outputMode(mode)


def file_stream(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet") -> DataStreamWriter:
    return df.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint)
