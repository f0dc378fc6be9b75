"""Unbounded sources."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition


def read_unbounded(spark: SparkSession, path: str, schema: str | T.StructType, fmt: str = "parquet", batch_files: int = 1000, ts_col: str | None = None, delay: str = "0 seconds", **options: str) -> DataFrame:
    """Files that keep coming, at most ``batch_files`` in a micro-batch; with ``ts_col`` as event time, a watermark ``delay`` behind it.

    Times without a zone are taken as session time, for watermarks need a zone.
    """
    df = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", batch_files).options(**options).load(path)
    if ts_col:
        df = df.withColumn(ts_col, F.col(ts_col).cast("timestamp")).withWatermark(ts_col, delay)
    return df


def ticking(spark: SparkSession, per_second: int = 1) -> DataFrame:
    """(value, ts): one string a tick, at the time of the tick, for ever."""
    rate = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    return rate.select(F.concat(F.lit("tick-"), F.col("value").cast("string")).alias("value"), F.col("timestamp").alias("ts"))


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class ReplayableStream(DataSource):
    """A numbered stream that can be read again from any event time: row i has event time ``i * step_ms`` (option), from
    ``start_ms`` on; each micro-batch takes ``batch`` rows at most, up to ``rows``, in ``parallelism`` parts."""

    @classmethod
    def name(cls) -> str:
        return "sluice_replayable"

    def schema(self) -> str:
        return "id long, ts_ms long"

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return _ReplayableReader({k.lower(): v for k, v in self.options.items()})


class _ReplayableReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.step = int(options.get("step_ms", 1000))
        self.rows, self.batch = int(options.get("rows", 100)), int(options.get("batch", 1000))
        self.parts = int(options.get("parallelism", 1))
        self.first = -(-int(options.get("start_ms", 0)) // self.step)
        self.at = self.first

    def initialOffset(self) -> dict:
        return {"at": self.first}

    def latestOffset(self) -> dict:
        self.at = min(self.rows, self.at + self.batch)
        return {"at": self.at}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        low, high = start["at"], end["at"]
        cuts = [low + (high - low) * i // self.parts for i in range(self.parts + 1)]
        return [_Range(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]

    def read(self, partition: _Range) -> Iterator[tuple]:
        for i in range(partition.low, partition.high):
            yield (i, i * self.step)

    def commit(self, end: dict) -> None:
        json.dumps(end)


def register_replayable(spark: SparkSession) -> None:
    spark.dataSource.register(ReplayableStream)
