"""Bounded sources."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions import words
from sluice.model import EPOCH


def create_values(spark: SparkSession, values: Sequence[Any], element: str = "string", parallelism: int = 1) -> DataFrame:
    """(idx, value, stripe): the elements in order; task ``stripe`` of ``parallelism`` emits every parallelism-th."""
    schema = T.StructType([T.StructField("idx", T.LongType()), T.StructField("value", T._parse_datatype_string(element))])
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], schema)
    return rows.withColumn("stripe", (F.col("idx") % parallelism).cast("int"))


def create_timestamped(spark: SparkSession, rows: Sequence[tuple[Any, ...]], schema: str, ms_col: str = "ts_ms") -> DataFrame:
    """Rows that state their event time in ms; ``ts`` is added."""
    df = spark.createDataFrame(list(rows), schema)
    return df.withColumn("ts", F.expr(f"timestampadd(MILLISECOND, {ms_col}, {EPOCH})"))


def impulse(spark: SparkSession) -> DataFrame:
    """One element of no bytes."""
    return spark.range(1).select(F.lit(b"").alias("value"))


def empty(spark: SparkSession, schema: str | T.StructType) -> DataFrame:
    """No rows; as bounded input it is complete at once."""
    return spark.createDataFrame([], schema)


def read_bounded(spark: SparkSession, path: str, columns: Sequence[str] | None = None, fmt: str = "parquet", **options: str) -> DataFrame:
    """A file source; splits are Spark's (``spark.sql.files.maxPartitionBytes``), and only ``columns`` are read."""
    df = spark.read.format(fmt).options(**options).load(path)
    return df.select(*columns) if columns else df


def replay_from(df: DataFrame, start: Column, ts_col: str = "ts") -> DataFrame:
    """Messages from ``start`` on: what a source that can replay by time gives after a restart, obsolete messages dropped."""
    return df.where(F.col(ts_col) >= start)


def sentence_words(spark: SparkSession, text: str, rounds: int = 1, single_spaces: bool = False) -> DataFrame:
    """The words of a fixed text, over and over; by runs of white space, or by single spaces."""
    parts = F.split(F.lit(text), " ") if single_spaces else words(F.lit(text))
    return spark.range(rounds).select(F.explode(parts).alias("word"))


def digit_strings(spark: SparkSession, rows: int, size: int = 100, choices: int = 100, seed: int = 0) -> DataFrame:
    """A load: each row is one of ``choices`` fixed texts of ``size`` digits 0 to 8."""
    pick = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(choices))
    digit = lambda i: F.pmod(F.xxhash64("pick", i, F.lit(seed)), F.lit(9)).cast("string")
    return spark.range(rows).select("id", pick.alias("pick")).select("id", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(size)), digit), "").alias("value"))


def vector_source(spark: SparkSession, name: str, rows: int = 1) -> DataFrame:
    """Vectors that hold their source's name."""
    return spark.range(rows).select(F.array(F.lit(name)).alias("list"))
