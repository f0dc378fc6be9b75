"""Per-record transforms, tagged outputs, filters, unions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions import letters
from sluice.model import LifeTime, millis

#: The column that multiplexes several outputs on one edge.
TAG = "tag"


def par_do(df: DataFrame, **columns: Column) -> DataFrame:
    """One row out for each row in: the named expressions."""
    return df.select(*(c.alias(name) for name, c in columns.items()))


def par_do_many(df: DataFrame, many: Column, name: str, **columns: Column) -> DataFrame:
    """As many rows out as the array ``many`` has entries."""
    return df.select(*(c.alias(n) for n, c in columns.items()), F.explode(many).alias(name))


def par_do_bundle(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]], schema: str | T.StructType) -> DataFrame:
    """For what expressions can't say: ``make()`` sets up once per bundle (a partition), the function it returns
    gets each Arrow batch; an attribute ``finish`` of it, if any, is called at the bundle's end and may give more batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        process = make()
        for batch in batches:
            yield from process(batch)
        if finish := getattr(process, "finish", None):
            yield from finish()

    return df.mapInArrow(run, schema)


def par_do_tagged(df: DataFrame, outputs: Mapping[str, Column]) -> DataFrame:
    """df with a column TAG: a row once for each output whose condition holds; rows without one are dropped."""
    tags = F.array(*(F.when(when, F.lit(tag)) for tag, when in outputs.items()))
    return df.withColumn(TAG, F.explode(F.filter(tags, lambda t: t.isNotNull())))


def select_tag(df: DataFrame, tag: str) -> DataFrame:
    """The rows of one output; an unknown tag has none."""
    return df.where(F.col(TAG) == tag).drop(TAG)


def no_side_inputs(side_inputs: object) -> None:
    if side_inputs:
        raise NotImplementedError("side inputs are not supported; join the inputs instead")


def lifetime_filter(df: DataFrame, life: LifeTime, ts_col: str = "ts") -> DataFrame:
    """Messages within the life of an edge; equal to a range filter, so it reaches the scan."""
    return df.where(life.contains(millis(ts_col)))


def time_filter(df: DataFrame, start: Column, ts_col: str = "ts") -> DataFrame:
    """Without obsolete messages."""
    return df.where(F.col(ts_col) >= start)


def drop_unrouted(df: DataFrame, partition: Column) -> DataFrame:
    """Without messages whose partitioner says -1."""
    return df.where(partition != -1)


def route(df: DataFrame, index: Column, n: int) -> list[DataFrame]:
    """One DataFrame for each of n downstream processors, by index."""
    marked = df.withColumn("_route", index)
    return [marked.where(F.col("_route") == i).drop("_route") for i in range(n)]


def upper(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.upper(column))


def extract_words(df: DataFrame, column: str) -> DataFrame:
    """(word, n): a one for each word."""
    return df.select(F.explode(letters(F.col(column))).alias("word"), F.lit(1).cast("long").alias("n"))


def format_pair(key: Column, value: Column) -> Column:
    return F.concat(key.cast("string"), F.lit("="), value.cast("string"))


def append_name(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.withColumn(column, F.array_append(column, F.lit(name)))


def pass_through(df: DataFrame, name: str = "forwarded") -> DataFrame:
    """The same rows; their count is observed on the way, at no extra pass."""
    return df.observe(name, F.count(F.lit(1)).alias("messages"))


def flatten(parts: list[DataFrame], schema: str | T.StructType | None = None, spark=None) -> DataFrame:
    """All rows of all parts, duplicates kept; of one part itself; of none an empty table of ``schema``."""
    if not parts:
        return spark.createDataFrame([], schema)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
