"""Partitioners: where a message would go, as a column; Spark deals rows out itself unless asked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions import bucket_of, numbered

#: Partitioners that need no function of the user's.
BUILT_IN = ("broadcast", "co_location", "hash", "shuffle_grouping", "shuffle")
PARTITION = "partition_id"


def hash_partition(df: DataFrame, n: int, *columns: str) -> DataFrame:
    """By the hash of the whole value: the named columns (all by default) as one text."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (columns or df.columns)]
    return df.withColumn(PARTITION, bucket_of(F.concat_ws("|", *parts), n))


def group_by_partition(df: DataFrame, n: int, group: Column) -> DataFrame:
    """By the hash of a function of the value."""
    return df.withColumn(PARTITION, bucket_of(group.cast("string"), n))


def shuffle_partition(df: DataFrame, n: int, order: list[str], index: Column, seed: int = 1) -> DataFrame:
    """Round robin from ``seed``, in the order given (see :func:`sluice.functions.numbered`)."""
    return numbered(df, order, index, "_row").withColumn(PARTITION, F.pmod(F.col("_row") + seed, F.lit(n))).drop("_row")


def shuffle_grouping_partition(df: DataFrame, n: int, order: list[str], index: Column, seed: int = 1) -> DataFrame:
    """Each n messages in a row hit each of n tasks once, every round in another order."""
    rows = numbered(df, order, index, "_row").withColumn("_round", F.expr(f"_row div {n}"))
    place = F.row_number().over(Window.partitionBy("_round").orderBy(F.xxhash64("_row", F.lit(seed)), "_row")) - 1
    # a last round of fewer messages takes the first places
    return rows.withColumn(PARTITION, place.cast("long")).drop("_row", "_round")


def broadcast_partition(df: DataFrame, n: int) -> DataFrame:
    """A copy for each of n tasks."""
    return df.withColumn(PARTITION, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def multicast_partition(df: DataFrame, targets: Column) -> DataFrame:
    """A copy for each entry of an array of partitions."""
    return df.withColumn(PARTITION, F.explode(targets))


def co_location(df: DataFrame, index: Column) -> DataFrame:
    """The same index downstream: nothing moves."""
    return df.withColumn(PARTITION, index)


def unicast(df: DataFrame, partition: Column) -> DataFrame:
    """By a function of the user's; -1 drops the message."""
    return df.withColumn(PARTITION, partition).where(F.col(PARTITION) != -1)


def deal(df: DataFrame, n: int, *columns: Column | str) -> DataFrame:
    """Actually moves rows: by hash of columns, or evenly."""
    return df.repartition(n, *columns) if columns else df.repartition(n)
