"""State as aggregates over time: running values, snapshots, checkpoints, window state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.operators.aggregate import Monoid


def snapshot_left_right(df: DataFrame, keys: list[str], value: Column, ms: Column, at_ms: int) -> DataFrame:
    """(keys, left, right, total): sums before and from a checkpoint time on. ``left`` is what a snapshot at that time holds, however far processing went."""
    return df.groupBy(*keys).agg(
        F.sum(F.when(ms < at_ms, value).otherwise(0)).alias("left"),
        F.sum(F.when(ms >= at_ms, value).otherwise(0)).alias("right"),
        F.sum(value).alias("total"),
    )


def running(df: DataFrame, keys: list[str], order: list[str], value: Column, as_: str = "state") -> DataFrame:
    """The state after each message: a running sum per key."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(as_, F.sum(value).over(w))


def window_state(df: DataFrame, keys: list[str], value: Column, size: str, every: str, monoid: Monoid, ts_col: str = "ts") -> DataFrame:
    """(keys, window, state): the aggregate of all messages in each window, late ones too."""
    return df.groupBy(*keys, F.window(ts_col, size, every).alias("window")).agg(monoid.of(value).alias("state"))


def first_checkpoint(ms: Column, interval: int) -> Column:
    """The checkpoint time for a first message."""
    return (F.expr("1L") + (ms - F.pmod(ms, F.lit(interval))) / interval).cast("long") * interval


def next_checkpoint(done: Column, newest: Column, interval: int) -> Column:
    """The next time after a checkpoint at ``done``, if there are newer messages; else null."""
    ahead = newest - done
    steps = ((ahead - F.pmod(ahead, F.lit(interval))) / interval).cast("long")
    return F.when(newest > done, done + (1 + steps) * interval)


def store_name(app: int, processor: int, index: int) -> str:
    """The name of a task's checkpoint store."""
    return f"app{app}-task{processor}_{index}"


def global_checkpoint(reports: DataFrame, tasks: int, task: str = "task", at: str = "t_ms") -> DataFrame:
    """One row: the largest time that each of ``tasks`` tasks reported; null if none."""
    everywhere = reports.groupBy(at).agg(F.count_distinct(task).alias("n")).where(F.col("n") == tasks)
    return everywhere.agg(F.max(at).alias("checkpoint_ms"))
