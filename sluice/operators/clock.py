"""Clocks: how far each processor, and the whole flow, has come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def processor_clocks(tasks: DataFrame) -> DataFrame:
    """(processor, clock_ms): the least of the tasks' clocks. ``tasks``: processor, task, clock_ms."""
    return tasks.groupBy("processor").agg(F.min("clock_ms").alias("clock_ms"))


def min_clock(tasks: DataFrame) -> DataFrame:
    """One row, ``clock_ms``: the least of the processors' clocks."""
    return processor_clocks(tasks).agg(F.min("clock_ms").alias("clock_ms"))


def stalling_tasks(tasks: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """(processor, task, clock_ms): of the first processor (in topological ``order``: processor, idx; else by number) at the least clock, the tasks at it.

    Only asked for once the clock hasn't moved for long.
    """
    clocks = processor_clocks(tasks)
    ranked = clocks.join(order, "processor") if order is not None else clocks.withColumn("idx", F.col("processor"))
    # min over structs: least clock, then first in order; one row
    first = ranked.agg(F.min(F.struct("clock_ms", "idx", "processor")).alias("m")).select("m.clock_ms", "m.processor")
    return tasks.join(F.broadcast(first), ["processor", "clock_ms"]).select("processor", "task", "clock_ms")


def task_watermark(birth: int, upstream: int, processing: int, acked: list[int] | None, unreachable: int) -> int:
    """A task's watermark: the least of what came, what it did and what was acknowledged, at least its birth; without subscriptions nothing waits for acknowledgement."""
    return max(birth, min(upstream, processing, min(acked) if acked else unreachable))


def start_clock(checkpoints: list[int], clock: int) -> int:
    """Where a restart begins: the least checkpoint, if any, else the least clock."""
    return min(checkpoints) if checkpoints else clock
