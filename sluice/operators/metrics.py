"""Queries over metrics history.

A table of points: time_ms, kind, name (``app<a>.processor<p>.task<t>:<metric>``), and the fields of the kinds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions import glob_regex

NAME = r"^app(\d+)\.processor(\d+)\.task(\d+):(.+)$"
#: Kinds that history keeps.
KINDS = ("histogram", "meter", "counter", "gauge")
#: (bucket in ms, buckets kept) of the two retentions.
RECENT, HISTORY = (15_000, 20), (3_600_000, 72)
#: The most rows of a task filter.
TASK_LIMIT = 1000


def stored(metrics: DataFrame) -> DataFrame:
    return metrics.where(F.col("kind").isin(*KINDS))


def by_path(metrics: DataFrame, path: str) -> DataFrame:
    """Points whose name starts with what the glob matches."""
    return metrics.where(F.col("name").rlike(glob_regex(path)))


def read_latest(metrics: DataFrame, order: list[str]) -> DataFrame:
    """The last point of each name."""
    return _rank(metrics, ["name"], [F.desc(c) for c in order], 1)


def read_retained(metrics: DataFrame, retention: tuple[int, int], order: list[str]) -> DataFrame:
    """Of each name the first point of each bucket, the newest buckets only."""
    size, kept = retention
    bucketed = metrics.withColumn("bucket", F.expr(f"time_ms div {size}"))
    firsts = _rank(bucketed, ["name", "bucket"], [F.col(c) for c in order], 1)
    return _rank(firsts, ["name"], [F.desc("bucket")], kept)


def _rank(df: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= most).drop("_rank")


def parsed(metrics: DataFrame) -> DataFrame:
    """With app, processor, task, metric; rows with malformed names are left out."""
    part = lambda i: F.regexp_extract("name", NAME, i)
    named = metrics.where(F.col("name").rlike(NAME))
    return named.withColumns({"app": part(1).cast("int"), "processor": part(2).cast("int"), "task": part(3).cast("int"), "metric": part(4)})


def _slots(metrics: DataFrame, slot_ms: int | None) -> DataFrame:
    rows = parsed(metrics)
    slot = F.expr(f"time_ms div {slot_ms}") if slot_ms else F.lit(0).cast("long")
    own = F.concat(F.lit("app"), F.col("app"), F.lit(".processor"), F.col("processor"), F.lit(":"), F.col("metric"))
    return rows.withColumn("slot", slot).withColumn("own", own)


def processor_meters(metrics: DataFrame, slot_ms: int | None, fields: tuple[str, ...] = ("count", "mean_rate", "m1")) -> DataFrame:
    """(slot, name, time_ms, fields): meters of a processor's tasks added up per slot (None: one slot); the time is the earliest."""
    rows = _slots(metrics.where("kind = 'meter'"), slot_ms)
    return rows.groupBy("slot", "own").agg(F.min("time_ms").alias("time_ms"), *(F.sum(f).alias(f) for f in fields)).withColumnRenamed("own", "name")


def processor_histograms(metrics: DataFrame, slot_ms: int | None, fields: tuple[str, ...] = ("mean", "stddev", "median", "p95", "p99", "p999")) -> DataFrame:
    """(slot, name, time_ms, fields): each field's plain mean over a processor's tasks per slot; the time is the earliest."""
    rows = _slots(metrics.where("kind = 'histogram'"), slot_ms)
    return rows.groupBy("slot", "own").agg(F.min("time_ms").alias("time_ms"), *(F.avg(f).alias(f) for f in fields)).withColumnRenamed("own", "name")


def in_range(metrics: DataFrame, now_ms: int, retention: tuple[int, int]) -> DataFrame:
    """Points of the slots that a read option covers: whole slots before the one of ``now_ms``."""
    size, kept = retention
    end = now_ms // size * size
    return metrics.where((F.col("time_ms") >= end - size * kept) & (F.col("time_ms") < end))


def task_filter(latest: DataFrame, processors: tuple[int, int], tasks: tuple[int, int], order: list[str], limit: int = TASK_LIMIT) -> DataFrame:
    """Points of half-open ranges of processors and tasks; the first ``limit`` in ``order``, last first."""
    rows = parsed(latest).where(F.col("processor").between(processors[0], processors[1] - 1) & F.col("task").between(tasks[0], tasks[1] - 1))
    return rows.orderBy(*order).limit(min(limit, TASK_LIMIT)).orderBy(*(F.desc(c) for c in order))


AGGREGATORS: dict[str, Callable[[DataFrame], DataFrame]] = {"identity": lambda m: m, "processor_meters": lambda m: processor_meters(m, None), "processor_histograms": lambda m: processor_histograms(m, None)}


def aggregated(metrics: DataFrame, name: str | None) -> DataFrame:
    """By a named aggregator: none leaves points as they are, an unknown one gives no rows."""
    if not name:
        return metrics
    return AGGREGATORS[name](metrics) if name in AGGREGATORS else metrics.limit(0)


def _recorded(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """df with _r (number of the update among its key's), _n (how many there are), from 1."""
    w = Window.partitionBy(*keys)
    return df.withColumn("_r", F.row_number().over(w.orderBy(*order))).withColumn("_n", F.count(F.lit(1)).over(w))


def sampled_counter(df: DataFrame, keys: list[str], order: list[str], value: Column, every: int) -> DataFrame:
    """(keys, n, counter): what a counter that records at every ``every``-th update, with all that came since the last, shows at the end."""
    rows = _recorded(df.withColumn("_v", value), keys, order)
    full = F.col("_r") <= F.col("_n") - F.col("_n") % every
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(full, F.col("_v")).otherwise(0)).alias("counter"))


def sampled_meter(df: DataFrame, keys: list[str], order: list[str], value: Column, every: int) -> DataFrame:
    """(keys, mark, amount): the marks of a meter that records at every ``every``-th update all that came since the last; the rest is never marked."""
    rows = _recorded(df.withColumn("_v", value), keys, order).where(F.col("_r") <= F.col("_n") - F.col("_n") % every)
    mark = F.floor((F.col("_r") - 1) / every).cast("long").alias("mark")
    return rows.groupBy(*keys, mark).agg(F.sum("_v").alias("amount"))


def sampled_histogram(df: DataFrame, keys: list[str], order: list[str], value: Column, every: int) -> DataFrame:
    """(keys, n, low, high, mean): of the values that a histogram keeps that records every ``every``-th update and drops those between."""
    rows = _recorded(df.withColumn("_v", value), keys, order).where(F.col("_r") % every == 0)
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"), F.avg("_v").alias("mean"))


def series(metrics: DataFrame, bucket_ms: int, sums: tuple[str, ...] = (), means: tuple[str, ...] = ()) -> DataFrame:
    """(bucket_ms, fields): one line of a chart per field, sorted by time."""
    bucket = (F.col("time_ms") - F.pmod("time_ms", F.lit(bucket_ms))).alias("bucket_ms")
    return metrics.groupBy(bucket).agg(*(F.sum(f).alias(f"sum_{f}") for f in sums), *(F.avg(f).alias(f"mean_{f}") for f in means)).orderBy("bucket_ms")


def task_counts(metrics: DataFrame) -> DataFrame:
    """(processor, tasks): how many tasks of each processor have points."""
    return parsed(metrics).groupBy("processor").agg(F.count_distinct("task").alias("tasks"))
