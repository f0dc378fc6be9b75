"""The data model: messages are rows with a payload and an event time; clocks are whole milliseconds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of clocks in ms. They don't fit a TIMESTAMP, so clocks stay BIGINT.
MIN_MS = -(1 << 63)
MAX_MS = (1 << 63) - 2
UNREACHABLE_MS = (1 << 63) - 1
#: A source's watermark once all input was seen; and before any.
WATERMARK_MAX = UNREACHABLE_MS
WATERMARK_MIN = MIN_MS

EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def message(df: DataFrame, ts: Column | None = None, ts_col: str = "ts") -> DataFrame:
    """df with an event time: ``ts``, or the epoch where it is missing."""
    at = F.lit(None).cast("timestamp_ntz") if ts is None else ts
    return df.withColumn(ts_col, F.coalesce(at, F.expr(EPOCH)))


def millis(ts_col: str) -> Column:
    """Milliseconds since the epoch of a timestamp column with or without zone (without: as UTC)."""
    return F.expr(f"timestampdiff(MILLISECOND, {EPOCH}, `{ts_col}`)")


@dataclass(frozen=True)
class LifeTime:
    """Half-open interval of event time, in ms, in which a processor or an edge is alive."""

    birth: int = MIN_MS
    death: int = UNREACHABLE_MS

    def contains(self, ms: Column) -> Column:
        return (ms >= self.birth) & (ms < self.death)

    def cross(self, other: LifeTime) -> LifeTime:
        return LifeTime(max(self.birth, other.birth), min(self.death, other.death))


@dataclass(frozen=True)
class TaskId:
    """Processor and index, packed into one long."""

    processor: int
    index: int

    def packed(self) -> int:
        return (self.processor << 32) + self.index

    @staticmethod
    def unpack(x: int) -> TaskId:
        return TaskId(x >> 32, x & 0xFFFFFFFF)


def packed_task(processor: Column, index: Column) -> Column:
    return F.shiftleft(processor.cast("long"), 32) + index.cast("long")
