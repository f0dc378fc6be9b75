"""Windows of event time, and what a grouping takes as its time."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = "window"


@dataclass(frozen=True)
class Strategy:
    """How a grouping treats windows. Only the defaults can be run; :meth:`check` says so."""

    size: str | None = None
    every: str | None = None
    gap: str | None = None
    trigger: str = "default"
    lateness_ms: int = 0
    accumulation: str = "discarding"
    closing: str = "fire_if_nonempty"
    on_time: str = "fire_always"
    combiner: str = "end_of_window"

    def check(self) -> None:
        if self.gap:
            raise NotImplementedError("merging windows (sessions) are not supported by a grouping")
        if (self.trigger, self.lateness_ms, self.accumulation, self.closing, self.on_time) != ("default", 0, "discarding", "fire_if_nonempty", "fire_always"):
            raise NotImplementedError("a grouping fires once, at the end of a window; other triggers and panes are not built")


def assign(df: DataFrame, strategy: Strategy, ts_col: str = "ts") -> DataFrame:
    """df with WINDOW, from the event time alone. Without a size: the global window, no column.

    Assign windows last: an element that an earlier assignment put in several windows is several rows by then. :func:`rewindow` takes several strategies.
    """
    base = df.drop(WINDOW)
    if strategy.gap:
        return base.withColumn(WINDOW, F.session_window(ts_col, strategy.gap))
    if not strategy.size:
        return base
    return base.withColumn(WINDOW, F.window(ts_col, strategy.size, strategy.every or strategy.size))


def rewindow(df: DataFrame, strategies: list[Strategy], ts_col: str = "ts") -> DataFrame:
    """One assignment after another: the last replaces the windows of those before, so each element is in the last one's windows once."""
    return assign(df, strategies[-1], ts_col)


def fixed(df: DataFrame, size: str, ts_col: str = "ts") -> DataFrame:
    return assign(df, Strategy(size=size), ts_col)


def sliding(df: DataFrame, size: str, every: str, ts_col: str = "ts") -> DataFrame:
    return assign(df, Strategy(size=size, every=every), ts_col)


def windows_of(ts: str, size_ms: int, every_ms: int, ms: Column) -> Column:
    """The starts, in ms, of all windows that hold an event: an array, so that the element itself stays one row."""
    last = ms - F.pmod(ms, F.lit(every_ms))
    return F.filter(F.transform(F.sequence(F.lit(0), F.lit((size_ms - 1) // every_ms)), lambda i: last - i * every_ms), lambda s: s + size_ms > ms)


def group_time(combiner: str, ts_col: str = "ts") -> Column:
    """The time of a group: earliest, latest, or the last millisecond of its window."""
    if combiner == "earliest":
        return F.min(ts_col)
    if combiner == "latest":
        return F.max(ts_col)
    if combiner == "end_of_window":
        return F.first(f"{WINDOW}.end") - F.expr("INTERVAL '0.001' SECOND")
    raise ValueError(combiner)


# --- windows and slices in plain milliseconds ---------------------------------------------


def slide_to(ms: Column, size: int, step: int) -> tuple[Column, Column]:
    """The range that a window starts with once its clock has slid to ``ms``."""
    start = ms - F.pmod(ms, F.lit(step))
    return start, start + size


def should_slide(clock: Column, start: Column, size: int) -> Column:
    return clock >= start + size


def interval_slice(ms: Column, size: int, step: int, checkpoint: Column | None = None) -> tuple[Column, Column]:
    """The slice of a time: from the last to the next bound of any window of ``size`` each ``step``; cut at ``checkpoint``, in ms, so that no slice
    has it inside. Times aren't negative."""
    offset = size % step
    starts = ms - F.pmod(ms, F.lit(step))
    ends = ms - F.pmod(ms - offset, F.lit(step))
    low = F.greatest(starts, F.when(ends >= size, ends).otherwise(F.lit(0)))
    high = F.least(starts + step, F.greatest(ends + step, F.lit(size)))
    if checkpoint is not None:
        high = F.when((low < checkpoint) & (checkpoint < high) & (ms < checkpoint), checkpoint).otherwise(high)
        low = F.when((low < checkpoint) & (checkpoint <= ms), checkpoint).otherwise(low)
    return low, high
