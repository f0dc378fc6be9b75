"""Keyed state that built-in streaming aggregates don't express."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sluice.model import millis

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STORE = "spark.sql.streaming.stateStore.providerClass"
#: The column of event times in ms, as timers count them (a name with an underscore first would be lost on the way to Python).
MS = "event_ms"


def use_rocksdb(spark: SparkSession) -> None:
    """State outside the heap, with changes logged per micro-batch; transformWithState needs it."""
    spark.conf.set(STORE, ROCKSDB)


class _Fold(StatefulProcessor):
    """Keeps one long per key: the sum of a column, or the number of rows."""

    def __init__(self, key: str, value: str | None):
        self.key, self.value = key, value

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("total", "total long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        total = self.state.get()[0] if self.state.exists() else 0
        for part in rows:
            total += len(part) if self.value is None else int(part[self.value].sum())
        self.state.update((total,))
        yield pd.DataFrame({self.key: [key[0]], "total": [total]})

    def close(self) -> None:
        pass


def _fold(df: DataFrame, key: str, value: str | None) -> DataFrame:
    kind = df.schema[key].dataType.simpleString()
    return df.groupBy(key).transformWithStateInPandas(_Fold(key, value), outputStructType=f"{key} {kind}, total long", outputMode="Update", timeMode="None")


def counting(df: DataFrame, key: str) -> DataFrame:
    """(key, total) after each micro-batch that has the key: rows so far. State is checkpointed with the offsets, so each row counts once."""
    return _fold(df, key, None)


def running_sum(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, total) after each micro-batch that has the key: the sum of a whole-number column so far."""
    return _fold(df, key, value)


class _Flush(StatefulProcessor):
    """Keeps a sum per key and period of event time until a timer at the period's end goes off."""

    def __init__(self, key: str, value: str, period_ms: int):
        self.key, self.value, self.period = key, value, period_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getMapState("sums", "end_ms long", "total long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        for part in rows:
            ends = part[MS] // self.period * self.period + self.period
            for end, total in part[self.value].groupby(ends).sum().items():
                known = self.sums.containsKey((int(end),))
                before = self.sums.getValue((int(end),))[0] if known else 0
                self.sums.updateValue((int(end),), (before + int(total),))
                if not known:
                    self.handle.registerTimer(int(end))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end = expiredTimerInfo.getExpiryTimeInMs()
        total = self.sums.getValue((end,))[0]
        self.sums.removeKey((end,))
        yield pd.DataFrame({self.key: [key[0]], "end_ms": [end], "total": [total]})

    def close(self) -> None:
        pass


def flush_by_timer(df: DataFrame, key: str, value: str, period_ms: int, ts_col: str = "ts") -> DataFrame:
    """(key, end_ms, total): the sum of a whole-number column per period, given out once, when the watermark on ``ts_col`` has passed the period's end.

    One timer per key and period that has rows; rows behind the watermark are dropped; sums of periods that are not over stay in the state.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = df.withColumn(MS, millis(ts_col))
    return rows.groupBy(key).transformWithStateInPandas(_Flush(key, value, period_ms), outputStructType=f"{key} {kind}, end_ms long, total long", outputMode="Append", timeMode="EventTime")
