"""Submitting a stream and watching it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery, StreamingQueryListener

PENDING, ACTIVE, SUCCEEDED, FAILED, TERMINATED, NONEXIST = "pending", "active", "succeeded", "failed", "terminated", "nonexist"


@dataclass
class App:
    """A submitted stream and its status."""

    name: str
    query: StreamingQuery | None = None
    killed: bool = False

    def status(self) -> str:
        if self.query is None:
            return PENDING
        if self.query.isActive:
            return ACTIVE
        if self.query.exception():
            return FAILED
        return TERMINATED if self.killed else SUCCEEDED

    def wait(self, seconds: float | None = None) -> str:
        """Until it ends, or for so long; the status."""
        try:
            self.query.awaitTermination(seconds) if seconds is not None else self.query.awaitTermination()
        except StreamingQueryException:
            pass
        return self.status()

    def kill(self) -> None:
        self.killed = self.query.isActive
        self.query.stop()

    def info(self) -> dict:
        progress = self.query.lastProgress
        return {"name": self.name, "id": str(self.query.id), "status": self.status(), "rows": progress["numInputRows"] if progress else None, "error": str(self.query.exception() or "")}


def submit(name: str, writer: DataStreamWriter, once: bool = True, every: str | None = None) -> App:
    """Starts it: with ``once`` over all that is there, then it ends as succeeded; else for ever, at an interval if one is given."""
    writer = writer.queryName(name)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every) if every else writer
    return App(name, writer.start())


def running(spark: SparkSession) -> list[str]:
    return [q.name for q in spark.streams.active]


class Throughput(StreamingQueryListener):
    """Rows and seconds of each micro-batch, by stream name: what a metrics reporter would send on."""

    def __init__(self):
        self.points: list[tuple[str, int, int, float]] = []

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        self.points.append((p.name, p.batchId, p.numInputRows, p.durationMs.get("triggerExecution", 0) / 1000))

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass


def batch_equal(stream: DataFrame, batch: DataFrame) -> bool:
    """Whether two results hold the same rows: for tests of streams against batches."""
    return stream.exceptAll(batch).isEmpty() and batch.exceptAll(stream).isEmpty()
