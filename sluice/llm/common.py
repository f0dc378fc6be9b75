"""What the operators share: the shared folder, written tables, Arrow text batches, byte-level hashing."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of an Arrow batch on its way to Python, unless the session sets its own figure.
BATCH_BYTES = 16 << 20
#: Bytes of text that the numpy code holds as arrays at once; one longer text makes a slice of its own.
SLICE_BYTES = 1 << 20
#: Bytes that a row counts for in a slice besides its text, so that short rows don't make wide ones.
ROW_BYTES = 256


# --- the shared folder ------------------------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all executors see; where it is unset, a fresh local one if the master is local (tests)."""
    context = spark.sparkContext
    if found := context.getConf().get("spark.checkpoint.dir"):
        return found.rstrip("/")
    known = context._jsc.sc().getCheckpointDir()
    if known.isEmpty():
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="sluice-"))
        known = context._jsc.sc().getCheckpointDir()
    return known.get().rstrip("/")


#: Whether Spark deletes a query's shuffle files when it ends; a written table is read again, never made again.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Written:
    """Tables written in the shared folder by one run of an operator: they cut lineage and survive lost executors.

    ``options``: for the Parquet writer; ``conf``: settings of the session while a table is written, the session's own again after it."""

    def __init__(self, spark: SparkSession, name: str, options: dict[str, str] | None = None, conf: dict[str, str] | None = None):
        self.spark, self.path, self.n = spark, f"{shared_dir(spark)}/sluice-{name}-{uuid.uuid4().hex}", 0
        self.options, self.conf = {"compression": "zstd"} | (options or {}), {CLEANUP: "true"} | (conf or {})

    def __call__(self, df: DataFrame) -> DataFrame:
        path = self._write(df.write)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._written = path
        return out

    def bucketed(self, df: DataFrame, *cols: str) -> DataFrame:
        """The same in one file for each hash of ``cols``, as many as there are shuffle partitions: joins on all of ``cols`` and nothing else leave its rows where they are.

        The session's catalogue holds the table only until it is looked up here."""
        n, name = int(self.spark.conf.get("spark.sql.shuffle.partitions")), f"sluice_{uuid.uuid4().hex}"
        path = self._write(df.repartition(n, *cols).write.bucketBy(n, *cols), name)
        out = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")
        out._written = path
        return out

    def _write(self, writer: DataFrameWriter, name: str | None = None) -> str:
        self.n += 1
        path = f"{self.path}/{self.n}"
        before = {k: self.spark.conf.get(k, None) for k in self.conf}
        try:
            for k, v in self.conf.items():
                self.spark.conf.set(k, v)
            writer = writer.options(**self.options).option("path", path).format("parquet")
            writer.saveAsTable(name) if name else writer.save()
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)
        return path

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing reads any more."""
        self._delete(*(table._written for table in tables))

    def drop_but(self, *tables: DataFrame) -> None:
        """Deletes all tables of this run but these, which the result reads."""
        self._delete(*({f"{self.path}/{i + 1}" for i in range(self.n)} - {table._written for table in tables}))

    def _delete(self, *paths: str) -> None:
        jvm, hadoop = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for path in map(jvm.org.apache.hadoop.fs.Path, paths):
            path.getFileSystem(hadoop).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_BYTES, so that long texts don't pile up in a worker; a figure set by the user stays."""
    key, default = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
    if spark.conf.get(key, default) == default:
        spark.conf.set(key, str(BATCH_BYTES))


# --- Arrow ------------------------------------------------------------------------------


def arrow_schema(fields: dict[str, pa.DataType]) -> pa.Schema:
    return pa.schema(list(fields.items()))


def spark_schema(fields: dict[str, pa.DataType]) -> T.StructType:
    from pyspark.sql.pandas.types import from_arrow_schema

    return from_arrow_schema(arrow_schema(fields))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: T.StructType) -> DataFrame:
    """fn over every Arrow batch; it may return None for no rows."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def annotate(df: DataFrame, text: Column, worker: Callable[[], Callable[[pa.Array], dict[str, list | np.ndarray | pa.Array]]], fields: dict[str, pa.DataType], as_: str) -> DataFrame:
    """df with a struct column ``as_`` of the named fields, which ``worker()`` makes from each batch of texts.

    All columns of df stay, in order; ``as_`` must be new.  ``worker`` is called once per task.
    """
    small_batches(df.sparkSession)
    keep = df.columns
    if as_ in keep:
        raise ValueError(f"column {as_} exists")
    struct = T.StructType([*df.schema.fields, T.StructField(as_, spark_schema(fields))])
    plain = pa.struct(list(fields.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = worker()
        for batch in batches:
            if not batch.num_rows:
                continue
            made = apply(batch.column(len(keep)))
            arrays = [x if isinstance(x := made[k], pa.Array) else pa.array(x, kind) for k, kind in fields.items()]
            whole = pa.StructArray.from_arrays(arrays, fields=list(plain))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), whole], names=[*keep, as_])

    return df.select("*", text.cast("string").alias(free_name(keep, "text"))).mapInArrow(run, struct)


def free_name(taken: list[str], base: str) -> str:
    """base, with underscores before it until it clashes with no column (names don't depend on case in Spark)."""
    low = {x.lower() for x in taken}
    while base.lower() in low:
        base = f"_{base}"
    return base


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the n + 1 bounds between them; null counts as empty."""
    if array.null_count:
        array = array.fill_null("")
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    if not len(array):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, bounds, data = array.buffers()
    at = np.frombuffer(bounds, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.empty(0, np.uint8)
    return raw, at - at[0]


def slices(bounds: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` bytes, of which each row counts ROW_BYTES besides its own, or one longer row."""
    low, n = 0, len(bounds) - 1
    cost = bounds + ROW_BYTES * np.arange(n + 1)
    while low < n:
        high = int(np.searchsorted(cost, cost[low] + most, "right")) - 1
        high = min(n, max(low + 1, high))
        yield low, high
        low = high


# --- words and hashes over bytes --------------------------------------------------------

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: An odd number and its inverse modulo 2**64, for hashes by prefix sums.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up, down = np.full(n, BASE, np.uint64), np.full(n, INVERSE, np.uint64)
        up[0] = down[0] = 1
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << 21
    while size < n:
        size *= 2
    return _powers(size)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums of values[i] * BASE**i, from 0 to n terms, modulo 2**64."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values) + 1)[0][: len(values)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of the sequence behind ``prefix``; equal spans get equal hashes."""
    raw = (prefix[end] - prefix[start]) * powers(len(prefix))[1][start]
    return mix(raw + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_spans(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and n + 1 bounds of each text's words."""
    ink = ~SPACE[raw]
    before = np.zeros(len(raw), bool)
    before[1:] = ink[:-1]
    inner = bounds[1:-1]
    before[inner[inner < len(raw)]] = False
    start = np.flatnonzero(ink & ~before)
    after = np.zeros(len(raw), bool)
    after[:-1] = ink[1:]
    after[inner[(inner > 0)] - 1] = False
    end = np.flatnonzero(ink & ~after) + 1
    return start, end, np.searchsorted(start, bounds)


def hash_spans(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes."""
    return span_hashes(prefix_sums(raw.astype(np.uint64) + np.uint64(1)), start, end)


def group_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values between bounds; empty ranges give 0."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def crc32_of(column: Column) -> Column:
    """crc32 of the value as text; null counts as empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))
