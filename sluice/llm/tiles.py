"""Pigeonhole search over 64-bit fingerprints: which of them lie within a few bits of another one."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import Written, small_batches, spark_schema

#: A bucket with more fingerprints than this is dealt out as tiles, each of two chunks of this size at most, about.
TILE = 1024
#: The share of fingerprints by which the sizes of buckets are estimated: one of so many.
SHARE = 16


def masks(blocks: int, distance: int) -> list[int]:
    """Of ``blocks`` runs of bits, each choice of ``blocks - distance`` as a mask: ``distance`` changed bits leave one of them whole."""
    width, wide = divmod(64, blocks)
    runs, at = [], 0
    for i in range(blocks):
        n = width + (i < wide)
        runs.append(((1 << n) - 1) << at)
        at += n
    return [sum(x) for x in combinations(runs, blocks - distance)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def dealt(prints: DataFrame, blocks: int, distance: int, written: Written, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, tile, print, *carry): each fingerprint under each of its block keys, in every tile where it may meet a near one.

    ``prints``: a written table with distinct values of ``print`` (with ``carry``: rows of such).  Two fingerprints that differ in
    at most ``distance`` bits share a key, and some tile of that key.  Only keys with over TILE rows, as estimated, have several tiles: with
    C chunks of such a key, a row goes to C of its C (C + 1) / 2 tiles.
    """

    def keyed(*cols: str) -> DataFrame:
        keys = F.array(*(F.xxhash64(F.lit(i), F.col("print").bitwiseAND(F.lit(signed(m)))) for i, m in enumerate(masks(blocks, distance))))
        return prints.select("print", *cols, F.explode(keys).alias("key"))

    # sizes are estimated from every SHARE-th fingerprint, by hash; all rows are dealt out whatever the estimate says
    some = keyed().where(F.pmod(F.xxhash64("print", F.lit(11)), F.lit(SHARE)) == 0)
    size = F.col("n") * SHARE
    hot = written(some.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(size > TILE).select("key", F.ceil(size / TILE).cast("int").alias("chunks")))
    rows = keyed(*carry)
    if hot.isEmpty():
        return rows.withColumn("tile", F.lit(0))
    rows = rows.join(hot, "key", "left")
    own: Column = F.pmod(F.xxhash64(F.col("print"), F.lit(7)), F.col("chunks")).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.least(c, own) * F.col("chunks") + F.greatest(c, own))
    return rows.select("key", "print", *carry, F.explode(F.coalesce(tiles, F.array(F.lit(0)))).alias("tile"))


def grouped(batches: Iterator[pa.RecordBatch], keys: int = 2) -> Iterator[pa.RecordBatch]:
    """Batches again, of whole groups: rows with equal first ``keys`` columns stand together and in one batch."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cut = batch.num_rows
        new = np.ones(batch.num_rows, bool)
        same = np.ones(batch.num_rows - 1, bool)
        for i in range(keys):
            x = batch.column(i).to_numpy(zero_copy_only=False)
            same &= x[1:] == x[:-1]
            if rest and x[0] != rest[-1].column(i)[-1].as_py():
                yield _whole(rest)
                rest = []
        new[1:] = ~same
        cut = int(np.flatnonzero(new)[-1])
        if cut:
            yield _whole([*rest, batch.slice(0, cut)])
            rest = []
        rest.append(batch.slice(cut))
    if rest:
        yield _whole(rest)


def _whole(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def groups_of(batch: pa.RecordBatch) -> np.ndarray:
    """Bounds of the groups of equal first two columns."""
    a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
    return np.concatenate(([0], np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1, [len(a)]))


def walk(prints: np.ndarray, distance: int, linked: Callable[[int, np.ndarray], np.ndarray] | None = None) -> Iterator[np.ndarray]:
    """The connected groups (of two and more) of the fingerprints of one tile, as lists of positions.

    A breadth-first walk: each position is compared with those that no group has yet; ``linked(i, others)`` may turn down links.
    """
    left = np.arange(len(prints))
    while len(left) > 1:
        group, left = [left[:1]], left[1:]
        queue = list(group[0])
        while queue and len(left):
            i = queue.pop()
            near = np.bitwise_count(prints[left] ^ prints[i]) <= distance
            if linked is not None and near.any():
                at = np.flatnonzero(near)
                near[at] = linked(i, left[at])
            if near.any():
                group.append(left[near])
                queue.extend(left[near])
                left = left[~near]
        if len(group) > 1:
            yield np.concatenate(group)


def paths(prints: DataFrame, written: Written, blocks: int = 6, distance: int = 4) -> DataFrame:
    """Edges (a, b) between fingerprints whose closure is that of all links at ``distance`` bits or fewer; each group of a tile gives one
    path, so nobody has many edges. ``prints``: a written table of distinct longs ``print``; null and an empty table give no edges."""
    rows = dealt(prints.where("print is not null"), blocks, distance, written).select("key", "tile", "print")
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in grouped(batches):
            bounds = groups_of(batch)
            x = batch.column(2).to_numpy(zero_copy_only=False)
            sizes = np.diff(bounds)
            pair = bounds[:-1][sizes == 2]
            pair = pair[np.bitwise_count(x[pair].view(np.uint64) ^ x[pair + 1].view(np.uint64)) <= distance]
            a, b = [x[pair]], [x[pair + 1]]
            for k in np.flatnonzero(sizes > 2):
                own = x[bounds[k] : bounds[k + 1]]
                for group in walk(own.view(np.uint64), distance):
                    a.append(own[group[:-1]])
                    b.append(own[group[1:]])
            if sum(map(len, a)):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    out = rows.repartition("key", "tile").sortWithinPartitions("key", "tile").mapInArrow(run, spark_schema({"a": pa.int64(), "b": pa.int64()}))
    return out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
