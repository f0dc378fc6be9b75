"""SimHash fingerprints of 256 bits, and which of them share a block of bits and are near each other."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import Written, mix, small_batches, spark_schema
from sluice.llm.tiles import grouped

#: Numbers of 64 bits in a fingerprint, and the columns that hold them.
WORDS = 4
COLUMNS = tuple(f"p{i}" for i in range(WORDS))
#: Features whose bits are counted at once, and the most that a counter of 8 bits takes.
AT_ONCE, COUNTER = 1 << 15, 255
#: Entries (a fingerprint under one of its keys) that a task sorts at once, about.
ENTRIES = 1 << 20
#: A key with more entries than this is dealt out as tiles, each of two chunks of this size at most, about.
TILE = 2048
#: The share of fingerprints by which the sizes of keys are estimated: one of so many.
SHARE = 16
#: Up to so many entries of a key are compared by shifting all keys' entries at once.
SHIFTED = 48
#: Different odd numbers, one for each 64 bits.
SEEDS = mix(np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


#: The lowest bit of each of eight bytes.
LANES = np.uint64(0x0101010101010101)


def majority(h: np.ndarray, bounds: np.ndarray, words: int = WORDS) -> np.ndarray:
    """For each range of feature hashes a row of ``words`` * 64 bits: those set in over half of the features' mixed hashes; none for an empty range.

    Counters of 8 bits are added up eight at a time, over at most COUNTER features, and these sums as whole numbers.
    """
    n = len(bounds) - 1
    out = np.zeros((n, words), np.uint64)
    sizes = np.diff(bounds)
    some = np.flatnonzero(sizes)
    low = 0
    while low < len(some):
        high = max(low + 1, int(np.searchsorted(bounds[some + 1], bounds[some[low]] + AT_ONCE, "right")))
        own = some[low:high]
        low = high
        base, size = bounds[own[0]], sizes[own]
        first = bounds[own] - base
        pieces = -(-size // COUNTER)
        top = np.cumsum(pieces) - pieces
        step = np.arange(int(pieces.sum())) - np.repeat(top, pieces)
        start = np.repeat(first, pieces) + step * COUNTER
        part = h[base : base + int(size.sum())]
        for k in range(words):
            own_h = mix(part ^ SEEDS[k])
            ones = np.empty((len(own), 8, 8), np.int64)
            for b in range(8):
                sums = np.add.reduceat((own_h >> np.uint64(b)) & LANES, start).view(np.uint8).reshape(-1, 8)
                ones[:, :, b] = sums if len(start) == len(own) else np.add.reduceat(sums, top, axis=0, dtype=np.int64)
            bits = 2 * ones.reshape(len(own), 64) > size[:, None]
            out[own, k] = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
    return out


@functools.lru_cache(maxsize=4)
def weights(width: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    """A matrix that makes all block keys of a row of bits, and for each key the word by which its entries are compared first.

    Each of ``tables`` orders of the bits is cut into blocks of ``width``; fewer differing bits than an order has blocks leave one of them whole.
    """
    each = WORDS * 64 // width
    out = np.zeros((WORDS * 64, tables * each), np.float32)
    check = np.zeros(tables * each, np.int64)
    for t in range(tables):
        order = np.arange(WORDS * 64) if t == 0 else np.argsort(mix(np.arange(WORDS * 64, dtype=np.uint64) + np.uint64(t << 20)))
        for j in range(each):
            bits = order[j * width : (j + 1) * width]
            out[bits, t * each + j] = 2.0 ** np.arange(width)
            held = np.bincount(bits // 64, minlength=WORDS)
            check[t * each + j] = int(np.argmin(held))
    return out, check


def block_keys(prints: np.ndarray, width: int, tables: int) -> np.ndarray:
    """The keys of each fingerprint: the number of the block, and its bits."""
    by, _ = weights(width, tables)
    out = np.empty((len(prints), by.shape[1]), np.uint32)
    for at in range(0, len(prints), 4096):
        bits = np.unpackbits(np.ascontiguousarray(prints[at : at + 4096]).view(np.uint8), axis=1, bitorder="little")
        out[at : at + 4096] = bits.astype(np.float32) @ by
    return out + (np.arange(by.shape[1], dtype=np.uint32) << np.uint32(width))


def prints_in(batch: pa.RecordBatch, at: int) -> np.ndarray:
    return np.stack([batch.column(at + i).to_numpy().view(np.uint64) for i in range(WORDS)], axis=1)


def near_in_tile(key: np.ndarray, check: np.ndarray, most: int) -> np.ndarray:
    """Whether each entry has another one of its key whose ``check`` differs in at most ``most`` bits; entries are in the order of keys."""
    hit = np.zeros(len(key), bool)
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(first, len(key)))
    left = np.repeat(size, size) - (np.arange(len(key)) - np.repeat(first, size))  # entries of the key from here on
    here = np.flatnonzero((left > 1) & np.repeat(size <= SHIFTED, size))
    d = 1
    while len(here):
        near = here[np.bitwise_count(check[here] ^ check[here + d]) <= most]
        hit[near] = hit[near + d] = True
        d += 1
        here = here[left[here] > d]
    for a, n in zip(first[size > SHIFTED], size[size > SHIFTED], strict=True):
        own, found = check[a : a + n], hit[a : a + n]
        for i in range(0, n, 256):
            close = np.bitwise_count(own[i : i + 256, None] ^ own[None, :]) <= most
            found[i : i + 256] = close.sum(1) > 1  # itself is one
    return hit


def walk(prints: np.ndarray, most: int, linked: Callable[[int, np.ndarray], np.ndarray] | None = None) -> Iterator[np.ndarray]:
    """The connected groups (of two and more) of rows of ``prints`` that differ in at most ``most`` bits as positions; ``linked(i, others)`` may turn down links.

    A breadth-first walk: each position is compared with those that no group has yet.
    """
    left = np.arange(len(prints))
    while len(left) > 1:
        group, left = [left[:1]], left[1:]
        queue = list(group[0])
        while queue and len(left):
            i = queue.pop()
            near = np.bitwise_count(prints[left] ^ prints[i]).sum(1, dtype=np.int64) <= most
            if near.any():
                if linked is not None:
                    at = np.flatnonzero(near)
                    near[at] = linked(i, left[at])
                group.append(left[near])
                queue.extend(left[near])
                left = left[~near]
        group = [x for x in group if len(x)]
        if len(group) > 1:
            yield np.concatenate(group)


def groups(nodes: DataFrame, written: Written, width: int, tables: int, most: int) -> DataFrame:
    """A written table (key, node): under some block key, each node with another one that differs in at most ``most`` of 64 bits, the
    keys of the same such nodes made one.  A group holds two nodes at least and 2 * TILE at most, about.

    ``nodes``: a written table (node, *COLUMNS) of distinct nodes.  Entries go to a task by their keys, packed as arrays, so that rows are few; keys
    with over TILE entries, as estimated from every SHARE-th node, go as tiles: with C chunks of such a key, an entry goes to C of its C (C + 1) / 2
    tiles.  The list of such keys is bounded by the number of keys, blocks * 2**width.
    """
    small_batches(nodes.sparkSession)
    by, check_word = weights(width, tables)
    blocks = by.shape[1]
    n = nodes.count()
    parts = max(1, -(-n * blocks // ENTRIES))

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, count = np.unique(block_keys(prints_in(batch, 0), width, tables), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(count.astype(np.int64))], names=["key", "n"])

    some = nodes.where(F.pmod(F.xxhash64("node"), F.lit(SHARE)) == 0).select(*COLUMNS)
    sizes = some.mapInArrow(sampled, spark_schema({"key": pa.int64(), "n": pa.int64()})).groupBy("key").agg((F.sum("n") * SHARE).alias("n"))
    hot = sizes.where(F.col("n") > TILE).select("key", F.ceil(F.col("n") / TILE).alias("chunks")).toArrow()
    order = np.argsort(hot["key"].to_numpy())
    hot_keys, hot_chunks = hot["key"].to_numpy()[order].astype(np.uint32), hot["chunks"].to_numpy()[order]
    schema = {"part": pa.int64(), "keys": pa.binary(), "nodes": pa.binary(), "checks": pa.binary()}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            node, prints = batch.column(0).to_numpy(), prints_in(batch, 1)
            key = block_keys(prints, width, tables)
            check = prints[:, check_word].ravel()
            node = np.repeat(node, blocks)
            key = key.ravel().astype(np.uint64)  # with the number of the tile above
            if len(hot_keys):
                at = np.minimum(np.searchsorted(hot_keys, key), len(hot_keys) - 1)
                chunks = np.where(hot_keys[at] == key, hot_chunks[at], 1)
                own = (mix(node.astype(np.uint64)) % chunks.astype(np.uint64)).astype(np.int64)
                entry = np.repeat(np.arange(len(key)), chunks)
                other = np.arange(len(entry)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
                tile = np.minimum(other, own[entry]) * chunks[entry] + np.maximum(other, own[entry])
                key, node, check = key[entry] | (tile.astype(np.uint64) << np.uint64(32)), node[entry], check[entry]
            part = (mix(key) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            part, key, node, check = part[order], key[order], node[order], check[order]
            first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            last = np.append(first[1:], len(part))
            packed = [pa.array([x[a:b].tobytes() for a, b in zip(first, last, strict=True)], pa.binary()) for x in (key, node, check)]
            yield pa.RecordBatch.from_arrays([pa.array(part[first]), *packed], names=list(schema))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in grouped(batches, 1):
            part = batch.column(0).to_numpy()
            first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            for a, b in zip(first, np.append(first[1:], len(part)), strict=True):
                key, node, check = (np.frombuffer(b"".join(batch.column(i).slice(a, b - a).to_pylist()), kind) for i, kind in ((1, np.uint64), (2, np.int64), (3, np.uint64)))
                order = np.argsort(key)  # any order within a key
                key = key[order]
                hit = np.flatnonzero(near_in_tile(key, check[order], most))
                if len(hit):
                    key, node = key[hit], node[order[hit]]
                    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
                    group = mix(np.add.reduceat(mix(node.astype(np.uint64) + np.uint64(1)), start))
                    group = np.repeat(group, np.diff(np.append(start, len(key)))).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(node)], names=["key", "node"])

    dealt = nodes.select("node", *COLUMNS).mapInArrow(deal, spark_schema(schema))
    met = dealt.repartition("part").sortWithinPartitions("part").mapInArrow(meet, spark_schema({"key": pa.int64(), "node": pa.int64()}))
    return written(met.distinct())
