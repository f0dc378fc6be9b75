"""Operator 10: SimHash near-duplicates of documents, found by pigeonhole blocks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm import wide
from sluice.llm.common import Written, annotate, free_name, hash_spans, prefix_sums, slices, small_batches, span_hashes, spark_schema, text_bytes, word_spans
from sluice.llm.components import components
from sluice.llm.tiles import grouped, paths

#: Shingles whose bits are counted at once.
BLOCK = 1 << 15


def fingerprint(text: bytes, words: int = 4, seed: int = 42) -> int:
    """The 64-bit SimHash of a text: bit i is set if it is in over half the XXH64 of its shingles of ``words`` words.

    A-Z count as a-z; words are ``[^\\x20\\x09-\\x0D]+``; fewer words than a shingle's make one shingle; no word: 0.
    """
    parts = text.lower().split()  # of bytes: exactly these letters and these separators
    if not parts:
        return 0
    line = b" ".join(parts)
    length = np.fromiter(map(len, parts), np.int64, len(parts))
    end = np.cumsum(length + 1) - 1
    start = end - length
    k = min(words, len(parts))
    start, end = start[: len(start) - k + 1], end[k - 1 :]
    ones, n = np.zeros(64, np.int64), len(start)
    for at in range(0, n, BLOCK):
        a, b = start[at : at + BLOCK].tolist(), end[at : at + BLOCK].tolist()
        h = np.fromiter(map(xxhash.xxh64_intdigest, map(line.__getitem__, map(slice, a, b)), repeat(seed)), np.uint64, len(a))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text", words: int = 4, as_: str = "simhash") -> DataFrame:
    """docs with a struct column ``as_`` of one field: ``print`` long, the bits of :func:`fingerprint`.  Null text counts as empty."""

    def worker():
        def apply(texts: pa.Array) -> dict:
            raw, bounds = text_bytes(texts)
            out = np.zeros(len(texts), np.uint64)
            for low, high in slices(bounds):
                data = raw[bounds[low] : bounds[high]].tobytes()
                for i in range(low, high):
                    out[i] = fingerprint(data[bounds[i] - bounds[low] : bounds[i + 1] - bounds[low]], words)
            return {"print": out.view(np.int64)}

        return apply

    return annotate(docs, F.col(text_col), worker, {"print": pa.int64()}, as_)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, distance: int = 4, blocks: int = 6) -> DataFrame:
    """(id_col, print, component_id) of every row of docs.

    Documents link where their fingerprints differ in ``distance`` bits or fewer; ``component_id`` is the smallest id that links reach,
    the row's own included.  All documents with one fingerprint count as one node, so copies are never paired; links are searched between
    distinct fingerprints, by block keys, and no link is lost.  Texts are read once.

    Null text counts as empty; texts without a word have fingerprint 0 and link like any other.  Repeated rows stay, with equal
    results.  Null ids are never the smallest, unless a component has none else (then null).  Other columns, whatever their names, are not looked at.
    An empty table gives no rows.
    """
    written = Written(docs.sparkSession, "simhash")
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    printed = written(fingerprints(slim, "text", words).select("id", F.col("simhash.print").alias("print")))
    prints = written(printed.groupBy("print").agg(F.min("id").alias("least")))
    labels = components(paths(prints.select("print"), written, blocks, distance), written).withColumnRenamed("node", "print")
    tops = written(labels.join(prints, "print").groupBy("label").agg(F.min("least").alias("top")))
    named = labels.join(tops, "label").select("print", "top")
    known = written(prints.join(named, "print", "left").select("print", F.coalesce("top", "least").alias("component_id")))
    return printed.join(known, "print").select(F.col("id").alias(id_col), "print", "component_id")


@dataclass(frozen=True)
class Near:
    """Documents link if their fingerprints of 256 bits share a block of ``width`` bits (``tables`` orders of the bits, each cut into blocks), differ in at
    most ``most_64`` of 64 bits and in at most ``most`` of all.  44 bits stand for a Jaccard similarity of shingles of about 0.8 (38.6 bits are expected there, 5.7 their deviation)."""

    width: int = 20
    tables: int = 4
    most_64: int = 16
    most: int = 44


def wide_fingerprints(docs: DataFrame, text_col: str, words: int, as_: str) -> DataFrame:
    """docs with a struct column ``as_`` of wide.COLUMNS: the SimHash of 256 bits of the texts' shingles, cut as in :func:`fingerprint`; no word: all 0."""

    def worker():
        def apply(texts: pa.Array) -> dict:
            raw, bounds = text_bytes(texts)
            out = np.zeros((len(texts), wide.WORDS), np.uint64)
            for low, high in slices(bounds):
                part, own = raw[bounds[low] : bounds[high]], bounds[low : high + 1] - bounds[low]
                part = part + 32 * ((part >= 65) & (part <= 90)).astype(np.uint8)
                start, end, at = word_spans(part, own)
                n = np.diff(at)
                size = np.minimum(n, words)
                shingles = np.where(n > 0, n - size + 1, 0)
                to = np.concatenate(([0], np.cumsum(shingles)))
                doc = np.repeat(np.arange(len(n)), shingles)
                first = at[doc] + np.arange(to[-1]) - to[doc]
                out[low:high] = wide.majority(span_hashes(prefix_sums(hash_spans(part, start, end)), first, first + size[doc]), to)
            return {k: out[:, i].view(np.int64) for i, k in enumerate(wide.COLUMNS)}

        return apply

    return annotate(docs, F.col(text_col), worker, dict.fromkeys(wide.COLUMNS, pa.int64()), as_)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, near: Near = Near()) -> DataFrame:
    """One row of each group of documents that links of ``near`` connect, columns unchanged: that with the smallest id, null being the last.

    Rows count by themselves, whatever their ids: of repeated rows one stays, rows with one id or none and unlike texts all stay.  Null text counts as empty;
    texts without a word are copies of each other.  Copies are one node from the first aggregate on.  Rows are written once with their numbers, so that
    each is told apart until the end, where only the numbers of those that go are joined with texts, which stay where they are if these are few.  An empty table stays empty; other columns are carried along whatever their names.
    """
    written = Written(docs.sparkSession, "keep-one")
    row, mark = free_name(docs.columns, "row"), free_name(docs.columns, "kept_row")
    small_batches(docs.sparkSession)
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()))
    slim = numbered.select(F.col(id_col).alias("id"), F.col(row).alias("row"), F.col(text_col).alias("text"))
    printed = wide_fingerprints(slim, "text", words, "simhash").select("id", "row", "simhash.*")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first")
    nodes = written(printed.groupBy(*wide.COLUMNS).agg(first).withColumn("node", F.monotonically_increasing_id()))
    found = wide.groups(nodes.select("node", *wide.COLUMNS), written, near.width, near.tables, near.most_64)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in grouped(batches, 1):
            key, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            prints = wide.prints_in(batch, 2)
            start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            end = np.append(start[1:], len(key))
            pair = start[end - start == 2]
            pair = pair[np.bitwise_count(prints[pair] ^ prints[pair + 1]).sum(1) <= near.most]
            out = [[node[pair]], [node[pair + 1]]]
            for low, high in zip(start[end - start > 2].tolist(), end[end - start > 2].tolist(), strict=True):
                for g in wide.walk(prints[low:high], near.most):
                    out[0].append(node[low + g[:-1]])
                    out[1].append(node[low + g[1:]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["a", "b"])

    rows = found.join(nodes.select("node", *wide.COLUMNS), "node").select("key", "node", *wide.COLUMNS)
    linked = rows.repartition("key").sortWithinPartitions("key").mapInArrow(verify, spark_schema({"a": pa.int64(), "b": pa.int64()}))
    edges = written(linked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if edges.isEmpty():
        keep = nodes.select(F.col("first.row").alias(mark))
    else:
        labels = components(edges, written)
        labelled = nodes.select("node", "first").join(labels, "node", "left")
        alone = F.when(F.col("label").isNull(), F.col("node"))
        keep = labelled.groupBy("label", alone.alias("alone")).agg(F.min("first").alias("first")).select(F.col("first.row").alias(mark))
    keep = written(keep)
    gone = written(numbered.select(row).join(keep, F.col(row) == F.col(mark), "left_anti").withColumnRenamed(row, mark))
    written.drop_but(numbered, gone)
    return numbered.join(gone, F.col(row) == F.col(mark), "left_anti").drop(row)
