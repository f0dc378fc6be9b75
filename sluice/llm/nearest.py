"""Operator 9: nearest vectors by a block matrix join of int8 codes, with exact recomputation within error bounds."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import Written, small_batches, spark_schema

#: Vectors of a candidate block and of a query block, about; and queries whose products are held at once.
CANDIDATES, QUERIES, ROWS = 8192, 1024, 64
#: Components whose products of codes are added up exactly in float32: 127 * 127 * EXACT is below 2**24.
EXACT = 1024


def usable(vector: Column) -> Column:
    """Not null, not empty, no null or non-finite component, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | x.isin(float("inf"), float("-inf")))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, in double precision, added up in the order of components; so equal rows have equal products."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes (held as float32), each row's step, and the sum of its codes' sizes; a step too small for a number is NaN, and with it all bounds."""
    step = np.abs(x).max(1) / 127.0
    step[step == 0] = np.nan
    code = np.nan_to_num(np.rint(x / step[:, None]))
    return code.astype(np.float32), step, np.abs(code).sum(1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of codes, exact: of EXACT components at once in float32, whose sums stay below 2**24, and these added up in double precision."""
    out = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], EXACT):
        out += a[:, at : at + EXACT] @ b[:, at : at + EXACT].T
    return out


def tile(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> list[tuple[int, list[int], list[float]]]:
    """(query, ids, scores): the k best of one block of candidates for each query of one block, best first.

    A product of codes is off by at most half a step times the other side's sizes, both ways, and a quarter of a step squared per component.
    Candidates whose upper bound reaches the k-th best lower bound are recomputed from the vectors, and so are those whose bounds aren't finite, as
    with components near the ends of what a number can hold.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        return _tile(query_ids, queries, ids, vectors, k)


def _tile(query_ids, queries, ids, vectors, k):
    qc, qs, qn = quantised(queries)
    cc, cs, cn = quantised(vectors)
    out = []
    for low in range(0, len(queries), ROWS):
        part = slice(low, low + ROWS)
        scale = qs[part, None] * cs[None, :]
        product = products(qc[part], cc) * scale
        off = (0.5 * (qn[part, None] + cn[None, :]) + 0.25 * queries.shape[1]) * scale * (1 + 1e-9)
        own = query_ids[part, None] == ids[None, :]
        least, most = product - off, product + off
        unknown = ~(np.isfinite(least) & np.isfinite(most))
        least[own | unknown] = -np.inf
        most[unknown] = np.inf
        if len(ids) > k:
            bound = np.partition(least, len(ids) - k, axis=1)[:, len(ids) - k]
        else:
            bound = np.full(len(least), -np.inf)
        row, column = np.nonzero(~own & (most >= bound[:, None]))
        score = dot(queries[part][row], vectors[column])
        order = np.lexsort((ids[column], -score, row))
        row, column, score = row[order], column[order], score[order]
        at = np.searchsorted(row, np.arange(len(least) + 1))
        for i in range(len(least)):
            best = slice(at[i], min(at[i + 1], at[i] + k))
            out.append((int(query_ids[low + i]), ids[column[best]].tolist(), score[best].tolist()))
    return out


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every``, its k nearest rows by inner product, exactly.

    Blocks of queries meet blocks of candidates; every tile keeps its best k of each query, and the tiles' lists are merged by a heap.
    Each tile holds one block of each side; a hot vector makes no block larger, for blocks go by ids.

    Rows with a null id, and null, empty, zero or non-finite vectors (or with such components) take no part.  Vectors of different lengths aren't
    comparable: the search is within each length.  Rows with one id are one another's own, so never each other's neighbours; if such an
    id is a query, the answers are those of one such row with the smallest components.  Fewer candidates than k: all.  None: no rows.  Ties go to the smaller id; products that overflow are
    infinite, and those that are no number come last.  An
    empty table gives no rows; other columns are not looked at.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    written = Written(spark, "nearest")
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    own = own.where(F.col("id").isNotNull() & usable(F.col("v"))).withColumn("dim", F.size("v"))
    isq = F.pmod("id", F.lit(every)) == 0
    sizes = own.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count_if(isq).alias("q"))
    # the number of blocks of each side, for each length of vectors
    sizes = written(sizes.select("dim", F.ceil(F.col("n") / CANDIDATES).cast("int").alias("cs"), F.ceil(F.col("q") / QUERIES).cast("int").alias("qs")))
    own = own.join(sizes, "dim").where("qs > 0")

    def block(count: str) -> Column:
        return F.pmod(F.xxhash64("id"), F.col(count)).cast("int")

    packed_schema = {"dim": pa.int32(), "block": pa.int32(), "others": pa.int32(), "ids": pa.binary(), "data": pa.binary()}

    def pack(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        dim, n = table["dim"][0].as_py(), table.num_rows
        ids = table["id"].to_numpy()
        flat = table["v"].chunk(0).flatten().to_numpy(zero_copy_only=False).reshape(n, dim)
        order = np.lexsort((*flat.T[::-1], ids))
        # rows with one id and one vector count once
        same = (ids[order][1:] == ids[order][:-1]) & (flat[order][1:] == flat[order][:-1]).all(1)
        order = order[np.concatenate(([True], ~same))]
        return pa.table({"dim": pa.array([dim], pa.int32()), "block": pa.array([table["block"][0].as_py()], pa.int32()), "others": pa.array([table["others"][0].as_py()], pa.int32()), "ids": pa.array([ids[order].tobytes()], pa.binary()), "data": pa.array([flat[order].tobytes()], pa.binary())})

    def blocks(df: DataFrame, mine: str, others: str) -> DataFrame:
        rows = df.select("dim", "id", "v", block(mine).alias("block"), F.col(others).alias("others"))
        return written(rows.groupBy("dim", "block").applyInArrow(pack, spark_schema(packed_schema)))

    asked = blocks(own.where(isq), "qs", "cs")
    there = blocks(own, "cs", "qs")
    every_other = F.explode(F.sequence(F.lit(0), F.col("others") - 1))
    left = asked.select("dim", F.col("block").alias("q"), every_other.alias("c"), "ids", "data")
    right = there.select("dim", F.col("block").alias("c"), every_other.alias("q"), "ids", "data")

    lists = {"query_id": pa.int64(), "ids": pa.list_(pa.int64()), "scores": pa.list_(pa.float64())}

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        found = []
        if a.num_rows and b.num_rows:
            dim = a["dim"][0].as_py()
            qi, ci = (np.frombuffer(t["ids"][0].as_py(), np.int64) for t in (a, b))
            qv, cv = (np.frombuffer(t["data"][0].as_py(), np.float64).reshape(-1, dim) for t in (a, b))
            first = np.concatenate(([True], qi[1:] != qi[:-1]))
            found = tile(qi[first], qv[first], ci, cv, k)
        return pa.table({name: pa.array([x[i] for x in found], kind) for i, (name, kind) in enumerate(lists.items())})

    met = left.groupBy("dim", "q", "c").cogroup(right.groupBy("dim", "q", "c")).applyInArrow(meet, spark_schema(lists))

    final = {"query_id": pa.int64(), "rank": pa.int32(), "vec_id": pa.int64(), "score": pa.float64()}

    def merge(table: pa.Table) -> pa.Table:
        runs = ([(s != s, -s if s == s else 0.0, i) for i, s in zip(a, b, strict=True)] for a, b in zip(table["ids"].to_pylist(), table["scores"].to_pylist(), strict=True))
        best = []
        for pair in heapq.merge(*runs):
            if not best or best[-1] != pair:  # rows with one id and one vector count once
                best.append(pair)
            if len(best) == k:
                break
        n = len(best)
        return pa.table({"query_id": pa.array([table["query_id"][0].as_py()] * n, pa.int64()), "rank": pa.array(range(1, n + 1), pa.int32()), "vec_id": pa.array([i for *_, i in best], pa.int64()), "score": pa.array([np.nan if bad else -s + 0.0 for bad, s, _ in best], pa.float64())})

    return met.groupBy("query_id").applyInArrow(merge, spark_schema(final))
