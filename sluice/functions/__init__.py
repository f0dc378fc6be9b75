"""Column functions that the operators share."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cents(value: Column) -> Column:
    """A money amount as a whole number, so that sums don't depend on their order."""
    return F.round(value * 100).cast("long")


def string_hash(text: Column) -> Column:
    """The 32 bits of the fold ``31 * h + code`` over an ASCII text, as a non-negative long."""
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: (h * 31 + c).bitwiseAND(0xFFFFFFFF))


def bucket_of(text: Column, n: int) -> Column:
    """The hash without its sign bit, modulo n."""
    return string_hash(text).bitwiseAND(0x7FFFFFFF) % n


def floor_to(ms: Column, step: int) -> Column:
    """The largest multiple of step up to ms (ms not negative)."""
    return ms - F.pmod(ms, F.lit(step))


def glob_regex(path: str) -> str:
    """``*``: any characters, ``?``: one; anchored at the start, open at the end."""
    return "^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in path)


def words(text: Column) -> Column:
    """Non-empty parts between runs of white space."""
    return F.filter(F.split(text, r"[ \t\n\r\f]+"), lambda w: w != "")


def letters(text: Column) -> Column:
    """Lower-case runs of a-z."""
    return F.filter(F.split(F.lower(text), "[^a-z]+"), lambda w: w != "")


def numbered(df: DataFrame, order: list[str], index: Column, as_: str = "row", size: int = 4096) -> DataFrame:
    """df with a global row number (from 0) by ``order``, without sorting everything in one task.

    ``index``: a whole number that doesn't fall while ``order`` rises. Rows are numbered within chunks of ``size`` index values, chunks within
    chunks of ``size`` of them; only the counts of the latter, one row for size * size index values, are added up in one place.
    """
    df = df.withColumn("_chunk", F.floor(index / size))
    counts = df.groupBy("_chunk").agg(F.count(F.lit(1)).alias("_n")).withColumn("_block", F.floor(F.col("_chunk") / size))
    blocks = counts.groupBy("_block").agg(F.sum("_n").alias("_all"))
    blocks = blocks.select("_block", (F.sum("_all").over(Window.orderBy("_block")) - F.col("_all")).alias("_before"))
    inner = F.sum("_n").over(Window.partitionBy("_block").orderBy("_chunk")) - F.col("_n")
    base = counts.withColumn("_inner", inner).join(blocks, "_block").select("_chunk", (F.col("_before") + F.col("_inner")).alias("_base"))
    local = F.row_number().over(Window.partitionBy("_chunk").orderBy(*order)) - 1
    return df.withColumn("_local", local).join(base, "_chunk").withColumn(as_, F.col("_base") + F.col("_local")).drop("_chunk", "_base", "_local")
