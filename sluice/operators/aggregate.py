"""Grouping and combining."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.operators.windows import WINDOW, Strategy, assign, group_time


def group_by_key(df: DataFrame, key: str, value: str, strategy: Strategy = Strategy(), ts_col: str = "ts") -> DataFrame:
    """(key, [WINDOW, ts,] values): all values of a key and window, sorted; one final pane. Prefer :func:`combine`: it adds up before the shuffle."""
    strategy.check()
    rows = assign(df, strategy, ts_col)
    keys = [key, WINDOW] if strategy.size else [key]
    time = [group_time(strategy.combiner, ts_col).alias(ts_col)] if strategy.size else []
    return rows.groupBy(*keys).agg(*time, F.sort_array(F.collect_list(value)).alias("values"))


#: Combine functions by name; all of them add up partly before a shuffle.
COMBINERS: Mapping[str, Callable[[Column], Column]] = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count, "mean": F.avg}


def combine(df: DataFrame, key: str, value: str, how: str | Callable[[Column], Column], strategy: Strategy = Strategy(), ts_col: str = "ts", as_: str = "value") -> DataFrame:
    """(key, [WINDOW, ts,] as_): grouping and combining as one aggregate."""
    strategy.check()
    fn = COMBINERS[how] if isinstance(how, str) else how
    rows = assign(df, strategy, ts_col)
    keys = [key, WINDOW] if strategy.size else [key]
    time = [group_time(strategy.combiner, ts_col).alias(ts_col)] if strategy.size else []
    return rows.groupBy(*keys).agg(*time, fn(F.col(value)).alias(as_))


def combine_custom(df: DataFrame, key: str, value: str, zero: Column, add: Callable[[Column, Column], Column], extract: Callable[[Column], Column] = lambda x: x, as_: str = "value") -> DataFrame:
    """A combine function that no built-in aggregate expresses: folds the sorted values of a key."""
    grouped = df.groupBy(key).agg(F.sort_array(F.collect_list(value)).alias("_values"))
    return grouped.select(key, F.aggregate("_values", zero, add, extract).alias(as_))


@dataclass(frozen=True)
class Monoid:
    """An associative aggregate: ``of`` over rows, ``plus`` of two results, ``zero``; with ``minus`` it is a group."""

    of: Callable[[Column], Column]
    plus: Callable[[Column, Column], Column]
    zero: Column
    minus: Callable[[Column, Column], Column] | None = None


def monoids() -> dict[str, Monoid]:
    zero = F.lit(0).cast("long")
    return {
        "sum": Monoid(lambda c: F.coalesce(F.sum(c), zero), lambda a, b: a + b, zero, lambda a, b: a - b),
        "count": Monoid(lambda c: F.count(c), lambda a, b: a + b, zero, lambda a, b: a - b),
        "min": Monoid(F.min, lambda a, b: F.least(a, b), F.lit(None).cast("long")),
        "max": Monoid(F.max, lambda a, b: F.greatest(a, b), F.lit(None).cast("long")),
        "set": Monoid(F.collect_set, lambda a, b: F.array_union(a, b), F.array()),
    }


def word_count(df: DataFrame, word: str = "word") -> DataFrame:
    return df.groupBy(word).agg(F.count(F.lit(1)).alias("n"))


def cogroup(parts: Mapping[str, DataFrame], key: str, value: str, how: str = "sum") -> DataFrame:
    """One row per key with a combined value for each tagged input (null where an input lacks the key): a union and one grouping, no join."""
    tagged = None
    for tag, part in parts.items():
        own = part.select(F.col(key), F.col(value), F.lit(tag).alias("_tag"))
        tagged = own if tagged is None else tagged.unionByName(own)
    fn = COMBINERS[how]
    return tagged.groupBy(key).agg(*(fn(F.when(F.col("_tag") == tag, F.col(value))).alias(tag) for tag in parts))
