"""Connected components by contraction, without collecting edges or labels anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import Written


def components(edges: DataFrame, written: Written) -> DataFrame:
    """(node, label) for every node of ``edges`` (columns a, b); label is the same within a component only.

    Each round, every node points to the smallest node next to it if that is smaller, pointers are followed to
    their ends, and the edges are renamed to those ends; equal ones fall together.  A round at least halves the nodes that
    still have edges, so the number of rounds grows with the logarithm of the largest component.
    All aggregates combine on the map side (min, distinct); joins are between written tables, which
    adaptive execution can split where many nodes point to one.
    Loops and repeated edges do no harm; null ends are dropped; no edges give no rows.
    """
    edges = edges.where("a is not null and b is not null")
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    both = written(both.distinct())
    labels = None
    while True:
        parent = written(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("label")))
        while True:
            up = parent.select(F.col("node").alias("label"), F.col("label").alias("top"))
            # every label is a node of the same table
            jumped = written(parent.join(up, "label").select("node", F.col("top").alias("label"), (F.col("top") != F.col("label")).alias("moved")))
            moved = not jumped.where("moved").isEmpty()
            written.drop(parent)
            parent = jumped
            if not moved:
                break
        parent = jumped.select("node", "label")
        if labels is None:
            labels = parent
        else:
            nxt = parent.select(F.col("node").alias("label"), F.col("label").alias("top"))
            labels = written(labels.join(nxt, "label", "left").select("node", F.coalesce("top", "label").alias("label")))
        pu = parent.select(F.col("node").alias("u"), F.col("label").alias("pu"))
        pv = parent.select(F.col("node").alias("v"), F.col("label").alias("pv"))
        half = written(both.join(pu, "u").select("pu", "v"))
        nearer = written(half.join(pv, "v").where("pu != pv").select(F.col("pu").alias("u"), F.col("pv").alias("v")).distinct())
        written.drop(both, half)
        both = nearer
        if both.isEmpty():
            return labels
