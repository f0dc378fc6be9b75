"""Graphs as tables: vertices (id, idx) and edges (src, dst, label, idx)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local one only where none is set and the master is local."""
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    if found := context.getConf().get("spark.checkpoint.dir"):
        return found.rstrip("/")
    if known.isEmpty():
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="sluice-"))
        known = context._jsc.sc().getCheckpointDir()
    return known.get().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written once in the shared checkpoint folder and read back: cuts lineage, and is computed once where ``checkpoint()`` would be twice."""
    path = f"{shared_dir(df.sparkSession)}/sluice-cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def degrees(edges: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree): one shuffle, both ends counted before it."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    return ends.groupBy("e.id").agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))


def edges_of(edges: DataFrame, node: object, way: str = "both") -> DataFrame:
    """Edges in, out or both ways."""
    conditions = {"in": F.col("dst") == node, "out": F.col("src") == node}
    return edges.where(conditions[way] if way in conditions else conditions["in"] | conditions["out"])


def subgraph(edges: DataFrame, node: object) -> DataFrame:
    """The node, its neighbours and the edges between it and them."""
    return edges_of(edges, node)


def duplicate_edges(edges: DataFrame) -> DataFrame:
    """(src, dst, n): pairs with several edges."""
    return edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def replace_vertex(edges: DataFrame, old: object, new: object) -> DataFrame:
    end = lambda c: F.when(F.col(c) == old, F.lit(new)).otherwise(F.col(c)).alias(c)
    return edges.select(*(end(c) if c in ("src", "dst") else F.col(c) for c in edges.columns))


def union_graphs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Edges of both, once each."""
    return a.unionByName(b).distinct()


def levels(edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """(id, level) of an acyclic graph: the length of the longest path to each vertex, so that levels rise along edges.

    Level by level: a level's vertices are those that have an edge from the one before; the last level that a vertex is
    reached in is its own. A cycle would never end, so that after ``rounds`` levels there is an error.
    """
    ends = edges.select("src", "dst").distinct()
    nodes = ends.select(F.col("src").alias("id")).union(ends.select(F.col("dst").alias("id"))).distinct()
    front = cut(nodes.join(ends.select(F.col("dst").alias("id")).distinct(), "id", "left_anti"))
    out = front.withColumn("level", F.lit(0))
    for level in range(1, rounds + 1):
        front = cut(ends.join(front.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id")).distinct())
        if front.isEmpty():
            return out.groupBy("id").agg(F.max("level").alias("level"))
        out = out.union(front.withColumn("level", F.lit(level)))
    raise ValueError("the graph has a cycle, or more levels than rounds")


def pagerank(vertices: DataFrame, edges: DataFrame, rounds: int = 100, delta: float = 0.001, cut_every: int = 5) -> DataFrame:
    """(id, weight): undamped PageRank from weights of 1.

    Each round a vertex passes its weight on in equal shares; one without successors passes it to all vertices. Ends once no weight moves by over
    ``delta``, or after ``rounds``. One join and one aggregate, combined before its shuffle, a round; lineage is cut each round if a figure of it is needed
    (the largest move, the weight of vertices without successors, both in one job), else every few. Without edges at all weights stay as they are spread.
    """
    edges = cut(edges.select("src", "dst"))
    out_degree = edges.groupBy("src").agg(F.count(F.lit(1)).alias("out"))
    shares = cut(edges.join(out_degree, "src").select("src", "dst", (1.0 / F.col("out")).alias("share")))
    ranks = cut(vertices.select("id").join(out_degree.withColumnRenamed("src", "id"), "id", "left").select("id", F.lit(1.0).alias("weight"), F.col("out").isNull().alias("dangling")))
    n, loose = ranks.agg(F.count(F.lit(1)), F.sum(F.when(F.col("dangling"), F.col("weight")))).first()
    watched = delta > 0 or loose is not None
    for i in range(rounds):
        sent = shares.join(ranks.select(F.col("id").alias("src"), "weight"), "src").select(F.col("dst").alias("id"), (F.col("share") * F.col("weight")).alias("got"), F.lit(0.0).alias("was"), F.lit(False).alias("own"), F.lit(False).alias("dangling"))
        own = ranks.select("id", F.lit((loose or 0.0) / (n or 1)).alias("got"), F.col("weight").alias("was"), F.lit(True).alias("own"), "dangling")
        ranks = sent.union(own).groupBy("id").agg(F.sum("got").alias("weight"), F.sum("was").alias("was"), F.max("own").alias("own"), F.max("dangling").alias("dangling")).where("own")
        if watched or (i + 1) % cut_every == 0:
            ranks = cut(ranks)
        if watched:
            moved, loose = ranks.agg(F.max(F.abs(F.col("weight") - F.col("was"))), F.sum(F.when(F.col("dangling"), F.col("weight")))).first()
            if delta > 0 and (moved or 0.0) <= delta:
                break
    return ranks.select("id", "weight")


def levels_sql(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """:func:`levels` as a recursive query, for graphs whose paths are few."""
    edges.createOrReplaceTempView("_sluice_edges")
    return spark.sql("""
        WITH RECURSIVE walk(id, level) AS (
            SELECT DISTINCT src, 0 FROM _sluice_edges WHERE src NOT IN (SELECT dst FROM _sluice_edges)
            UNION ALL SELECT e.dst, w.level + 1 FROM walk w JOIN _sluice_edges e ON e.src = w.id)
        SELECT id, max(level) AS level FROM walk GROUP BY id""")
