"""Flows of processors over DataFrames, batch or streaming."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.model import MAX_MS, MIN_MS, LifeTime, millis
from sluice.operators.transforms import lifetime_filter
from sluice.plans.graph import Graph, Path


@dataclass(frozen=True)
class Processor:
    """A vertex: ``run`` gets one DataFrame (the union of all inputs; a source gets the session) and gives one.

    ``parallelism`` is a hint: it only repartitions where an edge's partitioner asks for rows to be dealt out.
    """

    name: str
    run: Callable[..., DataFrame] = field(compare=False)
    parallelism: int = 1
    description: str = ""
    conf: tuple[tuple[str, str], ...] = ()
    life: LifeTime = LifeTime()


def sink(name: str, write: Callable[[DataFrame], Any], parallelism: int = 1, description: str = "") -> Processor:
    """A vertex that ends a flow: ``write`` gets the rows once the flow is evaluated, and they go on unchanged to whatever follows."""

    def run(df: DataFrame) -> DataFrame:
        write(df)
        return df

    return Processor(name, run, parallelism, description)


class Flow:
    """A directed acyclic graph of processors; its edges carry a partitioner (a function of a DataFrame) or None, which leaves the exchange to Spark."""

    def __init__(self, name: str, *paths: Path, version: int = 0):
        self.name, self.version, self.graph = name, version, Graph(*paths)
        names = [p.name for p in self.graph.vertices()]
        if len(names) != len(set(names)):
            raise ValueError("two processors have one name")
        if self.graph.has_duplicated_edge():
            raise ValueError("two edges join the same processors")
        if self.graph.has_cycle():
            raise ValueError("a flow must not have a cycle")

    def ids(self) -> dict[str, int]:
        """Numbers by topological order."""
        return {p.name: i for i, p in enumerate(self.graph.topological_order())}

    def evaluate(self, spark: SparkSession, ts_col: str | None = None) -> dict[str, DataFrame]:
        """Every processor's output, by name.

        Several inputs are united first; several consumers share one DataFrame. With ``ts_col`` an edge carries only messages within the lives of both ends.
        """
        out: dict[str, DataFrame] = {}
        for node in self.graph.topological_order():
            inputs = []
            for a, partitioner, _ in self.graph.incoming(node):
                df = out[a.name]
                life = a.life.cross(node.life)
                if ts_col and (life.birth > MIN_MS or life.death < MAX_MS):
                    df = lifetime_filter(df, life, ts_col)
                inputs.append(partitioner(df) if partitioner else df)
            if not inputs:
                out[node.name] = node.run(spark)
                continue
            whole = inputs[0]
            for df in inputs[1:]:
                whole = whole.unionByName(df)
            out[node.name] = node.run(whole)
        return out

    def replaced(self, old: str, new: Processor, inherit_conf: bool = False) -> Flow:
        """The next version: ``new`` has old's edges and takes over at its birth, when old's life ends; both stay in the flow."""
        before = next(p for p in self.graph.vertices() if p.name == old)
        if inherit_conf:
            new = replace(new, conf=before.conf)
        ended = replace(before, life=LifeTime(before.life.birth, new.life.birth))
        flow = Flow.__new__(Flow)
        flow.name, flow.version = self.name, self.version + 1
        flow.graph = self.graph.replace_vertex(before, ended)
        for a, e, b in flow.graph.edges():
            if a == ended:
                flow.graph.add_edge(new, e, b)
            if b == ended:
                flow.graph.add_edge(a, e, new)
        return flow


def diff(old: Flow, new: Flow) -> dict[str, set[str]]:
    """Names of processors of ``new``: added; modified (another description, parallelism, conf or life); impacted (unchanged, but they send to
    one that was added or modified)."""
    before = {p.name: p for p in old.graph.vertices()}
    after = {p.name: p for p in new.graph.vertices()}
    added = after.keys() - before.keys()
    modified = {n for n in after.keys() & before.keys() if after[n] != before[n]}
    upstream = {a.name for a, _, b in new.graph.edges() if b.name in added | modified}
    return {"added": set(added), "modified": modified, "impacted": upstream - added - modified}


def from_json(text: str, registry: Mapping[str, Callable[..., Any]]) -> Flow:
    """A flow from JSON: {"name", "processors": [{"name", "run", "parallelism", "args"}], "edges": [[from, to]]}; ``run`` names a function of ``registry`` that
    takes ``args`` and gives the processor's function. Nothing else is looked up."""
    plan = json.loads(text)
    nodes = {p["name"]: Processor(p["name"], registry[p["run"]](**p.get("args", {})), p.get("parallelism", 1), p.get("description", "")) for p in plan["processors"]}
    linked = {x for edge in plan["edges"] for x in edge}
    return Flow(plan["name"], *(Path(nodes[a]).to(nodes[b]) for a, b in plan["edges"]), *(Path(n) for name, n in nodes.items() if name not in linked))


def replace_processor(df: DataFrame, birth_ms: int, old: Mapping[str, Any], new: Mapping[str, Any], ts_col: str = "ts") -> DataFrame:
    """A switch at an event time: columns by ``old`` expressions before ``birth_ms``, by ``new`` ones from then on. One pass, no union."""
    ms = millis(ts_col)
    return df.withColumns({name: F.when(ms < birth_ms, old[name]).otherwise(new[name]) for name in old})
