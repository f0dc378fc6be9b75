"""A small directed graph on the driver, in insertion order: for plans, not for data."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterator
from typing import Any

Edge = tuple[Hashable, Any, Hashable]


class Path:
    """``Path(a).to(b, edge).to(c)``: edges in a row."""

    def __init__(self, first: Hashable):
        self.nodes: list[Hashable] = [first]
        self.edges: list[Any] = []

    def to(self, node: Hashable, edge: Any = None) -> Path:
        self.nodes.append(node)
        self.edges.append(edge)
        return self


class Graph:
    def __init__(self, *paths: Path):
        self._nodes: dict[Hashable, None] = {}
        self._edges: dict[Edge, None] = {}
        for path in paths:
            self.add_path(path)

    def add_path(self, path: Path) -> None:
        self.add_vertex(path.nodes[0])
        for a, e, b in zip(path.nodes, path.edges, path.nodes[1:], strict=False):
            self.add_edge(a, e, b)

    def add_vertex(self, node: Hashable) -> None:
        self._nodes.setdefault(node)

    def add_edge(self, a: Hashable, edge: Any, b: Hashable) -> None:
        self.add_vertex(a)
        self.add_vertex(b)
        self._edges.setdefault((a, edge, b))

    def remove_vertex(self, node: Hashable) -> None:
        self._nodes.pop(node, None)
        self._edges = {e: None for e in self._edges if node not in (e[0], e[2])}

    def remove_edge(self, a: Hashable, edge: Any, b: Hashable) -> None:
        self._edges.pop((a, edge, b), None)

    def vertices(self) -> list[Hashable]:
        return list(self._nodes)

    def edges(self) -> list[Edge]:
        return list(self._edges)

    def incoming(self, node: Hashable) -> list[Edge]:
        return [e for e in self._edges if e[2] == node]

    def outgoing(self, node: Hashable) -> list[Edge]:
        return [e for e in self._edges if e[0] == node]

    def in_degree(self, node: Hashable) -> int:
        return len(self.incoming(node))

    def out_degree(self, node: Hashable) -> int:
        return len(self.outgoing(node))

    def is_empty(self) -> bool:
        return not self._nodes

    def copy(self) -> Graph:
        return self.map_edge(lambda a, e, b: e)

    def add_graph(self, other: Graph) -> Graph:
        for node in other._nodes:
            self.add_vertex(node)
        for edge in other._edges:
            self.add_edge(*edge)
        return self

    def map_vertex(self, fn: Callable[[Hashable], Hashable]) -> Graph:
        names = {node: fn(node) for node in self._nodes}
        out = Graph()
        for node in self._nodes:
            out.add_vertex(names[node])
        for a, e, b in self._edges:
            out.add_edge(names[a], e, names[b])
        return out

    def map_edge(self, fn: Callable[[Hashable, Any, Hashable], Any]) -> Graph:
        out = Graph()
        for node in self._nodes:
            out.add_vertex(node)
        for a, e, b in self._edges:
            out.add_edge(a, fn(a, e, b), b)
        return out

    def subgraph(self, node: Hashable) -> Graph:
        """The node, its neighbours, and the edges between it and them."""
        out = Graph()
        out.add_vertex(node)
        for edge in self._edges:
            if node in (edge[0], edge[2]):
                out.add_edge(*edge)
        return out

    def replace_vertex(self, old: Hashable, new: Hashable) -> Graph:
        return self.map_vertex(lambda x: new if x == old else x)

    def has_duplicated_edge(self) -> bool:
        ends = [(a, b) for a, _, b in self._edges]
        return len(ends) != len(set(ends))

    def components(self) -> list[list[Hashable]]:
        """The strongly connected components, each in insertion order, in topological order, those that could come first in insertion order first.

        Two vertices share a component if each reaches the other.
        """
        reach = {node: self._reached(node) for node in self._nodes}
        group: dict[Hashable, Hashable] = {}
        for node in self._nodes:
            group[node] = next((x for x in group if group[x] == x and node in reach[x] and x in reach[node]), node)
        waiting = {lead: {group[a] for a, _, b in self._edges if group[b] == lead} - {lead} for lead in dict.fromkeys(group.values())}
        out = []
        while waiting:
            ready = next(lead for lead, before in waiting.items() if not before)
            del waiting[ready]
            for before in waiting.values():
                before.discard(ready)
            out.append([x for x in self._nodes if group[x] == ready])
        return out

    def _reached(self, node: Hashable) -> set[Hashable]:
        seen, todo = {node}, [node]
        while todo:
            for _, _, b in self.outgoing(todo.pop()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        return seen

    def has_cycle(self) -> bool:
        return any(len(c) > 1 for c in self.components()) or any(a == b for a, _, b in self._edges)

    def topological_order(self) -> Iterator[Hashable]:
        """Each vertex after those that lead to it; of a cycle's vertices, which have no such order, in insertion order."""
        return (node for c in self.components() for node in c)

    def levels(self) -> dict[Hashable, int]:
        """Numbers that rise along edges (within a cycle: along insertion order)."""
        out: dict[Hashable, int] = {}
        for node in self.topological_order():
            out[node] = max((out[a] + 1 for a, _, _ in self.incoming(node) if a in out), default=0)
        return out
