"""Graphs of steps. A node's input is what its dependencies put out, one after the other; nodes without any get the input."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from .dataset import Dataset
from .errors import PipelineError
from .functions.storage import written
from .registry import get


@dataclass(frozen=True)
class Node:
    id: str
    operator: str
    config: Mapping[str, Any] = field(default_factory=dict)
    cache: bool = False


class Graph:
    def __init__(self) -> None:
        self.nodes: dict[str, Node] = {}
        self.needs: dict[str, list[str]] = {}

    def add(self, id: str, operator: str, config: Mapping[str, Any] | None = None, cache: bool = False) -> Graph:
        if id in self.nodes:
            raise PipelineError(f"two nodes {id!r}")
        self.nodes[id] = Node(id, operator, config or {}, cache)
        self.needs[id] = []
        return self

    def edge(self, a: str, b: str) -> Graph:
        """b takes what a puts out."""
        for x in (a, b):
            if x not in self.nodes:
                raise PipelineError(f"no node {x!r}")
        if a not in self.needs[b]:
            self.needs[b].append(a)
        return self

    def levels(self) -> list[list[str]]:
        """Nodes whose dependencies all are in earlier levels; those of a level don't depend on each other."""
        done: set[str] = set()
        out = []
        while len(done) < len(self.nodes):
            level = sorted(n for n in self.nodes if n not in done and all(d in done for d in self.needs[n]))
            if not level:
                raise PipelineError(f"a cycle among {sorted(set(self.nodes) - done)}")
            out.append(level)
            done.update(level)
        return out

    def order(self) -> list[str]:
        return [n for level in self.levels() for n in level]

    def sinks(self) -> list[str]:
        used = {d for needs in self.needs.values() for d in needs}
        return [n for n in self.order() if n not in used]

    def run_all(self, data: Dataset | DataFrame) -> dict[str, Dataset]:
        """What each node puts out, lazily; a node marked cache is a table in the shared folder."""
        source = data if isinstance(data, Dataset) else Dataset.of(data)
        out: dict[str, Dataset] = {}
        for name in self.order():
            node = self.nodes[name]
            given = [out[d] for d in self.needs[name]] or [source]
            ds = given[0] if len(given) == 1 else get("merge.concat")(given[0], {"inputs": given[1:]})
            ds = get(node.operator)(ds, node.config)
            out[name] = ds.on(written(ds.df, "node")) if node.cache else ds
        return out

    def run(self, data: Dataset | DataFrame) -> Dataset:
        """What the nodes that nothing depends on put out, one after the other."""
        if not self.nodes:
            raise PipelineError("an empty graph")
        out = self.run_all(data)
        ends = [out[n] for n in self.sinks()]
        return ends[0] if len(ends) == 1 else get("merge.concat")(ends[0], {"inputs": ends[1:]})
