"""Pipelines: steps compiled into one lazy plan.

A step is an operator with its config, a sequence, a choice by whether a predicate leaves any row, or parallel branches
whose results follow each other. Nothing runs until the result is used, but for the test of a choice.
"""

from __future__ import annotations

import hashlib
import json
import logging
import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .dataset import Dataset
from .errors import ConfigError, MillError, OperatorError, PipelineError
from .functions.storage import shared_folder
from .registry import get

log = logging.getLogger(__name__)
Step = Mapping[str, Any]


def step(operator: str, config: Mapping[str, Any] | None = None) -> Step:
    """A step as configuration has it."""
    return {"operator": operator, "config": dict(config or {})}


@dataclass(frozen=True)
class Node:
    kind: str
    name: str = ""
    config: Mapping[str, Any] = field(default_factory=dict)
    parts: tuple[tuple[Node, ...], ...] = ()

    @staticmethod
    def of(step: Step) -> Node:
        """{operator, config}, {sequence: steps}, {if: steps, then: steps, else: steps} or {parallel: [steps, ...]}."""
        if not isinstance(step, Mapping):
            raise PipelineError("a step must be an object")
        if "operator" in step:
            if not isinstance(step["operator"], str) or not isinstance(step.get("config") or {}, Mapping):
                raise PipelineError("a step needs the name of an operator and an object for config")
            return Node("operator", step["operator"], step.get("config") or {})
        if "sequence" in step:
            return Node("sequence", parts=(nodes(step["sequence"]),))
        if "if" in step:
            return Node("choice", parts=(nodes(step["if"]), nodes(step.get("then") or [], True), nodes(step.get("else") or [], True)))
        if "parallel" in step:
            branches = step["parallel"]
            if not isinstance(branches, Sequence) or not branches:
                raise PipelineError("parallel needs a branch")
            return Node("parallel", parts=tuple(nodes(b) for b in branches))
        raise PipelineError(f"no step: {sorted(step)}")


def nodes(steps: Any, empty: bool = False) -> tuple[Node, ...]:
    if not isinstance(steps, Sequence) or isinstance(steps, str) or not (steps or empty):
        raise PipelineError("steps must be a list with one at least")
    return tuple(Node.of(s) for s in steps)


class Pipeline:
    """Steps, checked for their structure and their operators' names when it is made."""

    def __init__(self, steps: Sequence[Step] | str):
        self.steps = json.loads(steps) if isinstance(steps, str) else list(steps)
        self.nodes = nodes(self.steps)
        self.validate()

    def validate(self) -> None:
        def walk(some: tuple[Node, ...]) -> None:
            for n in some:
                if n.kind == "operator":
                    get(n.name)
                for part in n.parts:
                    walk(part)

        walk(self.nodes)

    @property
    def digest(self) -> str:
        return hashlib.sha256(json.dumps(self.steps, sort_keys=True, default=repr).encode()).hexdigest()

    def __call__(self, data: Dataset | DataFrame) -> Dataset:
        return self.run(data)

    def run(self, data: Dataset | DataFrame, watch: Callable[[str, Dataset, Dataset], Dataset] | None = None) -> Dataset:
        """The result; a lazy plan. watch sees every operator's input and output and may change the output."""
        return _run(self.nodes, data if isinstance(data, Dataset) else Dataset.of(data), watch)

    def observed(self, data: Dataset | DataFrame) -> tuple[Dataset, list[tuple[str, Observation]]]:
        """The result, and the number of rows that each operator put out, to be read when the result has been used."""
        seen: list[tuple[str, Observation]] = []

        def watch(name: str, _: Dataset, out: Dataset) -> Dataset:
            o = Observation(f"{len(seen)}:{name}")
            seen.append((name, o))
            return out.on(out.df.observe(o, F.count(F.lit(1)).alias("rows")))

        return self.run(data, watch), seen

    def run_chunked(self, data: Dataset | DataFrame, chunk_size: int) -> Dataset:
        """The result. Spark cuts the work into tasks itself, so chunk_size only has to be positive: operators that look at
        the whole table (duplicates, samples, statistics) see all of it, however it is cut."""
        if chunk_size < 1:
            raise ConfigError("chunk_size must be positive")
        return self.run(data)

    def with_progress(self, data: Dataset | DataFrame, report: Callable[[int, int, str], None]) -> Dataset:
        """The result; report is told each step as it is planned."""
        ds = data if isinstance(data, Dataset) else Dataset.of(data)
        for i, n in enumerate(self.nodes):
            ds = _run((n,), ds, None)
            report(i + 1, len(self.nodes), n.name or n.kind)
        return ds

    def cached(self, data: Dataset | DataFrame, source: str) -> Dataset:
        """The result as a table in the shared folder under the digests of the steps and of source, which names the input's
        version; it is made only once. A run that was cut off leaves no _SUCCESS and is made again."""
        ds = data if isinstance(data, Dataset) else Dataset.of(data)
        out, spark = self.run(ds), ds.df.sparkSession
        path = f"{shared_folder(spark)}/result-{self.digest[:16]}-{hashlib.sha256(source.encode()).hexdigest()[:16]}"
        jvm = spark._jvm
        marker = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if not marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker):
            out.df.write.mode("overwrite").parquet(path)
        return out.on(spark.read.schema(out.df.schema).parquet(path))

    def timed(self, data: Dataset | DataFrame) -> tuple[Dataset, dict[str, Any]]:
        """The result, written down, and {rows, seconds, rows_per_second}."""
        from .functions.storage import written

        start = time.perf_counter()
        out = self.run(data)
        out = out.on(written(out.df, "run"))
        rows, seconds = out.df.count(), time.perf_counter() - start
        return out, {"rows": rows, "seconds": seconds, "rows_per_second": rows / max(seconds, 1e-9)}


def _run(some: tuple[Node, ...], ds: Dataset, watch: Callable[[str, Dataset, Dataset], Dataset] | None) -> Dataset:
    for n in some:
        if n.kind == "operator":
            try:
                out = get(n.name)(ds, n.config)
            except MillError:
                raise
            except Exception as e:
                raise OperatorError(f"{n.name}: {e}") from e
            ds = watch(n.name, ds, out) if watch else out
        elif n.kind == "sequence":
            ds = _run(n.parts[0], ds, watch)
        elif n.kind == "choice":
            passes = _run(n.parts[0], ds, None).df.limit(1).count() > 0
            ds = _run(n.parts[1] if passes else n.parts[2], ds, watch)
        else:
            branches = [_run(p, ds, watch) for p in n.parts]
            ds = get("merge.concat")(branches[0], {"inputs": branches[1:]}) if len(branches) > 1 else branches[0]
    return ds


class PipelineBuilder:
    """Pipelines from configuration, with operators of one's own."""

    def __init__(self) -> None:
        self._steps: list[Step] = []

    @staticmethod
    def with_defaults() -> PipelineBuilder:
        return PipelineBuilder()

    def register(self, name: str, run: Callable[[Dataset, Mapping[str, Any]], Dataset], row_wise: bool = False) -> PipelineBuilder:
        from .registry import operator

        operator(name, row_wise=row_wise)(run)
        return self

    def step(self, name: str, config: Mapping[str, Any] | None = None) -> PipelineBuilder:
        self._steps.append(step(name, config))
        return self

    def build(self) -> Pipeline:
        return Pipeline(self._steps)

    def build_from_config(self, steps: str | Sequence[Step]) -> Pipeline:
        return Pipeline(steps)
