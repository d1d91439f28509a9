"""Versions of datasets: hashes of data, code and environment, with what was measured, in a chain of parents."""

from __future__ import annotations

import hashlib
import json
import platform
import time
from dataclasses import asdict, dataclass, field
from pathlib import Path
from typing import Any

import pyspark
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pipeline import Pipeline


def dataset_hash(df: DataFrame) -> str:
    """A hash of the rows, whatever their order and partitioning: sums of parts of each row's SHA-256, repeated rows counted."""
    digest = F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(df.columns)))), 256)
    parts = [F.sum(F.conv(F.substring(F.col("d"), 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")).alias(f"p{i}") for i in range(8)]
    row = df.select(digest.alias("d")).agg(F.count("*").alias("n"), *parts).first()
    return hashlib.sha256(json.dumps([str(x or 0) for x in row]).encode()).hexdigest()


def environment_hash() -> str:
    return hashlib.sha256(f"{platform.python_version()} {pyspark.__version__}".encode()).hexdigest()


@dataclass(frozen=True)
class Version:
    id: str
    parent: str | None
    created_at: float
    metadata: dict[str, Any]
    metrics: dict[str, float]
    data: str
    code: str
    environment: str


@dataclass
class VersionStore:
    """Versions by id; saved as JSON beside the data."""

    versions: dict[str, Version] = field(default_factory=dict)

    def create(self, df: DataFrame, pipeline: Pipeline | None = None, parent: str | None = None, metadata: dict[str, Any] | None = None, metrics: dict[str, float] | None = None) -> Version:
        if parent is not None and parent not in self.versions:
            raise KeyError(f"no version {parent}")
        data, code, env = dataset_hash(df), pipeline.digest if pipeline else hashlib.sha256(b"").hexdigest(), environment_hash()
        name = "v" + hashlib.sha256(f"{parent}{data}{code}{env}{len(self.versions)}".encode()).hexdigest()[:16]
        out = Version(name, parent, time.time(), metadata or {}, metrics or {}, data, code, env)
        self.versions[name] = out
        return out

    def history(self, name: str) -> list[Version]:
        """The version and its ancestors."""
        out = [self.versions[name]]
        while out[-1].parent:
            out.append(self.versions[out[-1].parent])
        return out

    def compare(self, a: str, b: str) -> dict[str, Any]:
        """What differs between two versions, and by how much their metrics do."""
        x, y = self.versions[a], self.versions[b]
        return {"data": x.data != y.data, "code": x.code != y.code, "environment": x.environment != y.environment, "metrics": {k: y.metrics[k] - x.metrics[k] for k in sorted(x.metrics.keys() & y.metrics.keys())}}

    def save(self, path: str | Path) -> None:
        Path(path).write_text(json.dumps([asdict(v) for v in self.versions.values()], indent=2))

    @staticmethod
    def load(path: str | Path) -> VersionStore:
        return VersionStore({v["id"]: Version(**v) for v in json.loads(Path(path).read_text())})
