"""Manifests: what files a dataset has, where it came from, and hashes to check it by."""

from __future__ import annotations

import hashlib
import json
import time
from dataclasses import asdict, dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def file_hash(path: str | Path) -> str:
    """SHA-256 of a local file."""
    h = hashlib.sha256()
    with open(str(path).removeprefix("file:"), "rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    return h.hexdigest()


def file_hashes(spark: SparkSession, path: str) -> dict[str, str]:
    """SHA-256 of every file in a folder, computed where the files are read."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "[!._]*").load(path).select("path", F.sha2("content", 256).alias("hash"))
    return {r["path"]: r["hash"] for r in rows.collect()}


@dataclass
class File:
    path: str
    format: str
    records: int
    bytes: int
    hash: str


@dataclass
class Lineage:
    sources: list[dict[str, Any]] = field(default_factory=list)
    transforms: list[dict[str, Any]] = field(default_factory=list)
    pipeline_hash: str | None = None


@dataclass
class Manifest:
    name: str
    version: str = "1"
    created_at: float = field(default_factory=time.time)
    files: list[File] = field(default_factory=list)
    lineage: Lineage = field(default_factory=Lineage)
    metadata: dict[str, Any] = field(default_factory=dict)
    checksum: str = ""

    def add_file(self, path: str, format: str, records: int, size: int, hash: str) -> Manifest:
        self.files.append(File(path, format, records, size, hash))
        return self

    def add_folder(self, spark: SparkSession, path: str, format: str) -> Manifest:
        """All files of a folder, their records counted by Spark."""
        from .readers import read
        from .writers import listed

        hashes = file_hashes(spark, path)
        rows = read(spark, path, format).df.groupBy(F.input_file_name().alias("f")).count().collect()
        count = {Path(r["f"]).name: r["count"] for r in rows}
        for name, size in listed(spark, path):
            self.add_file(name, format, count.get(Path(name).name, 0), size, next(h for p, h in hashes.items() if Path(p).name == Path(name).name))
        return self

    def add_source(self, name: str, **details: Any) -> Manifest:
        self.lineage.sources.append({"name": name, **details})
        return self

    def add_transform(self, operator: str, config: dict[str, Any]) -> Manifest:
        self.lineage.transforms.append({"operator": operator, "config": config})
        return self

    @property
    def stats(self) -> dict[str, Any]:
        formats: dict[str, int] = {}
        for f in self.files:
            formats[f.format] = formats.get(f.format, 0) + 1
        return {"files": len(self.files), "records": sum(f.records for f in self.files), "bytes": sum(f.bytes for f in self.files), "formats": formats}

    def _digest(self) -> str:
        return hashlib.sha256("".join(sorted(f"{f.path}:{f.hash}\n" for f in self.files)).encode()).hexdigest()

    def seal(self) -> Manifest:
        self.checksum = self._digest()
        return self

    def verify(self, spark: SparkSession | None = None) -> list[str]:
        """What is wrong: a checksum that doesn't fit, files that are missing or changed."""
        wrong = [] if self.checksum == self._digest() else ["checksum"]
        for f in self.files:
            local = Path(f.path.removeprefix("file:"))
            if local.exists():
                found = file_hash(local)
            elif spark is not None:
                found = next(iter(file_hashes(spark, f.path).values()), None)
            else:
                found = None
            if found is None:
                wrong.append(f"missing: {f.path}")
            elif found != f.hash:
                wrong.append(f"changed: {f.path}")
        return wrong

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2, sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Manifest:
        raw = json.loads(text)
        return Manifest(**{**raw, "files": [File(**f) for f in raw["files"]], "lineage": Lineage(**raw["lineage"])})
