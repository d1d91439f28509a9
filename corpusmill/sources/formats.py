"""File formats and compressions, by name and by content."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigError

FORMATS = {"jsonl": "jsonl", "ndjson": "jsonl", "json": "json", "csv": "csv", "tsv": "csv", "parquet": "parquet", "pq": "parquet", "parq": "parquet"}
COMPRESSIONS = {"gz": "gzip", "gzip": "gzip", "zst": "zstd", "bz2": "bzip2", "xz": "xz"}
_MAGIC = {b"\x1f\x8b": "gzip", b"\x28\xb5\x2f\xfd": "zstd", b"BZh": "bzip2", b"\xfd7zXZ\x00": "xz"}


@dataclass(frozen=True)
class Format:
    name: str
    compression: str | None = None


def by_name(path: str) -> Format | None:
    """By the extensions of a file's name."""
    parts = path.rstrip("/").rsplit("/", 1)[-1].lower().split(".")[1:]
    compression = COMPRESSIONS.get(parts[-1]) if parts else None
    if compression:
        parts = parts[:-1]
    name = FORMATS.get(parts[-1]) if parts else None
    return Format(name, compression) if name else None


def by_content(head: bytes) -> Format:
    """By the first bytes of a file."""
    for magic, compression in _MAGIC.items():
        if head.startswith(magic):
            return Format("jsonl", compression)
    if head.startswith(b"PAR1"):
        return Format("parquet")
    text = head.decode("utf-8", "replace").lstrip("﻿").lstrip()
    lines = [x for x in text.split("\n") if x.strip()]
    if text.startswith("{") and lines and (len(lines) == 1 or all(x.lstrip().startswith("{") for x in lines[:2])):
        return Format("jsonl")
    if text.startswith(("{", "[")):
        return Format("json")
    if lines and lines[0].count(",") >= 2:
        return Format("csv")
    raise ConfigError("the format can't be told from the content")


def detect(spark: SparkSession, path: str) -> Format:
    """By name, else by the first file's beginning, of which a few kilobytes are read."""
    found = by_name(path)
    if found:
        return found
    rows = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, 8192).alias("head")).limit(1).collect()
    if not rows:
        raise ConfigError(f"no file at {path}")
    return by_content(bytes(rows[0]["head"]))
