"""Writers. Spark's commit moves finished files into place, so a folder with _SUCCESS is whole."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..dataset import Dataset, kind
from ..errors import ConfigError

CODECS = {"none": "none", "gzip": "gzip", "gz": "gzip", "zstd": "zstd", "zst": "zstd", "bz2": "bzip2", "bzip2": "bzip2"}


@dataclass(frozen=True)
class Written:
    path: str
    rows: int
    bytes: int
    files: list[str]


def listed(df_or_spark, path: str) -> list[tuple[str, int]]:
    """The data files at path and their sizes, by the file system that Spark uses."""
    spark = getattr(df_or_spark, "sparkSession", df_or_spark)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    out = [(s.getPath().toString(), s.getLen()) for s in found if s.isFile() and not s.getPath().getName().startswith(("_", "."))]
    return sorted(out)


def flat(df: DataFrame) -> DataFrame:
    """Columns that CSV can't hold as JSON text."""
    return df.select(*(F.to_json(F.col(f"`{f.name}`")).alias(f.name) if kind(f.dataType) in ("array", "object") else F.col(f"`{f.name}`") for f in df.schema))


def write(data: Dataset | DataFrame, path: str, format: str = "parquet", compression: str = "none", rows_per_file: int | None = None, bytes_per_file: int | None = None, mode: str = "errorifexists") -> Written:
    """The table as files in a folder: jsonl, json (each file an array in one line a record), csv with a header, or parquet.

    rows_per_file bounds every file; bytes_per_file sets the number of files by the bytes of a row's JSON text.
    """
    df = data.df if isinstance(data, Dataset) else data
    if compression not in CODECS:
        raise ConfigError(f"unknown compression {compression!r}")
    if bytes_per_file:
        size = df.select(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*"))) + 1), F.lit(0)).alias("n")).first()["n"]
        df = df.repartition(max(1, math.ceil(size / bytes_per_file)))
    seen = Observation()
    df = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    writer = df.write.mode(mode)
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    codec = CODECS[compression]
    if format == "parquet":
        if codec == "bzip2":
            raise ConfigError("parquet has no bzip2")
        writer.option("compression", "uncompressed" if codec == "none" else codec).parquet(path)
    elif format == "csv":
        flat(df).write.mode(mode).options(**({"maxRecordsPerFile": rows_per_file} if rows_per_file else {})).option("header", True).option("escape", '"').option("compression", codec).csv(path)
    elif format in ("json", "jsonl"):
        if format == "json":
            rows = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
            rows.mapInArrow(_bracketed, "value string").write.mode(mode).option("compression", codec).text(path)
        else:
            writer.option("compression", codec).option("ignoreNullFields", False).json(path)
    else:
        raise ConfigError(f"unknown format {format!r}")
    files = listed(df, path)
    return Written(path, int(seen.get["rows"]), sum(n for _, n in files), [f for f, _ in files])


def _bracketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a partition as the lines of a JSON array."""
    held = "["
    first = True
    for batch in batches:
        lines = []
        for text in batch.column(0).to_pylist():
            if not first:
                lines.append(held + ",")
            held = "[" + text if first else text
            first = False
        yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
    yield pa.RecordBatch.from_arrays([pa.array([held + "]"])], names=["value"])


def write_envelope(ds: Dataset, path: str, format: str = "jsonl", compression: str = "none", mode: str = "errorifexists") -> Written:
    """Records {id, payload, metadata}; csv and parquet hold payload and metadata as JSON text."""
    df = ds.to_envelope()
    if format != "jsonl":
        df = df.select("id", F.to_json("payload").alias("payload"), F.to_json("metadata").alias("metadata"))
    return write(df, path, format, compression, mode=mode)
