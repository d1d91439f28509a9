"""Tables that jobs write for themselves in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only on a single machine where it is unset."""
    sc = spark.sparkContext
    at = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="corpusmill-")
        sc.setCheckpointDir(at)
    return at


def spread(df: DataFrame) -> DataFrame:
    """df on all cores where its files give fewer tasks than there are cores; larger tables stay as they are read.

    For work that costs much more than moving the rows. Only the order in which rows are worked on changes.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size > 1 << 20 and df.rdd.getNumPartitions() < cores else df


def written(df: DataFrame, name: str) -> DataFrame:
    """df written there and read again: later jobs start from it, even if executors are lost."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
