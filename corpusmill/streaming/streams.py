"""Structured Streaming: row-wise pipelines run on a stream as they are; others on each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..dataset import Dataset
from ..pipeline import Pipeline


def apply(stream: DataFrame, pipeline: Pipeline, id: str | None = None) -> Dataset:
    """The pipeline on a stream; an operator that needs the whole table is an error."""
    return pipeline.run(Dataset.of(stream, id=id))


def by_batch(stream: DataFrame, pipeline: Pipeline, sink: Callable[[DataFrame, int], None], id: str | None = None) -> DataStreamWriter:
    """Any pipeline, on each micro-batch apart; sink gets the result and the batch's number, and may be called again with the same."""

    def run(batch: DataFrame, number: int) -> None:
        sink(pipeline.run(Dataset.of(batch, id=id)).df, number)

    return stream.writeStream.foreachBatch(run)


def window_counts(stream: DataFrame, time: str, key: str, width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(start, end, key, n) by tumbling (or sliding) windows; rows later than late are dropped, and windows' state with them."""
    at = F.window(F.col(time), width, slide) if slide else F.window(F.col(time), width)
    marked = stream.withWatermark(time, late) if stream.isStreaming else stream
    return marked.groupBy(at.alias("w"), F.col(key)).agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", key, "n")


def first_seen(stream: DataFrame, keys: list[str], time: str, within: str = "1 hour") -> DataFrame:
    """Rows whose keys no row had within the time before, in bounded state."""
    if not stream.isStreaming:
        return stream.dropDuplicates(keys)
    return stream.withWatermark(time, within).dropDuplicatesWithinWatermark(keys)
