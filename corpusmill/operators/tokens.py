"""Token counts and statistics of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..dataset import Dataset, quoted
from ..functions.tokenizers import counted
from ..registry import Config, operator, option


def _count(ds: Dataset, config: Config) -> Column:
    text = ds.joined_text(option(config, "text_field", "payload.text", str))
    return counted(text, option(config, "tokenizer_type", "Whitespace", str), option(config, "vocabulary", None, str))


@operator("token.count", row_wise=True)
def count(ds: Dataset, config: Config) -> Dataset:
    """The number of tokens of a text, of the strings of an array or of an object; 0 for anything else."""
    return ds.put(option(config, "output_field", "metadata.token_count", str), _count(ds, config))


@operator("token.filter", row_wise=True)
def token_filter(ds: Dataset, config: Config) -> Dataset:
    low, high = option(config, "min_tokens", 0, int, 0), option(config, "max_tokens", None, int, 0)
    n = _count(ds, config)
    return ds.where((n >= low) & (n <= high) if high is not None else n >= low)


def attached(ds: Dataset, key: str, one: DataFrame) -> Dataset:
    """The single value of one as metadata of the first row."""
    (value,) = one.columns
    first = ds.df.agg(F.min(quoted(ds.arrival)).alias("_first"))
    out = ds.on(ds.df.crossJoin(F.broadcast(one.withColumnRenamed(value, "_value"))).crossJoin(F.broadcast(first)))
    out = out.put_meta(key, F.when(quoted(ds.arrival) == F.col("_first"), F.col("_value")))
    return out.on(out.df.drop("_value", "_first"))


def token_stats(ds: Dataset, config: Config) -> DataFrame:
    """One row of statistics; none for an empty table. A percentile p is the value in place floor(n p) of all in order.

    Rows are summed by their count first, so what is sorted has as many rows as there are lengths.
    """
    sizes = ds.df.select(_count(ds, config).alias("v")).groupBy("v").agg(F.count("*").alias("n"))
    every = W.partitionBy(F.lit(0))
    sizes = sizes.withColumn("end", F.sum("n").over(every.orderBy("v"))).withColumn("total", F.sum("n").over(every))

    def place(p: float) -> Column:
        at = F.floor(F.col("total") * p) if p != 0.5 else F.floor(F.col("total") / 2)
        return F.min(F.when(F.col("end") > at, F.col("v"))).cast("bigint")

    out = sizes.agg(
        F.sum(F.col("v") * F.col("n")).cast("bigint").alias("total_tokens"), F.min("v").cast("bigint").alias("min_tokens"), F.max("v").cast("bigint").alias("max_tokens"),
        (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("avg_tokens"), place(0.5).cast("double").alias("median_tokens"), *(place(p / 100).alias(f"p{p}_tokens") for p in (25, 75, 95, 99)), F.sum("n").alias("record_count"))
    return out.filter("record_count > 0")


@operator("token.stats")
def stats(ds: Dataset, config: Config) -> Dataset:
    """Each row's token_count as metadata, and token_stats of all on the first row."""
    one = token_stats(ds, config)
    one = one.select(F.struct(*one.columns).alias("v"))
    return attached(ds.put_meta("token_count", _count(ds, config)), "token_stats", one)


def token_histogram(ds: Dataset, config: Config) -> DataFrame:
    """(bucket, n): rows by ranges of token counts, named low-high."""
    size = option(config, "bucket_size", 100, int, 1)
    b = F.floor(_count(ds, config) / size).cast("bigint")
    rows = ds.df.select(b.alias("b")).groupBy("b").agg(F.count("*").alias("n"))
    name = F.concat_ws("-", (F.col("b") * size).cast("string"), ((F.col("b") + 1) * size - 1).cast("string"))
    return rows.select(name.alias("bucket"), "n")


@operator("token.histogram")
def histogram(ds: Dataset, config: Config) -> Dataset:
    """The histogram as a map, token_histogram of the first row."""
    one = token_histogram(ds, config).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("bucket", "n")))).alias("v"))
    return attached(ds, "token_histogram", one)
