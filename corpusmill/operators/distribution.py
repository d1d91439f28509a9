"""Distributions of fields: counts of values, histograms, percentiles, correlation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..dataset import Dataset, Field
from ..functions.ranks import numbered
from ..registry import Config, operator, option, some
from .tokens import attached

PERCENTILES = (5, 10, 25, 50, 75, 90, 95, 99)


def _field(ds: Dataset, path: str) -> Field | None:
    return ds.find(path if path.split(".")[0] in ("payload", "metadata") else f"payload.{path}")


def _shown(f: Field) -> Column:
    return F.to_json(f.column) if f.kind in ("array", "object") else f.column.cast("string")


def summary(ds: Dataset, fields: list[str]) -> DataFrame:
    """(field, total_count, null_count, unique_count), one row for each field, in one pass over the table.

    Distinct values are counted exactly: every (field, value) is a row of a partial aggregate.
    """
    found = [(p, _field(ds, p)) for p in fields]
    values = [F.struct(F.lit(p).alias("field"), (_shown(f) if f else F.lit(None).cast("string")).alias("v")) for p, f in found]
    each = ds.df.select(F.explode(F.array(*values)).alias("x")).select("x.field", "x.v").groupBy("field", "v").agg(F.count("*").alias("n"))
    out = each.groupBy("field").agg(F.sum("n").alias("total_count"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("null_count"), F.count("v").alias("unique_count"))
    return out


def top_values(ds: Dataset, path: str, k: int = 10) -> DataFrame:
    """(value, n): the commonest values, ties in order of the value."""
    f = _field(ds, path)
    rows = ds.df.select((_shown(f) if f else F.lit(None).cast("string")).alias("value")).filter("value is not null")
    return rows.groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(k)


def _numbers(ds: Dataset, path: str) -> DataFrame:
    f = _field(ds, path)
    numeric = f is not None and f.kind in ("int", "float")
    return ds.df.select((f.column.cast("double") if numeric else F.lit(None).cast("double")).alias("v")).filter("v is not null")


def value_histogram(ds: Dataset, path: str, bins: int = 10) -> DataFrame:
    """(bin, start, end, n, percentage): bins of equal width between the least and the largest number, empty ones too; one bin if these are equal."""
    rows = _numbers(ds, path)
    ends = rows.agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("total")).filter("total > 0")
    width = (F.col("high") - F.col("low")) / bins
    counts = rows.crossJoin(F.broadcast(ends)).select(F.when(F.col("high") == F.col("low"), 0).otherwise(F.least(F.floor((F.col("v") - F.col("low")) / width), F.lit(bins - 1))).cast("int").alias("b"))
    counts = counts.groupBy("b").agg(F.count("*").alias("n"))
    last = F.when(F.col("high") == F.col("low"), 0).otherwise(bins - 1)
    frame = ends.select("low", "high", "total", F.explode(F.sequence(F.lit(0), last)).alias("bin"))
    out = frame.join(counts, F.col("bin") == F.col("b"), "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
    end = F.when(F.col("high") == F.col("low"), F.col("high")).otherwise(F.col("low") + (F.col("bin") + 1) * width)
    return out.select("bin", (F.col("low") + F.col("bin") * width).alias("start"), end.alias("end"), "n", (F.col("n") / F.col("total") * 100).alias("percentage"))


def percentiles(ds: Dataset, path: str, points: tuple[int, ...] = PERCENTILES) -> DataFrame:
    """(p, value): the number in place floor(n p / 100) of all in order, whatever their number."""
    counts = _numbers(ds, path).groupBy("v").agg(F.count("*").alias("n"))
    placed = numbered(counts, [F.col("v")], "at", "many")
    # distinct values are numbered by range; running sums within stretches of them give every value its places
    stretch = F.floor(F.col("at") / 65536)
    placed = placed.withColumn("s", stretch)
    sums = placed.groupBy("s").agg(F.sum("n").alias("sn"))
    every = W.partitionBy(F.lit(0))
    sums = sums.select(F.col("s").alias("s2"), F.coalesce(F.sum("sn").over(every.orderBy("s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("sn").over(every).alias("total"))
    placed = placed.join(sums, F.col("s") == F.col("s2")).withColumn("end", F.col("before") + F.sum("n").over(W.partitionBy("s").orderBy("at")))
    wanted = F.explode(F.array(*(F.struct(F.lit(p).alias("p"), F.least(F.floor(F.col("total") * (p / 100)), F.col("total") - 1).alias("place")) for p in points)))
    out = placed.select("v", "n", "end", wanted.alias("w")).filter((F.col("w.place") < F.col("end")) & (F.col("w.place") >= F.col("end") - F.col("n")))
    return out.select(F.col("w.p").alias("p"), F.col("v").alias("value"))


def analysis(ds: Dataset, path: str, k: int = 10, bins: int = 10) -> DataFrame:
    """One row with a struct of all of these."""
    def rows(df: DataFrame, *order: str) -> DataFrame:
        return df.agg(F.sort_array(F.collect_list(F.struct(*(F.col(c) for c in order)))).alias("x"))

    parts = {
        "top_values": rows(top_values(ds, path, k).withColumn("rank", -F.col("n")), "rank", "value", "n"),
        "histogram": rows(value_histogram(ds, path, bins), "bin", "start", "end", "n", "percentage"),
        "percentiles": rows(percentiles(ds, path), "p", "value"),
    }
    out = summary(ds, [path])
    for name, part in parts.items():
        out = out.crossJoin(F.broadcast(part.withColumnRenamed("x", name)))
    return out.select(F.struct(*out.columns).alias("v"))


@operator("distribution.analyze")
def analyze(ds: Dataset, config: Config) -> Dataset:
    """The distribution of a field, as metadata distribution of the first row."""
    path = option(config, "field", kinds=str)
    return attached(ds, "distribution", analysis(ds, path, option(config, "top_k", 10, int, 1), option(config, "histogram_bins", 10, int, 1)))


@operator("distribution.report")
def report(ds: Dataset, config: Config) -> Dataset:
    """The distributions of several fields, as metadata distribution_report of the first row."""
    parts = [analysis(ds, p) for p in some(config, "fields", str)]
    every = reduce(DataFrame.union, parts)
    return attached(ds, "distribution_report", every.agg(F.sort_array(F.collect_list("v")).alias("v")))


def correlation_of(ds: Dataset, x: str, y: str) -> DataFrame:
    """(field_x, field_y, n, correlation): Pearson's, of rows that have both numbers; null for fewer than two or without variance."""
    a, b = _field(ds, x), _field(ds, y)
    fits = all(f is not None and f.kind in ("int", "float") for f in (a, b))
    u, v = (f.column.cast("double") if fits else F.lit(None).cast("double") for f in (a, b))
    rows = ds.df.select(u.alias("u"), v.alias("v")).filter("u is not null and v is not null")
    r = F.corr("u", "v")
    return rows.agg(F.count("*").alias("n"), F.when(F.count("*") > 1, F.when(F.isnan(r), None).otherwise(r)).alias("correlation")).select(F.lit(x).alias("field_x"), F.lit(y).alias("field_y"), "n", "correlation")


@operator("distribution.correlation")
def correlation(ds: Dataset, config: Config) -> Dataset:
    """The correlation of two fields, as metadata correlation of the first row."""
    x, y = option(config, "field_x", kinds=str), option(config, "field_y", kinds=str)
    one = correlation_of(ds, x, y)
    return attached(ds, "correlation", one.select(F.struct(*one.columns).alias("v")))
