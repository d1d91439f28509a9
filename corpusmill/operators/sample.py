"""Samples of exact sizes. Randomness is the md5 of seed and id, so a sample doesn't depend on how rows are spread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..dataset import Dataset, kind, quoted
from ..errors import ConfigError
from ..functions.ranks import CELLS, hash_key, ranked, uniform, unused
from ..functions.text import n_chars
from ..registry import NUMBER, Config, operator, option


def label(ds: Dataset, path: str, missing: str = "unknown") -> Column:
    """A field as a class label; a path without a head is payload's."""
    found = ds.find(path if path.split(".")[0] in ("payload", "metadata") else f"payload.{path}")
    if found is None or found.kind in ("array", "object"):
        return F.lit(missing)
    return F.coalesce(found.column.cast("string"), F.lit(missing))


def tie(ds: Dataset) -> list[Column]:
    return [quoted(ds.id or ds.arrival)]


def _metadata(ds: Dataset, key: str) -> Column | None:
    """A metadata value, by its key or path."""
    return ds.meta_column(key.removeprefix("metadata."))


@operator("sample.random")
def random(ds: Dataset, config: Config) -> Dataset:
    """count rows, or the share ratio of them (the larger of both), uniformly or by weight without replacement.

    weight_key names metadata; what isn't a positive number weighs 1. group_key: each group's first min_per_group rows
    are taken before the others (groups in order of their labels, as far as the sample goes).
    """
    ratio, count = option(config, "ratio", None, NUMBER), option(config, "count", None, int, 0)
    seed, weight_key = option(config, "seed", 0, int), option(config, "weight_key", None, str)
    group_key, least = option(config, "group_key", None, str), option(config, "min_per_group", None, int, 0)
    if ratio is None and count is None:
        raise ConfigError("needs ratio or count")
    if ratio is not None and not 0 <= ratio <= 1:
        raise ConfigError("ratio must lie between 0 and 1")
    if least is not None and group_key is None:
        raise ConfigError("min_per_group needs group_key")
    key, digits = hash_key(seed, ds.key()), CELLS
    weight = _metadata(ds, weight_key) if weight_key else None
    if weight is not None and kind(ds.df.schema[ds.meta[weight_key.removeprefix("metadata.")]].dataType) in ("int", "float"):
        w = F.when(weight > 0, weight.cast("double")).otherwise(1.0)
        # the logarithm of the exponential key: five digits are 4096 cells for each factor of e, whatever the weights
        key, digits = F.lpad(F.hex(F.floor((F.log(-F.log(uniform(key)) / w) + 128) * float(1 << 48)).cast("bigint")), 14, "0"), 5
    rank, total, inner, goal = unused(ds.df, "rank", "n", "inner", "goal")
    n = F.col(total)
    goals = ([F.lit(count)] if count is not None else []) + ([F.lit(0) if ratio == 0 else F.round(F.greatest(n * F.lit(float(ratio)), F.lit(1.0)))] if ratio is not None else [])
    target = F.least(F.greatest(*goals) if len(goals) > 1 else goals[0], n)
    df = ranked(ds.df, key, tie(ds), rank=rank, total=total, cells=digits)
    if not least:
        return ds.on(df.filter(F.col(rank) < target).drop(rank, total))
    found = _metadata(ds, group_key)
    group = F.coalesce(found.cast("string"), F.lit("__missing__")) if found is not None else F.lit("__missing__")
    df = df.withColumn(goal, target).drop(rank, total)
    g, size, before, h = unused(df, "group", "size", "before", "h")
    df = ranked(df, key, tie(ds), [group], rank=inner, cells=digits).withColumn(g, group)
    sizes = df.groupBy(g).agg(F.least(F.count("*"), F.lit(least)).alias(size))
    sizes = sizes.select(F.col(g).alias(h), F.coalesce(F.sum(size).over(W.partitionBy(F.lit(0)).orderBy(g).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(before), F.sum(size).over(W.partitionBy(F.lit(0))).alias(size))
    df = df.join(sizes, F.col(g) == F.col(h))
    sure = (F.col(inner) < least) & (F.col(before) + F.col(inner) < F.col(goal))
    out = ranked(df, key, tie(ds), [F.col(inner) < least], rank=rank, cells=digits)
    return ds.on(out.filter(sure | (F.col(inner) >= least) & (F.col(rank) < F.col(goal) - F.col(size))).select(*map(quoted, ds.df.columns)))


@operator("sample.top")
def top(ds: Dataset, config: Config) -> Dataset:
    """The rows with the largest metadata numbers, earlier ones first among equals; those without one come last."""
    key = option(config, "key", option(config, "path", "quality", str), str)
    n = option(config, "count", option(config, "n", None, int, 0), int, 0)
    if n is None:
        raise ConfigError("needs count")
    c = _metadata(ds, key)
    best = [c.desc_nulls_last()] if c is not None else []
    return ds.on(ds.df.orderBy(*best, quoted(ds.arrival)).limit(n))


@operator("sample.balanced")
def balanced(ds: Dataset, config: Config) -> Dataset:
    """As many rows of each class: undersample, oversample (with replacement, after all rows) or hybrid."""
    path, seed = option(config, "label_field", kinds=str), option(config, "seed", 0, int)
    high, low = option(config, "max_per_class", None, int, 0), option(config, "min_per_class", None, int, 0)
    strategy = option(config, "strategy", "hybrid", str).lower()
    least, most = F.col("_least"), F.col("_most")
    targets = {
        "undersample": least if high is None else F.least(F.lit(high), least),
        "oversample": most if low is None else F.greatest(F.lit(low), most),
        "hybrid": F.least(F.floor((least + most) / 2), F.lit(high)) if high is not None else F.greatest(F.floor((least + most) / 2), F.lit(low or 0)),
    }
    if strategy not in targets:
        raise ConfigError("strategy must be undersample, oversample or hybrid")
    rank, size, cls = unused(ds.df, "rank", "size", "class")
    df = ranked(ds.df.withColumn(cls, label(ds, path)), hash_key(seed, ds.key()), tie(ds), [F.col(cls)], rank=rank, total=size)
    sizes = ds.df.groupBy(label(ds, path).alias("_c")).agg(F.count("*").alias("_size"))
    goal = sizes.agg(F.min("_size").alias("_least"), F.max("_size").alias("_most")).select(targets[strategy].cast("bigint").alias("_goal"))
    out = df.crossJoin(F.broadcast(goal)).filter(F.col(rank) < F.col("_goal"))
    if strategy != "undersample":
        short = sizes.crossJoin(F.broadcast(goal)).filter("_size < _goal")
        draws = short.select("_c", "_size", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_goal") - F.col("_size"))).alias("_draw"))
        pick = F.floor(uniform(hash_key(f"{seed}:draw", F.concat_ws(":", "_c", F.col("_draw").cast("string")))) * F.col("_size")).cast("bigint")
        picked = draws.groupBy("_c", pick.alias("_pick")).agg(F.count("*").alias("_more"))
        out = out.join(picked, (F.col(cls) == F.col("_c")) & (F.col(rank) == F.col("_pick")), "left")
        out = out.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("_more", F.lit(0)))))
    return ds.on(out.select(*map(quoted, ds.df.columns)))


def _cut(ds: Dataset, df: DataFrame, seed: int, count: int) -> DataFrame:
    """At most count rows, others than those with the least keys."""
    (rank,) = unused(df, "cut")
    return ranked(df, hash_key(f"{seed}:cut", ds.key()), tie(ds), rank=rank).filter(F.col(rank) < count).drop(rank)


@operator("sample.by_distribution")
def by_distribution(ds: Dataset, config: Config) -> Dataset:
    """Of each label its share of total_count, or all if there are fewer; equal shares if all weights are 0."""
    path, seed = option(config, "field", kinds=str), option(config, "seed", 0, int)
    weights, count = option(config, "target_distribution", kinds=dict), option(config, "total_count", kinds=int, least=0)
    whole = sum(weights.values())
    rank, cls = unused(ds.df, "rank", "class")
    df = ranked(ds.df.withColumn(cls, label(ds, path)), hash_key(seed, ds.key()), tie(ds), [F.col(cls)], rank=rank)
    if whole > 0:
        quota = F.lit(0)
        for value, w in weights.items():
            quota = F.when(F.col(cls) == value, int(w / whole * count + 0.5)).otherwise(quota)
        df = df.filter(F.col(rank) < quota)
    else:
        n = ds.df.agg(F.count_distinct(label(ds, path)).alias("_classes"))
        df = df.crossJoin(F.broadcast(n)).filter(F.col(rank) < F.round(F.lit(float(count)) / F.col("_classes"))).drop("_classes")
    return ds.on(_cut(ds, df.drop(rank, cls), seed, count))


@operator("sample.by_length")
def by_length(ds: Dataset, config: Config) -> Dataset:
    """Rows whose text has so many characters, at random at most target_count of them."""
    text = ds.text(option(config, "text_field", kinds=str))
    low, high = option(config, "min_length", 0, int, 0), option(config, "max_length", None, int, 0)
    count, seed = option(config, "target_count", None, int, 0), option(config, "seed", 0, int)
    n = n_chars(F.coalesce(text, F.lit("")) if text is not None else F.lit(""))
    kept = ds.where((n >= low) & (n <= high) if high is not None else n >= low)
    if count is None:
        return kept
    (rank,) = unused(ds.df, "rank")
    return ds.on(ranked(kept.df, hash_key(seed, ds.key()), tie(ds), rank=rank).filter(F.col(rank) < count).drop(rank))


@operator("sample.stratified")
def stratified(ds: Dataset, config: Config) -> Dataset:
    """count rows, of each stratum its share of all rows, rounded; never more than count."""
    path, count, seed = option(config, "field", kinds=str), option(config, "count", kinds=int, least=0), option(config, "seed", 0, int)
    rank, size, n = unused(ds.df, "rank", "size", "n")
    df = ranked(ds.df, hash_key(seed, ds.key()), tie(ds), [label(ds, path)], rank=rank, total=size)
    df = df.crossJoin(F.broadcast(ds.df.agg(F.count("*").alias(n))))
    df = df.filter(F.col(rank) < F.round(F.col(size) * (F.lit(float(count)) / F.col(n)))).drop(rank, size, n)
    return ds.on(_cut(ds, df, seed, count))
