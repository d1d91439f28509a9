"""Shuffles: a new order of arrival from hashes of seed and id.

Rows aren't moved: they get a position, and that becomes the order which later operators and ordered() follow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dataset import Dataset, quoted
from ..errors import ConfigError
from ..functions.ranks import hash_key, numbered, ranked, uniform, unused
from ..registry import Config, operator, option
from .sample import label, tie


def ordered(ds: Dataset) -> DataFrame:
    """The rows sorted by their order, without the columns that only carry it."""
    return ds.df.orderBy(quoted(ds.arrival)).drop(*(c for c in ds.system if c == ds.order))


def _placed(ds: Dataset, df: DataFrame, name: str) -> Dataset:
    old = [ds.order] if ds.order in ds.system and ds.order != ds.id else []
    return ds.on(df.drop(*old), order=name, system=ds.system - set(old) | {name})


def _position(ds: Dataset) -> str:
    name = "position"
    while name in ds.df.columns and name != ds.order:
        name += "_"
    return name if name not in ds.df.columns else name + "_"


def _by(ds: Dataset, key: Column) -> Dataset:
    name = _position(ds)
    return _placed(ds, ranked(ds.df, key, tie(ds), rank=name), name)


@operator("shuffle.deterministic")
def deterministic(ds: Dataset, config: Config) -> Dataset:
    return _by(ds, hash_key(option(config, "seed", kinds=int), ds.key()))


@operator("shuffle.block")
def block(ds: Dataset, config: Config) -> Dataset:
    """Blocks of so many rows are shuffled, and rows within them."""
    size, seed = option(config, "block_size", kinds=int, least=1), option(config, "seed", 0, int)
    number, b = unused(ds.df, "number", "block")
    df = numbered(ds.df, [quoted(ds.arrival)], number).withColumn(b, F.floor(F.col(number) / size).cast("string"))
    name = _position(ds)
    key = F.concat(hash_key(f"{seed}:block", F.col(b)), hash_key(seed, ds.key()))
    return _placed(ds, ranked(df, key, tie(ds), rank=name).drop(number, b), name)


@operator("shuffle")
def shuffle(ds: Dataset, config: Config) -> Dataset:
    """algorithm: FisherYates (the default) or Reservoir, which are the same by hashes, or Block."""
    algorithm = option(config, "algorithm", "FisherYates", str).replace("_", "").lower()
    if algorithm == "block":
        return block(ds, {"block_size": option(config, "block_size", 100, int, 1), "seed": option(config, "seed", 0, int)})
    if algorithm not in ("fisheryates", "reservoir"):
        raise ConfigError("algorithm must be FisherYates, Block or Reservoir")
    return deterministic(ds, {"seed": option(config, "seed", 0, int)})


@operator("shuffle.stratified")
def stratified(ds: Dataset, config: Config) -> Dataset:
    """Strata are shuffled and dealt out in rounds, a row of each stratum that has one left, in random order."""
    path, seed = option(config, "field", kinds=str), option(config, "seed", 0, int)
    turn, cls = unused(ds.df, "round", "class")
    df = ranked(ds.df.withColumn(cls, label(ds, path)), hash_key(seed, ds.key()), tie(ds), [F.col(cls)], rank=turn)
    (h,) = unused(df, "h")
    df = df.withColumn(h, hash_key(f"{seed}:round", F.concat_ws(":", F.col(turn).cast("string"), F.col(cls))))
    name = _position(ds)
    return _placed(ds, numbered(df, [F.col(turn), F.col(h), *tie(ds)], name).drop(turn, cls, h), name)


@operator("shuffle.window")
def window(ds: Dataset, config: Config) -> Dataset:
    """Rows change places with others that are less than window_size away."""
    size, seed = option(config, "window_size", kinds=int, least=1), option(config, "seed", 0, int)
    number, near = unused(ds.df, "number", "near")
    df = numbered(ds.df, [quoted(ds.arrival)], number)
    df = df.withColumn(near, F.col(number) + (uniform(hash_key(seed, ds.key())) - 0.5) * size)
    name = _position(ds)
    return _placed(ds, numbered(df, [F.col(near), F.col(number)], name).drop(number, near), name)
