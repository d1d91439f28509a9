"""Labels that split a table. A label is metadata; parts() gives a table for each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dataset import Dataset, quoted
from ..errors import ConfigError
from ..functions.ranks import hash_key, numbered, ranked, unused
from ..registry import NUMBER, Config, operator, option
from .sample import label, tie


def parts(ds: Dataset, names: list[str], key: str = "split") -> dict[str, Dataset]:
    """The rows of each label."""
    c = ds.meta_column(key)
    return {n: ds.where(c == n if c is not None else F.lit(False)) for n in names}


def _shares(config: Config) -> list[tuple[str, float]]:
    if "ratios" in config:
        ratios, names = option(config, "ratios", kinds=list), option(config, "names", kinds=list)
        if not ratios or len(ratios) != len(names) or any(isinstance(r, bool) or not isinstance(r, NUMBER) or r < 0 for r in ratios):
            raise ConfigError("ratios and names must be lists of the same length")
        if abs(sum(ratios) - 1) > 0.001:
            raise ConfigError("ratios must add up to 1")
        return list(zip(names, map(float, ratios), strict=True))
    test = option(config, "test_size", kinds=NUMBER)
    if not 0 <= test <= 1:
        raise ConfigError("test_size must lie between 0 and 1")
    return [("train", 1.0 - test), ("test", float(test))]


def _cut(rank: Column, total: Column, shares: list[tuple[str, float]]) -> Column:
    """The name of the part that a rank falls into; sizes are rounded, and the last part has the rest."""
    out, ends = F.lit(shares[-1][0]), []
    end: Column = F.lit(0)
    for _, share in shares[:-1]:
        end = end + F.round(total * F.lit(share))
        ends.append(end)
    for (name, _), e in reversed(list(zip(shares, ends, strict=False))):
        out = F.when(rank < e, name).otherwise(out)
    return out


def _labelled(ds: Dataset, config: Config, by: list[Column]) -> Dataset:
    shares, seed = _shares(config), option(config, "seed", 42, int)
    rank, total = unused(ds.df, "rank", "n")
    out = ds.on(ranked(ds.df, hash_key(seed, ds.key()), tie(ds), by, rank=rank, total=total))
    out = out.put_meta("split", _cut(F.col(rank), F.col(total), shares))
    return out.on(out.df.drop(rank, total))


@operator("split.random")
def random(ds: Dataset, config: Config) -> Dataset:
    """Each row gets a label in metadata split, parts being of the sizes that ratios (or test_size) say."""
    return _labelled(ds, config, [])


@operator("split.stratified")
def stratified(ds: Dataset, config: Config) -> Dataset:
    """The same within each stratum."""
    return _labelled(ds, config, [label(ds, option(config, "stratify_field", kinds=str))])


@operator("split.sequential")
def sequential(ds: Dataset, config: Config) -> Dataset:
    """Parts that follow each other in order of arrival."""
    shares = _shares(config)
    number, total = unused(ds.df, "number", "n")
    out = ds.on(numbered(ds.df, [quoted(ds.arrival)], number, total))
    out = out.put_meta("split", _cut(F.col(number), F.col(total), shares))
    return out.on(out.df.drop(number, total))


@operator("split.kfold", "split.k_fold")
def kfold(ds: Dataset, config: Config) -> Dataset:
    """k folds of nearly equal size, the first ones larger by a row: metadata fold (fold_i) and fold_index."""
    k, seed = option(config, "k", kinds=int, least=2), option(config, "seed", 42, int)
    rank, total = unused(ds.df, "rank", "n")
    r, n = F.col(rank), F.col(total)
    size, more = F.floor(n / k), n % k
    index = F.when(r < more * (size + 1), F.floor(r / (size + 1))).otherwise(more + F.floor((r - more * (size + 1)) / F.greatest(size, F.lit(1))))
    out = ds.on(ranked(ds.df, hash_key(seed, ds.key()), tie(ds), rank=rank, total=total))
    out = out.put_meta("fold_index", index.cast("bigint"))
    out = out.put_meta("fold", F.concat(F.lit("fold_"), out.meta_column("fold_index").cast("string")))
    return out.on(out.df.drop(rank, total))


@operator("split.chunk")
def chunk(ds: Dataset, config: Config) -> Dataset:
    """Chunks of so many rows in order of arrival: metadata chunk (from 0) and total_chunks."""
    size = option(config, "chunk_size", kinds=int, least=1)
    number, total = unused(ds.df, "number", "n")
    out = ds.on(numbered(ds.df, [quoted(ds.arrival)], number, total))
    out = out.put_meta("chunk", F.floor(F.col(number) / size).cast("bigint")).put_meta("total_chunks", F.ceil(F.col(total) / size).cast("bigint"))
    return out.on(out.df.drop(number, total))
