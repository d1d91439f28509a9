"""Unions, merges and set operations. inputs: further tables (Python only); without any, the table's own rows are compared."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..dataset import ORDER, Dataset, kind, literal, quoted
from ..errors import ConfigError, SchemaError
from ..functions.ranks import unused
from ..registry import Config, operator, option


def _inputs(config: Config) -> list[Dataset]:
    return [x if isinstance(x, Dataset) else Dataset.of(x) for x in option(config, "inputs", [], list)]


def _mode(config: Config) -> str:
    mode = option(config, "field_mode", "Align", str).lower()
    if mode not in ("align", "strict", "loose"):
        raise ConfigError("field_mode must be Align, Strict or Loose")
    return mode


@operator("merge.concat")
def concat(ds: Dataset, config: Config) -> Dataset:
    """The rows of the table and of the inputs, in this order; fields that one lacks are null there, or an error if Strict."""
    mode, tables = _mode(config), [ds, *_inputs(config)]
    if mode == "strict" and any(set(t.payload) != set(ds.payload) for t in tables):
        raise SchemaError("the tables' fields differ")
    if len(tables) == 1:
        return ds
    out, meta = None, {}
    for i, t in enumerate(tables):
        place = F.struct(F.lit(i).alias("table"), quoted(t.arrival).cast("string").alias("key") if kind(t.df.schema[t.arrival].dataType) != "int" else F.lpad(quoted(t.arrival).cast("string"), 20, "0").alias("key"))
        moved = t.df.withColumnsRenamed({c: f"{k}" for k, c in t.meta.items() if k not in t.payload})
        meta |= {k: (k if k not in t.payload else c) for k, c in t.meta.items()}
        moved = moved.drop(*(quoted(c) for c in t.system if c in (ORDER,))).withColumn(ORDER, place)
        out = moved if out is None else out.unionByName(moved, allowMissingColumns=True)
    return Dataset(out, ds.id, ORDER, meta, ds.system | {ORDER})


def whole_key(ds: Dataset) -> Column:
    """A hash of the payload; null fields count as missing."""
    return F.sha2(F.to_json(F.struct(*map(quoted, sorted(ds.payload)))), 256)


def _key(ds: Dataset, config: Config) -> Column:
    path = option(config, "key_field", None, str)
    if path is None:
        return whole_key(ds)
    found = ds.find(path if path.split(".")[0] in ("payload", "metadata") else f"payload.{path}")
    if found is None:
        return whole_key(ds)
    value = F.to_json(found.column) if found.kind in ("array", "object") else found.column.cast("string")
    return F.coalesce(value, F.lit("\0null"))


@operator("merge.union")
def union(ds: Dataset, config: Config) -> Dataset:
    """The first row of each key (a field, or the whole payload) of the table and the inputs. Spark keeps one row of a key per partition before it shuffles."""
    all_rows = concat(ds, {"inputs": option(config, "inputs", [], list)})
    k, n = unused(all_rows.df, "key", "n")
    df = all_rows.df.withColumn(k, _key(all_rows, config))
    df = df.withColumn(n, F.row_number().over(W.partitionBy(k).orderBy(quoted(all_rows.arrival)))).filter(F.col(n) == 1)
    return all_rows.on(df.drop(k, n))


def _firsts(ds: Dataset, config: Config, wanted: Callable[[Column], Column]) -> Dataset:
    """The first row of each key that so many rows have."""
    k, first, n, key = unused(ds.df, "key", "first", "n", "k2")
    df = ds.df.withColumn(k, _key(ds, config))
    counts = df.groupBy(F.col(k).alias(key)).agg(F.min(quoted(ds.arrival)).alias(first), F.count("*").alias(n)).filter(wanted(F.col(n)))
    return ds.on(df.join(counts, (F.col(k) == F.col(key)) & (quoted(ds.arrival) == F.col(first)), "left_semi").drop(k))


def _pairwise(ds: Dataset, config: Config, how: str) -> Dataset:
    for other in _inputs(config):
        k, k2 = unused(ds.df, "key", "k2")
        there = other.df.select(_key(other, config).alias(k2)).distinct()
        ds = ds.on(ds.df.withColumn(k, _key(ds, config)).join(there, F.col(k) == F.col(k2), how).drop(k))
    return ds


@operator("merge.intersect")
def intersect(ds: Dataset, config: Config) -> Dataset:
    """The first row of each key that comes more than once; with inputs, the first of each key that all of them have."""
    if config.get("inputs"):
        return union(_pairwise(ds, config, "left_semi"), {k: v for k, v in config.items() if k == "key_field"})
    return _firsts(ds, config, lambda n: n > 1)


@operator("merge.difference")
def difference(ds: Dataset, config: Config) -> Dataset:
    """The rows whose key comes once; with inputs, the first of each key that none of them has."""
    if config.get("inputs"):
        return union(_pairwise(ds, config, "left_anti"), {k: v for k, v in config.items() if k == "key_field"})
    return _firsts(ds, config, lambda n: n == 1)


@operator("merge.batch")
def batch(ds: Dataset, config: Config) -> Dataset:
    """A row for each id (rows without one: each payload). A field with several values has the First, the Last, or all of them
    (Concat: texts joined by spaces, arrays one after the other, else the last); Error fails. Metadata have the first value."""
    _mode(config)
    strategy = option(config, "conflict_strategy", "First", str).lower()
    if strategy not in ("first", "last", "concat", "error"):
        raise ConfigError("conflict_strategy must be First, Last, Concat or Error")
    (k,) = unused(ds.df, "key")
    o = quoted(ds.arrival)
    key = F.coalesce(quoted(ds.id).cast("string"), whole_key(ds)) if ds.id else whole_key(ds)

    def picked(name: str, chosen: str) -> Column:
        c, dtype = quoted(name), ds.df.schema[name].dataType
        there = F.when(c.isNotNull(), o)
        if chosen == "last":
            return F.max_by(c, there)
        if chosen == "concat" and kind(dtype) in ("str", "array"):
            values = F.transform(F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct(o.alias("o"), c.alias("v"))))), lambda x: x["v"])
            one = F.array_join(values, " ") if kind(dtype) == "str" else F.flatten(values)
            return F.when(F.count(c) > 0, one)
        if chosen == "concat":
            return F.max_by(c, there)
        if chosen == "error":
            return F.when(F.count(c) > 1, F.raise_error(F.lit(f"field conflict: {name}")).cast(dtype)).otherwise(F.min_by(c, there))
        return F.min_by(c, there)

    columns = []
    for name in ds.df.columns:
        if name in (ds.id, ds.order):
            columns.append(F.min_by(quoted(name), o).alias(name))
        else:
            columns.append(picked(name, strategy if name in ds.payload else "first").alias(name))
    return ds.on(ds.df.groupBy(key.alias(k)).agg(*columns).drop(k))


@operator("merge.zip")
def zipped(ds: Dataset, config: Config) -> Dataset:
    """One row, each field the array of all values in order of arrival; what is missing is default_value, or null.

    The row holds the whole table, so this is for tables that fit into one value.
    """
    fill, default = option(config, "fill_missing", True, bool), config.get("default_value")
    o = quoted(ds.arrival)
    columns = []
    for name in ds.payload:
        c, dtype = quoted(name), ds.df.schema[name].dataType
        value = F.coalesce(c, literal(default).try_cast(dtype)) if fill and default is not None and not isinstance(dtype, T.StructType) else c
        columns.append(F.transform(F.array_sort(F.collect_list(F.struct(o.alias("o"), value.alias("v")))), lambda x: x["v"]).alias(name))
    rest = [F.min_by(quoted(c), o).alias(c) for c in ds.df.columns if c not in ds.payload]
    return ds.on(ds.df.agg(*columns, *rest), id=ds.id if ds.id not in ds.payload else None, order=ds.order if ds.order not in ds.payload else None)
