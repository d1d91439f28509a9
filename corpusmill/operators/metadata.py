"""Metadata: constants, projection, requirements, extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..dataset import Dataset, literal, segments
from ..errors import ConfigError, SchemaError
from ..registry import Config, operator, option, some
from .filters import java_regex


@operator("metadata.enrich", row_wise=True)
def enrich(ds: Dataset, config: Config) -> Dataset:
    """Constants under the keys, in the place of what was there."""
    for key, value in option(config, "entries", kinds=dict).items():
        ds = ds.put_meta(key, literal(value))
    return ds


@operator("metadata.remove", row_wise=True)
def remove(ds: Dataset, config: Config) -> Dataset:
    return ds.drop_meta(*option(config, "keys", kinds=list))


@operator("metadata.keep", row_wise=True)
def keep(ds: Dataset, config: Config) -> Dataset:
    kept = some(config, "keys", str)
    return ds.drop_meta(*(k for k in ds.meta if k not in kept))


def _pairs(config: Config) -> dict[str, str]:
    pairs = option(config, "keys", kinds=dict)
    if not all(isinstance(v, str) for v in pairs.values()):
        raise ConfigError("'keys' must name keys")
    return pairs


@operator("metadata.rename", row_wise=True)
def rename(ds: Dataset, config: Config) -> Dataset:
    """New names for keys, all at once, so that two can swap; one that is there already is overwritten."""
    names = _pairs(config)
    moved = {b: ds.meta[a] for a, b in names.items() if a in ds.meta}
    rest = {k: c for k, c in ds.meta.items() if k not in names}
    gone = [k for k in rest if k in moved]
    return ds.drop_meta(*gone).on(ds.drop_meta(*gone).df, meta={k: c for k, c in rest.items() if k not in moved} | moved)


@operator("metadata.copy", row_wise=True)
def copy(ds: Dataset, config: Config) -> Dataset:
    """Keys under other names as well; those that are missing are passed over."""
    found = [(b, ds.meta_column(a)) for a, b in _pairs(config).items() if a in ds.meta]
    for key, column in found:
        ds = ds.put_meta(key, column)
    return ds


@operator("metadata.require", row_wise=True)
def require(ds: Dataset, config: Config) -> Dataset:
    """All rows; the job fails at one without some key."""
    keys = some(config, "keys", str)
    lacking = [k for k in keys if k not in ds.meta]
    if lacking:
        raise SchemaError(f"no metadata {lacking}")
    for k in keys:
        c = ds.meta_column(k)
        ds = ds.put_meta(k, F.when(c.isNull(), F.raise_error(F.lit(f"a record lacks metadata {k!r}")).cast(ds.df.schema[ds.meta[k]].dataType)).otherwise(c))
    return ds


@operator("metadata.extract", row_wise=True)
def extract(ds: Dataset, config: Config) -> Dataset:
    """Payload fields as metadata. keys: {path: name or {name, optional, default, pattern, capture}}.

    With a pattern the capture group of the first match is taken, of text only. Where there is nothing, default is
    taken; else an optional key stays null, and without either the job fails.
    """
    for path, rule in option(config, "keys", kinds=dict).items():
        if isinstance(rule, str):
            rule = {"name": rule}
        if segments(path)[0] != "payload":
            raise ConfigError("paths to extract begin with payload")
        name = option(rule, "name", path.split(".")[-1], str)
        optional, pattern = option(rule, "optional", False, bool), rule.get("pattern")
        found = ds.find(path)
        value = found.column if found else F.lit(None).cast("string")
        if pattern is not None and found:
            java, capture = java_regex(pattern), option(rule, "capture", 0, int, 0)
            value = F.when(found.column.rlike(java), F.regexp_extract(found.column, java, capture)) if found.kind == "str" else F.lit(None).cast("string")
        if rule.get("default") is not None:
            value = F.coalesce(value, literal(rule["default"]))
        elif not optional:
            value = F.coalesce(value, F.raise_error(F.lit(f"nothing to extract at {path}")))
        ds = ds.put_meta(name, value)
    return ds
