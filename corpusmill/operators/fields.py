"""Projection of fields."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..dataset import Dataset, literal, quoted, segments
from ..errors import ConfigError
from ..registry import Config, operator, option, some


def _last(path: str) -> str:
    return path.split(".")[-1].strip()


@operator("field.select", row_wise=True)
def select(ds: Dataset, config: Config) -> Dataset:
    """Only (mode Include) or all but (Exclude) the fields, named by their paths' last parts, of payload and metadata."""
    wanted = {_last(p) for p in some(config, "fields", str)}
    mode = option(config, "mode", "Include", str).lower()
    if mode not in ("include", "exclude"):
        raise ConfigError("mode must be Include or Exclude")
    stays = (lambda k: k in wanted) if mode == "include" else (lambda k: k not in wanted)
    return _keep(ds, stays)


def _keep(ds: Dataset, stays) -> Dataset:
    gone = {c for c in ds.payload if not stays(c)} | {c for k, c in ds.meta.items() if not stays(k)}
    system = ds.system
    kept = {c for c in (ds.id, ds.order) if c in gone}  # what identifies and orders rows stays, but no longer as payload
    return ds.on(ds.df.drop(*map(quoted, gone - kept)), meta={k: c for k, c in ds.meta.items() if stays(k)}, system=system | kept)


@operator("field.drop", row_wise=True)
def drop(ds: Dataset, config: Config) -> Dataset:
    """Without the fields, at the top of payload and metadata."""
    gone = {_last(p) for p in some(config, "fields", str)}
    return _keep(ds, lambda k: k not in gone)


@operator("field.rename", row_wise=True)
def rename(ds: Dataset, config: Config) -> Dataset:
    """New names for top fields of payload and metadata, all at once; one that is there already is overwritten."""
    names = {_last(a): _last(b) for a, b in option(config, "mappings", kinds=dict).items()}
    payload = {c: names[c] for c in ds.payload if c in names}
    meta = {names.get(k, k): c for k, c in sorted(ds.meta.items(), key=lambda x: x[0] in names)}
    clash = set(payload.values()) & (set(ds.meta.values()) | ds.system)
    if clash:
        raise ConfigError(f"names that are taken: {sorted(clash)}")
    overwritten = [c for c in ds.payload if c in payload.values() and c not in payload]
    df = ds.df.drop(*map(quoted, overwritten)).withColumnsRenamed(payload)
    return ds.on(df, id=payload.get(ds.id, ds.id), order=payload.get(ds.order, ds.order), meta=meta)


def _copy(ds: Dataset, config: Config) -> tuple[Dataset, str]:
    source, target = option(config, "source", kinds=str), option(config, "target", kinds=str)
    if len(segments(target)) != 2:
        raise ConfigError("target must be payload.name or metadata.name")
    found = ds.find(source)
    return (ds.put(target, found.column) if found else ds), source


@operator("field.copy", row_wise=True)
def copy(ds: Dataset, config: Config) -> Dataset:
    """A field under another name as well; nothing where the schema lacks it."""
    return _copy(ds, config)[0]


@operator("field.move", row_wise=True)
def move(ds: Dataset, config: Config) -> Dataset:
    """A field under another name; a nested source stays where it is too."""
    out, source = _copy(ds, config)
    head, *rest = segments(source)
    if len(rest) != 1 or segments(config["target"]) == [head, *rest]:
        return out
    if head == "metadata":
        return out.drop_meta(rest[0])
    return _keep_payload(out, rest[0]) if rest[0] in out.payload else out


def _keep_payload(ds: Dataset, gone: str) -> Dataset:
    if gone in (ds.id, ds.order):
        return ds.on(ds.df, system=ds.system | {gone})
    return ds.on(ds.df.drop(quoted(gone)))


@operator("field.flatten", row_wise=True)
def flatten(ds: Dataset, config: Config) -> Dataset:
    """The members of an object, however deep, beside it as field_key; the object goes."""
    path, sep = option(config, "field", kinds=str), option(config, "separator", "_", str)
    head, *rest = segments(path)
    found = ds.find(path)
    if head != "payload" or len(rest) != 1 or not found or not isinstance(found.type, T.StructType):
        return ds
    columns = {}

    def walk(prefix: str, column, dtype: T.StructType) -> None:
        for f in dtype:
            name, inner = f"{prefix}{sep}{f.name}", column.getField(f.name)
            if isinstance(f.dataType, T.StructType):
                walk(name, inner, f.dataType)
            else:
                columns[name] = inner

    walk(rest[0], found.column, found.type)
    return _keep_payload(ds.on(ds.df.withColumns(columns)), rest[0])


@operator("field.default", row_wise=True)
def default(ds: Dataset, config: Config) -> Dataset:
    """A constant where the field is missing or null; in typed tables both are null."""
    path, value = option(config, "field", kinds=str), option(config, "default_value")
    if len(segments(path)) != 2:
        raise ConfigError("field must be payload.name or metadata.name")
    found = ds.find(path)
    if found is None:
        return ds.put(path, literal(value))
    return ds.put(path, F.coalesce(found.column, literal(value).cast(found.type)))


@operator("field.require", row_wise=True)
def require(ds: Dataset, config: Config) -> Dataset:
    """Rows that have every field, not null."""
    found = [ds.find(p) for p in some(config, "fields", str)]
    return ds.where(reduce(and_, (f.column.isNotNull() if f else F.lit(False) for f in found)))
