"""Transforms of fields. A scalar function leaves what isn't of its type as it is, and never fails."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..dataset import Dataset, Field, kind
from ..errors import ConfigError
from ..functions.text import squeezed, trimmed
from ..registry import Config, operator, option, some
from .filters import java_regex, same, surely

FUNCTIONS = ("Lowercase", "Uppercase", "Trim", "Strip", "Replace", "RegexReplace", "Prefix", "Suffix", "Truncate", "Pad", "JsonStringify", "JsonParse", "ToInt", "ToFloat", "ToBool", "ToString", "Split", "Join")


def _json(f: Field) -> Column:
    """The value's JSON text."""
    if f.kind == "object" or f.kind == "array":
        return F.to_json(f.column)
    if f.kind == "str":
        inner = F.to_json(F.struct(f.column.alias("v")))
        return F.when(f.column.isNull(), F.lit("null")).otherwise(F.substr(inner, F.lit(6), F.length(inner) - 6))
    return F.coalesce(f.column.cast("string"), F.lit("null"))


def _replacement(text: str) -> str:
    """$name and ${name} are groups; a backslash is one."""
    return re.sub(r"\$(?!\{|\w)", r"\\$", text.replace("\\", "\\\\")) if "$" in text or "\\" in text else text


def scalar(f: Field, function: str | dict[str, Any]) -> Field:
    """The field after a scalar function: its name, or {name: options}."""
    name, o = (function, {}) if isinstance(function, str) else next(iter(function.items())) if isinstance(function, dict) and len(function) == 1 else (None, {})
    if name not in FUNCTIONS:
        raise ConfigError(f"unknown transform {function!r}")
    o = o or {}
    c, k = f.column, f.kind
    text = {
        "Lowercase": lambda: F.lower(c), "Uppercase": lambda: F.upper(c), "Trim": lambda: trimmed(c), "Strip": lambda: trimmed(c),
        "Replace": lambda: F.replace(c, F.lit(option(o, "from", kinds=str)), F.lit(option(o, "to", kinds=str))) if o.get("from") else c,
        "RegexReplace": lambda: F.regexp_replace(c, java_regex(option(o, "pattern", kinds=str)), _replacement(option(o, "replacement", kinds=str))),
        "Prefix": lambda: F.concat(F.lit(_value(o, "prefix")), c), "Suffix": lambda: F.concat(c, F.lit(_value(o, "suffix"))),
        "Truncate": lambda: F.substring(c, 1, option(o, "max_length", kinds=int, least=0)),
        "Pad": lambda: F.concat(c, F.repeat(F.lit(option(o, "char", " ", str)), F.greatest(F.lit(option(o, "length", kinds=int, least=0)) - F.char_length(c), F.lit(0)))),
    }
    if name in text:
        return Field(text[name](), T.StringType()) if k == "str" else f
    if name == "JsonStringify":
        return Field(_json(f), T.StringType())
    if name == "ToString":
        return f if k == "str" else Field(_json(f), T.StringType())
    if name == "JsonParse":
        return Field(F.try_parse_json(c), T.VariantType()) if k == "str" else f
    if name == "Split":
        if k != "str":
            return f
        return Field(F.split(c, F.lit(re.sub(r"([\\.\[\]{}()*+?^$|-])", r"\\\1", _value(o, "separator"))), -1), T.ArrayType(T.StringType()))
    if name == "Join":
        joins = k == "array" and kind(f.type.elementType) == "str"
        return Field(F.when(c.isNotNull(), F.array_join(c, _value(o, "separator"))), T.StringType()) if joins else f
    if name == "ToInt":
        if k == "str":
            return Field(F.when(c.rlike(r"^[+-]?[0-9]+$"), c.try_cast("bigint")), T.LongType())
        if k == "float":
            return Field(F.when(c == F.floor(c), c.try_cast("bigint")), T.LongType())
        return Field(c.cast("bigint"), T.LongType()) if k in ("bool", "int") else f
    if name == "ToFloat":
        if k == "str":
            return Field(F.when(c.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$|^(?i)[+-]?(inf|infinity|nan)$"), c.try_cast("double")), T.DoubleType())
        return Field(c.cast("double"), T.DoubleType()) if k in ("int", "float") else f
    truth = {"str": lambda: (c != "") & (F.lower(c) != "false") & (c != "0"), "bool": lambda: c, "int": lambda: c != 0, "float": lambda: c != 0}
    return Field(surely(truth[k]()) if k in truth else c.isNotNull(), T.BooleanType())


def _value(options: Any, key: str) -> str:
    if isinstance(options, str):
        return options
    return option(options, key if key in options else "value", kinds=str)


@operator("transform.normalize", row_wise=True)
def normalize(ds: Dataset, config: Config) -> Dataset:
    """Trimmed text with single spaces, in lower case if asked."""
    path, lower = option(config, "path", kinds=str), option(config, "lowercase", False, bool)
    c = ds.text(path)
    if c is None:
        return ds
    return ds.put(path, F.lower(squeezed(c)) if lower else squeezed(c))


@operator("transform.map", row_wise=True)
def apply(ds: Dataset, config: Config) -> Dataset:
    """One scalar function of a field, in place. In a typed column what ToInt and ToFloat can't read becomes null."""
    return chain(ds, {"path": option(config, "path", kinds=str), "transforms": [option(config, "transform")]})


@operator("transform.chain", row_wise=True)
def chain(ds: Dataset, config: Config) -> Dataset:
    """Several scalar functions of a field, one after the other."""
    path = option(config, "path", kinds=str)
    found = ds.find(path)
    for function in some(config, "transforms"):
        out = scalar(found or Field(F.lit(None).cast("string"), T.StringType()), function)
        found = out if found else None
    return ds.put(path, found.column) if found else ds


_SLOT = re.compile(r"\{\{\s*([^{}]*?)\s*\}\}")


@operator("transform.template", row_wise=True)
def template(ds: Dataset, config: Config) -> Dataset:
    """Text in which {{payload.x}} and {{metadata.y}} are filled in; what can't be filled stays as it is written."""
    text, target = option(config, "template", kinds=str), option(config, "output_field", kinds=str)
    parts, at = [], 0
    for m in _SLOT.finditer(text):
        found = ds.find(m[1]) if m[1].split(".")[0] in ("payload", "metadata") and m[1] != "metadata" else None
        if found is None:
            continue
        value = found.column if found.kind == "str" else _json(Field(found.column, found.type))
        parts += [F.lit(text[at : m.start()]), F.when(found.column.isNull(), F.lit(m[0])).otherwise(value)]
        at = m.end()
    return ds.put(target, F.concat(*parts, F.lit(text[at:])))


@operator("transform.flat_map", row_wise=True)
def flat_map(ds: Dataset, config: Config) -> Dataset:
    """A row for each element of an array, none for an empty one; rows whose field is no array stay as they are."""
    path, target = option(config, "path", kinds=str), option(config, "output_field", kinds=str)
    found = ds.find(path)
    if not found or not isinstance(found.type, T.ArrayType):
        return ds
    old = ds.find(target)
    one = F.when(found.column.isNull(), F.array((old.column if old else F.lit(None)).cast(found.type.elementType))).otherwise(found.column)
    tmp = "_element"
    while tmp in ds.df.columns:
        tmp += "_"
    out = ds.on(ds.df.withColumn(tmp, F.explode(one))).put(target, F.col(tmp))
    return out.on(out.df.drop(tmp))


@operator("transform.coalesce", row_wise=True)
def coalesce(ds: Dataset, config: Config) -> Dataset:
    """The first field that isn't null; the target keeps its value if all are."""
    target = option(config, "output_field", kinds=str)
    found = [f for f in map(ds.find, some(config, "paths", str)) if f]
    old = ds.find(target)
    columns = [f.column for f in [*found, *([old] if old else [])]]
    return ds.put(target, F.coalesce(*columns)) if columns else ds


@operator("transform.conditional", row_wise=True)
def conditional(ds: Dataset, config: Config) -> Dataset:
    """One scalar function of a field where it has a value, another (or none) elsewhere."""
    path, value = option(config, "condition_path", kinds=str), option(config, "condition_value")
    found = ds.find(path)
    if not found:
        return ds
    then = scalar(found, option(config, "then"))
    other = scalar(found, config["else"]) if config.get("else") is not None else found
    if then.kind != other.kind:
        raise ConfigError("then and else give different types")
    return ds.put(path, F.when(surely(same(found, value)), then.column).otherwise(other.column))
