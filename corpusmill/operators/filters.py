"""Predicates. All are column expressions, so the scan gets those that its format understands.

Equality is strict about types: an integer never equals a float or a string. A field that the schema lacks is missing.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..dataset import Dataset, Field, kind, literal
from ..errors import ConfigError
from ..functions.text import n_chars, n_words
from ..registry import NUMBER, Config, operator, option, some

def no() -> Column:
    return F.lit(False)


def yes() -> Column:
    return F.lit(True)


def surely(condition: Column) -> Column:
    """Null as false."""
    return F.coalesce(condition, no())


def same(field: Field, value: Any) -> Column:
    """Whether a field is the JSON value, of the same type; null where the field is null."""
    a, b = field.kind, kind(value)
    if b == "null":
        return field.column.isNull()
    if a == "time" and b == "str":
        return field.column == F.lit(value).try_cast(field.type)
    if a != b or a in ("object", "other"):
        return no()
    if a == "array":
        inner = kind(field.type.elementType)
        if not value:
            return F.size(field.column) == 0
        return field.column == literal(value).cast(field.type) if all(kind(v) == inner for v in value) else no()
    return field.column == F.lit(value)


def _field(ds: Dataset, config: Config) -> Field | None:
    return ds.find(option(config, "path", kinds=str))


def _number(ds: Dataset, config: Config) -> Column | None:
    found = _field(ds, config)
    return found.column if found and found.kind in ("int", "float") else None


def _text(ds: Dataset, config: Config, test: Callable[[Column], Column]) -> Column:
    """test of a string, or of some string of an array."""
    found = _field(ds, config)
    if found and found.kind == "str":
        return test(found.column)
    if found and isinstance(found.type, T.ArrayType) and kind(found.type.elementType) == "str":
        return surely(F.exists(found.column, test))
    return no()


@operator("filter.equals", row_wise=True)
def equals(ds: Dataset, config: Config) -> Dataset:
    """Rows whose field is the value; missing ones go."""
    found, value = _field(ds, config), option(config, "equals")
    return ds.where(same(found, value) if found else no())


@operator("filter.not_equals", row_wise=True)
def not_equals(ds: Dataset, config: Config) -> Dataset:
    """Rows whose field isn't the value; missing ones stay."""
    found, value = _field(ds, config), option(config, "equals")
    return ds.where(~surely(same(found, value)) if found else yes())


@operator("filter.any", row_wise=True)
def any_equals(ds: Dataset, config: Config) -> Dataset:
    """Rows some of whose fields are the value."""
    value = option(config, "equals")
    found = [ds.find(p) for p in some(config, "paths", str)]
    return ds.where(reduce(or_, (surely(same(f, value)) for f in found if f), no()))


@operator("filter.between", row_wise=True)
def between(ds: Dataset, config: Config) -> Dataset:
    """Rows whose number lies between min and max, both included."""
    low, high = option(config, "min", kinds=NUMBER), option(config, "max", kinds=NUMBER)
    if low > high:
        raise ConfigError("min is larger than max")
    c = _number(ds, config)
    return ds.where(c.between(low, high) if c is not None else no())


@operator("filter.less_than", row_wise=True)
def less_than(ds: Dataset, config: Config) -> Dataset:
    c, threshold = _number(ds, config), option(config, "threshold", kinds=NUMBER)
    return ds.where(c < threshold if c is not None else no())


@operator("filter.greater_than", row_wise=True)
def greater_than(ds: Dataset, config: Config) -> Dataset:
    c, threshold = _number(ds, config), option(config, "threshold", kinds=NUMBER)
    return ds.where(c > threshold if c is not None else no())


def _bounds(config: Config, kinds: Any, least: float | None = None) -> tuple[Any, Any]:
    low, high = option(config, "min", None, kinds, least), option(config, "max", None, kinds, least)
    if low is None and high is None:
        raise ConfigError("needs min or max")
    if low is not None and high is not None and low > high:
        raise ConfigError("min is larger than max")
    return low, high


def within(c: Column, low: Any, high: Any) -> Column:
    """Both bounds are included; None is no bound."""
    tests = ([c >= low] if low is not None else []) + ([c <= high] if high is not None else [])
    return reduce(and_, tests)


@operator("filter.range", row_wise=True)
def in_range(ds: Dataset, config: Config) -> Dataset:
    """Rows whose number lies within the bounds given."""
    c, bounds = _number(ds, config), _bounds(config, NUMBER)
    return ds.where(within(c, *bounds) if c is not None else no())


@operator("filter.length_range", row_wise=True)
def length_range(ds: Dataset, config: Config) -> Dataset:
    """Rows whose text has so many characters."""
    bounds = _bounds(config, int, 0)
    c = ds.text(option(config, "path", kinds=str))
    return ds.where(within(n_chars(c), *bounds) if c is not None else no())


@operator("filter.token_range", row_wise=True)
def token_range(ds: Dataset, config: Config) -> Dataset:
    """Rows whose text has so many words between white space."""
    bounds = _bounds(config, int, 0)
    c = ds.text(option(config, "path", kinds=str))
    return ds.where(within(n_words(c), *bounds) if c is not None else no())


@operator("filter.is_null", row_wise=True)
def is_null(ds: Dataset, config: Config) -> Dataset:
    """Rows whose field is null. include_missing: whether a field that the schema lacks counts."""
    found, missing = _field(ds, config), option(config, "include_missing", True, bool)
    return ds.where(found.column.isNull() if found else F.lit(missing))


@operator("filter.exists", row_wise=True)
def exists(ds: Dataset, config: Config) -> Dataset:
    found = _field(ds, config)
    return ds.where(found.column.isNotNull() if found else no())


@operator("filter.not_exists", row_wise=True)
def not_exists(ds: Dataset, config: Config) -> Dataset:
    found = _field(ds, config)
    return ds.where(found.column.isNull() if found else yes())


def java_regex(pattern: str) -> str:
    """A pattern whose classes know Unicode; look-around isn't part of the dialect."""
    if re.search(r"(?<!\\)\(\?<?[=!]", pattern):
        raise ConfigError("look-around isn't supported in patterns")
    return "(?U)" + pattern


@operator("filter.regex", row_wise=True)
def regex(ds: Dataset, config: Config) -> Dataset:
    """Rows whose text, or some string of whose array, matches anywhere."""
    pattern = java_regex(option(config, "pattern", kinds=str))
    return ds.where(_text(ds, config, lambda c: c.rlike(pattern)))


@operator("filter.starts_with", row_wise=True)
def starts_with(ds: Dataset, config: Config) -> Dataset:
    prefix = option(config, "prefix", kinds=str)
    return ds.where(_text(ds, config, lambda c: c.startswith(prefix)))


@operator("filter.ends_with", row_wise=True)
def ends_with(ds: Dataset, config: Config) -> Dataset:
    suffix = option(config, "suffix", kinds=str)
    return ds.where(_text(ds, config, lambda c: c.endswith(suffix)))


def _strict(ds: Dataset, config: Config) -> Column:
    """Whether the field is one of the values; a plain IN for values of the field's type, so that it reaches the scan."""
    found, values = _field(ds, config), some(config, "values")
    if not found:
        return no()
    alike = [v for v in values if kind(v) == found.kind]
    if found.kind in ("bool", "int", "float", "str"):
        tests = ([found.column.isin(alike)] if alike else []) + ([found.column.isNull()] if None in values else [])
    else:
        tests = [same(found, v) for v in values]
    return reduce(or_, tests, no()) if len(tests) != 1 else tests[0]


@operator("filter.in", row_wise=True)
def is_in(ds: Dataset, config: Config) -> Dataset:
    """Rows whose field is one of the values; missing ones go."""
    return ds.where(_strict(ds, config))


@operator("filter.not_in", row_wise=True)
def not_in(ds: Dataset, config: Config) -> Dataset:
    """Rows whose field is none of the values; missing ones stay."""
    return ds.where(~surely(_strict(ds, config)))


def _holds(needle: str, fold: bool) -> Callable[[Column], Column]:
    return (lambda c: F.lower(c).contains(needle.lower())) if fold else (lambda c: c.contains(needle))


@operator("filter.contains", row_wise=True)
def contains(ds: Dataset, config: Config) -> Dataset:
    needle, fold = option(config, "contains", kinds=str), option(config, "case_insensitive", False, bool)
    return ds.where(_text(ds, config, _holds(needle, fold)))


def _each(ds: Dataset, config: Config, key: str) -> list[Column]:
    fold = option(config, "case_insensitive", False, bool)
    return [_text(ds, config, _holds(x, fold)) for x in some(config, key, str)]


@operator("filter.contains_all", row_wise=True)
def contains_all(ds: Dataset, config: Config) -> Dataset:
    """Rows that hold every needle; in an array each may be in another element."""
    return ds.where(reduce(and_, _each(ds, config, "contains_all")))


@operator("filter.contains_any", row_wise=True)
def contains_any(ds: Dataset, config: Config) -> Dataset:
    return ds.where(reduce(or_, _each(ds, config, "contains_any")))


@operator("filter.contains_none", row_wise=True)
def contains_none(ds: Dataset, config: Config) -> Dataset:
    """Rows that hold no needle; missing ones stay, those that are neither text nor an array of it go."""
    found, tests = _field(ds, config), _each(ds, config, "contains_none")
    if not found:
        return ds.where(yes())
    textual = found.kind == "str" or isinstance(found.type, T.ArrayType) and kind(found.type.elementType) == "str"
    return ds.where(found.column.isNull() | (~reduce(or_, map(surely, tests)) if textual else no()))


@operator("filter.array_contains", row_wise=True)
def array_contains(ds: Dataset, config: Config) -> Dataset:
    """Rows whose array has the element; missing ones stay, those that are no array go."""
    found, element = _field(ds, config), option(config, "element")
    if not found:
        return ds.where(yes())
    if not isinstance(found.type, T.ArrayType):
        return ds.where(found.column.isNull())
    inner = Field(F.lit(None), found.type.elementType)
    has = F.exists(found.column, lambda x: surely(same(Field(x, inner.type), element)))
    return ds.where(found.column.isNull() | has)


@operator("limit")
def limit(ds: Dataset, config: Config) -> Dataset:
    """The first rows in order of arrival."""
    count = option(config, "count", kinds=int, least=0)
    return ds.on(ds.df.orderBy(ds.arrival).limit(count))
