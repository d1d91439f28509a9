"""A table of records: payload columns, metadata columns, an id and an arrival order.

A path such as payload.a.b or metadata.k becomes a Column when a plan is built, so pruning, push-down and code
generation see plain columns. A field that the schema lacks is missing; a null counts as missing too, except where an
operator's docstring says otherwise.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import ConfigError, SchemaError

ORDER = "_ord"


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def literal(value: Any) -> Column:
    """A JSON value as a literal; objects become structs."""
    if isinstance(value, list):
        return F.array(*map(literal, value))
    if isinstance(value, dict):
        return F.struct(*(literal(v).alias(k) for k, v in sorted(value.items())))
    return F.lit(value)


def kind(of: Any) -> str:
    """null, bool, int, float, str, time, array or object: of a Spark type or a JSON value."""
    if isinstance(of, T.DataType):
        for name, types in _KINDS:
            if isinstance(of, types):
                return name
        return "other"
    if of is None:
        return "null"
    return {bool: "bool", int: "int", float: "float", str: "str", list: "array", dict: "object"}.get(type(of), "other")


_KINDS = [
    ("null", T.NullType), ("bool", T.BooleanType), ("int", (T.ByteType, T.ShortType, T.IntegerType, T.LongType)), ("float", (T.FloatType, T.DoubleType, T.DecimalType)),
    ("str", (T.StringType, T.VarcharType, T.CharType)), ("time", (T.DateType, T.TimestampType, T.TimestampNTZType)), ("array", T.ArrayType), ("object", (T.StructType, T.MapType)),
]


def segments(path: str) -> list[str]:
    """The parts of a path; it begins with payload or metadata, and metadata needs a key."""
    if not isinstance(path, str):
        raise ConfigError("a path must be a string")
    parts = [p.strip() for p in path.split(".") if p.strip()]
    if not parts or parts[0] not in ("payload", "metadata"):
        raise ConfigError(f"path {path!r} must begin with payload or metadata")
    if parts[0] == "metadata" and len(parts) == 1:
        raise ConfigError("a metadata path needs a key")
    return parts


@dataclass(frozen=True)
class Field:
    column: Column
    type: T.DataType

    @property
    def kind(self) -> str:
        return kind(self.type)


@dataclass(frozen=True)
class Dataset:
    """df and the roles of its columns. meta: the column of each metadata key. system: columns that are no payload."""

    df: DataFrame
    id: str | None = None
    order: str | None = None
    meta: Mapping[str, str] = field(default_factory=dict)
    system: frozenset[str] = frozenset()

    @staticmethod
    def of(df: DataFrame, id: str | None = None, order: str | None = None, metadata: tuple[str, ...] = ()) -> Dataset:
        """A table whose columns, but for those named as metadata, are the payload. Order is that of the column order, by default id."""
        return Dataset(df, id, order or id, {k: k for k in metadata})

    def with_arrival(self) -> Dataset:
        """With the order of the scan, if there is no other."""
        if self.order is not None:
            return self
        return self.on(self.df.withColumn(ORDER, F.monotonically_increasing_id()), order=ORDER, system=self.system | {ORDER})

    @staticmethod
    def from_envelope(df: DataFrame) -> Dataset:
        """A table (id, payload, metadata) whose payload and metadata are structs (or null)."""
        kinds = dict(zip(df.columns, (f.dataType for f in df.schema), strict=True))
        if not isinstance(kinds.get("payload"), T.StructType):
            raise SchemaError("payload must be a struct")
        payload = kinds["payload"].names
        metadata = kinds["metadata"].names if isinstance(kinds.get("metadata"), T.StructType) else []
        columns = [F.col("payload").getField(c).alias(c) for c in payload]
        taken = {*payload, "id", ORDER}
        meta = {}
        for k in metadata:
            meta[k] = _free(f"meta_{k}" if k in taken else k, taken)
            columns.append(F.col("metadata").getField(k).alias(meta[k]))
        ident = _free("id" if "id" not in payload else "record_id", {*payload, *meta.values()})
        order = F.col(ORDER) if ORDER in df.columns else F.monotonically_increasing_id()
        head = [(F.col("id").cast("string") if "id" in df.columns else F.lit(None).cast("string")).alias(ident), order.alias(ORDER)]
        return Dataset(df.select(*head, *columns), ident, ORDER, meta, frozenset([ident, ORDER]))

    def to_envelope(self) -> DataFrame:
        """(id, payload, metadata); metadata is null where the dataset has none."""
        ident = quoted(self.id).cast("string") if self.id else F.lit(None).cast("string")
        metadata = F.struct(*(quoted(c).alias(k) for k, c in self.meta.items())) if self.meta else F.lit(None).cast("struct<none:string>")
        return self.df.select(ident.alias("id"), F.struct(*map(quoted, self.payload)).alias("payload"), metadata.alias("metadata"))

    @property
    def payload(self) -> list[str]:
        hidden = {*self.meta.values(), *self.system}
        return [c for c in self.df.columns if c not in hidden]

    def on(self, df: DataFrame, **changes: Any) -> Dataset:
        return replace(self, df=df, **changes)

    def where(self, condition: Column) -> Dataset:
        return self.on(self.df.filter(condition))

    def find(self, path: str) -> Field | None:
        """The field at path; None if the schema has none. A number picks an element of an array."""
        head, *rest = segments(path)
        if head == "metadata":
            name, *rest = rest
            if name not in self.meta:
                return None
            name = self.meta[name]
        elif not rest:
            kinds = [self.df.schema[c] for c in self.payload]
            return Field(F.struct(*map(quoted, self.payload)), T.StructType(kinds))
        else:
            name, *rest = rest
            if name not in self.payload:
                return None
        column, dtype = quoted(name), self.df.schema[name].dataType
        for part in rest:
            if isinstance(dtype, T.StructType) and part in dtype.names:
                column, dtype = column.getField(part), dtype[part].dataType
            elif isinstance(dtype, T.ArrayType) and part.isdigit():
                column, dtype = F.get(column, F.lit(int(part))), dtype.elementType
            elif isinstance(dtype, T.MapType):
                column, dtype = F.try_element_at(column, F.lit(part)), dtype.valueType
            else:
                return None
        return Field(column, dtype)

    def text(self, path: str) -> Column | None:
        """The field at path if it is a string."""
        found = self.find(path)
        return found.column if found and found.kind == "str" else None

    def joined_text(self, path: str) -> Column:
        """A string field; the strings of an array or (by sorted key) an object joined by spaces; else empty."""
        found = self.find(path)
        if found is None:
            return F.lit("")
        if found.kind == "str":
            out = found.column
        elif found.kind == "array" and kind(found.type.elementType) == "str":
            out = F.array_join(found.column, " ")
        elif isinstance(found.type, T.StructType):
            out = F.concat_ws(" ", *(found.column.getField(f.name) for f in sorted(found.type, key=lambda f: f.name) if kind(f.dataType) == "str"))
        else:
            return F.lit("")
        return F.coalesce(out, F.lit(""))

    def put(self, path: str, column: Column) -> Dataset:
        """The dataset with the field at path set."""
        head, *rest = segments(path)
        if head == "metadata":
            if len(rest) == 1:
                return self.put_meta(rest[0], column)
            if rest[0] not in self.meta:
                return self.put_meta(rest[0], _nested(rest[1:], column))
            name = self.meta[rest[0]]
        elif not rest:
            raise ConfigError("a path to set needs a field")
        else:
            name = rest[0]
            if name in self.meta.values() or name in self.system:
                raise SchemaError(f"column {name!r} is taken; rename the metadata")
        if len(rest) == 1:
            return self.on(self.df.withColumn(name, column))
        if name not in self.df.columns:
            return self.on(self.df.withColumn(name, _nested(rest[1:], column)))
        return self.on(self.df.withColumn(name, _with(quoted(name), self.df.schema[name].dataType, rest[1:], column)))

    def put_meta(self, key: str, column: Column) -> Dataset:
        """The metadata key's column is named like it, or meta_key if a column has that name already."""
        name = self.meta.get(key)
        if name is None:
            taken = set(self.df.columns)
            name = key if key not in taken else _free(f"meta_{key}", taken)
        return self.on(self.df.withColumn(name, column), meta={**self.meta, key: name})

    def meta_column(self, key: str) -> Column | None:
        return quoted(self.meta[key]) if key in self.meta else None

    def drop_meta(self, *keys: str) -> Dataset:
        gone = [self.meta[k] for k in keys if k in self.meta]
        return self.on(self.df.drop(*map(quoted, gone)), meta={k: c for k, c in self.meta.items() if k not in keys})

    def key(self) -> Column:
        """The id as a string, else the order."""
        return F.coalesce(quoted(self.id or self.arrival).cast("string"), F.lit(""))

    @property
    def arrival(self) -> str:
        if self.order is None:
            raise SchemaError("the dataset has no order: pass id= or order=")
        return self.order


def _free(name: str, taken: set[str]) -> str:
    while name in taken:
        name += "_"
    taken.add(name)
    return name


def _nested(parts: list[str], column: Column) -> Column:
    for part in reversed(parts):
        column = F.struct(column.alias(part))
    return column


def _with(base: Column, dtype: T.DataType, parts: list[str], column: Column) -> Column:
    """base with the nested field set; what is no object is replaced by one."""
    if not isinstance(dtype, T.StructType):
        return _nested(parts, column)
    name, rest = parts[0], parts[1:]
    if rest:
        column = _with(base.getField(name), dtype[name].dataType, rest, column) if name in dtype.names else _nested(rest, column)
    fields = [(column if f.name == name else base.getField(f.name)).alias(f.name) for f in dtype]
    return F.struct(*fields, *([] if name in dtype.names else [column.alias(name)]))
