"""Operators by name: each takes (Dataset, config) and returns a Dataset without running anything."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame

from .dataset import Dataset
from .errors import ConfigError, MillError, OperatorError

Config = Mapping[str, Any]
Function = Callable[[Dataset, Config], Dataset]


@dataclass(frozen=True)
class Operator:
    """row_wise: each row's result depends on that row alone, so the operator also runs on streams."""

    name: str
    run: Function
    row_wise: bool = False

    def __call__(self, ds: Dataset, config: Config | None = None) -> Dataset:
        if ds.df.isStreaming and not self.row_wise:
            raise OperatorError(f"{self.name} needs the whole table, not a stream")
        try:
            return self.run(ds if self.row_wise else ds.with_arrival(), config or {})
        except MillError as e:
            raise type(e)(f"{self.name}: {e}") from e


_OPERATORS: dict[str, Operator] = {}


def operator(*names: str, row_wise: bool = False) -> Callable[[Function], Function]:
    """Registers a function under its names; a later one takes the place of an earlier one."""

    def add(run: Function) -> Function:
        for name in names:
            _OPERATORS[name] = Operator(name, run, row_wise)
        return run

    return add


def get(name: str) -> Operator:
    if name not in _OPERATORS:
        raise ConfigError(f"unknown operator {name!r}")
    return _OPERATORS[name]


def names() -> list[str]:
    return sorted(_OPERATORS)


def unregister(name: str) -> None:
    _OPERATORS.pop(name, None)


def apply_operator(data: Dataset | DataFrame, name: str, config: Config | str | None = None) -> Dataset:
    """The result of one operator. config may be JSON text."""
    if isinstance(config, str):
        try:
            config = json.loads(config)
        except ValueError as e:
            raise ConfigError(f"{name}: config is no JSON: {e}") from e
    return get(name)(data if isinstance(data, Dataset) else Dataset.of(data), config)


_MISSING = object()


def option(config: Config, key: str, default: Any = _MISSING, kinds: type | tuple[type, ...] = object, least: float | None = None) -> Any:
    """A configuration value, checked."""
    if not isinstance(config, Mapping):
        raise ConfigError("config must be an object")
    value = config.get(key, default)
    if value is _MISSING:
        raise ConfigError(f"config lacks {key!r}")
    if value is default:
        return value
    if (kinds in (int, float, (int, float)) and isinstance(value, bool)) or not isinstance(value, kinds):
        raise ConfigError(f"{key!r} has the wrong type")
    if least is not None and value < least:
        raise ConfigError(f"{key!r} must be at least {least}")
    return value


NUMBER = (int, float)


def some(config: Config, key: str, kinds: type | tuple[type, ...] = object) -> list[Any]:
    """A list with an element at least."""
    values = option(config, key, kinds=list)
    if not values or not all(isinstance(v, kinds) for v in values):
        raise ConfigError(f"{key!r} must be a list with an element at least, all of the right type")
    return values
