"""What the library raises."""

from __future__ import annotations


class MillError(Exception):
    """Base of all errors raised here."""


class ConfigError(MillError, ValueError):
    """A step's configuration is wrong; raised on the driver before anything runs."""


class SchemaError(MillError, ValueError):
    """A table lacks what an operator needs, or two tables don't fit together."""


class OperatorError(MillError):
    """An operator failed; the message names it."""


class PipelineError(MillError, ValueError):
    """A pipeline's structure is wrong."""
