"""Reading and writing datasets."""

from .formats import Format, detect
from .readers import read, read_envelope
from .writers import write, write_envelope

__all__ = ["Format", "detect", "read", "read_envelope", "write", "write_envelope"]
