"""Pipelines and windows over streams."""

from .streams import apply, by_batch, first_seen, window_counts

__all__ = ["apply", "by_batch", "first_seen", "window_counts"]
