"""The operators; importing this registers all of them."""

from . import augment, dedup, distribution, fields, filters, language, merge, metadata, prompts, quality, redact, sample, shuffle, split, tokens, transforms

__all__ = ["augment", "dedup", "distribution", "fields", "filters", "language", "merge", "metadata", "prompts", "quality", "redact", "sample", "shuffle", "split", "tokens", "transforms"]
