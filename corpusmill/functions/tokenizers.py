"""Token counts by tokenizers: white space, characters, words, and byte-pair encodings from vocabulary files."""

from __future__ import annotations

import base64
from functools import cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ConfigError
from .text import n_chars, n_cjk, n_words

ENCODINGS = ("cl100k_base", "p50k_base", "p50k_edit", "r50k_base", "o200k_base")
_NAMES = {n.replace("_", ""): n for n in (*ENCODINGS, "whitespace", "character", "word")}
_SPLITS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def name_of(tokenizer: str) -> str:
    """Cl100kBase and cl100k_base are the same."""
    key = tokenizer.replace("_", "").lower()
    if key not in _NAMES:
        raise ConfigError(f"unknown tokenizer {tokenizer!r}")
    return _NAMES[key]


@cache
def _encoding(name: str, vocabulary: str | None):
    import tiktoken

    if vocabulary is None:
        return tiktoken.get_encoding(name)
    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(t): int(n) for t, n in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(vocabulary, pat_str=_SPLITS, mergeable_ranks=ranks, special_tokens={})


def counted(text: Column, tokenizer: str, vocabulary: str | None = None) -> Column:
    """The number of tokens. A byte-pair encoding takes its ranks from the file at vocabulary, else from what tiktoken has; it fails if neither is there."""
    name = name_of(tokenizer)
    if name == "whitespace":
        return n_words(text)
    if name == "character":
        return n_chars(text)
    if name == "word":
        return n_words(text) + n_cjk(text)
    try:
        _encoding(name, vocabulary)
    except Exception as e:
        raise ConfigError(f"no vocabulary for {name}: pass vocabulary, the path of a file of ranks that every executor can read ({e})") from e

    @F.arrow_udf("bigint")
    def run(texts: pa.Array) -> pa.Array:
        encoding = _encoding(name, vocabulary)
        return pa.array([None if t is None else len(encoding.encode_ordinary(t)) for t in texts.to_pylist()], pa.int64())

    return run(text)
