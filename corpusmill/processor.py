"""Functions of single texts, for use without Spark columns around: each runs the operators' own code on a one-row table."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .functions.text import estimated_tokens, squeezed
from .operators import dedup, language, quality, redact


class TextProcessor:
    def __init__(self, spark: SparkSession):
        self.spark = spark

    def _one(self, text: str, run: Any) -> Any:
        c: Column = run(F.col("text"))
        return self.spark.createDataFrame([(text,)], "text string").select(c.alias("v")).first()["v"]

    def compute_simhash(self, text: str) -> int:
        return self._one(text, dedup.simhash64) % (1 << 64)

    def detect_language(self, text: str) -> str:
        return self._one(text, language.detect)

    def language_confidence(self, text: str) -> float:
        return self._one(text, language.confidence) or 0.0

    def redact_pii(self, text: str) -> str:
        return self._one(text, lambda c: redact.redact(c, redact.RULES, [])[0])

    def normalize_text(self, text: str, lowercase: bool = False) -> str:
        return self._one(text, lambda c: F.lower(squeezed(c)) if lowercase else squeezed(c))

    def quality_score(self, text: str) -> float:
        return self._one(text, lambda c: quality.weighted(quality.components(c)))

    def toxicity_score(self, text: str) -> float:
        return self._one(text, lambda c: quality.toxicity(c, quality.LEXICON))

    def count_tokens(self, text: str) -> int:
        return self._one(text, estimated_tokens)
