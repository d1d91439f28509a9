"""Text as column expressions. White space and letters are Unicode's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"(?U)\S+"
SPACE = r"(?U)\s+"
CJK = "[一-鿿]"


def n_chars(c: Column) -> Column:
    return F.char_length(c).cast("bigint")


def n_words(c: Column) -> Column:
    """Runs without white space."""
    return F.regexp_count(c, F.lit(WORD)).cast("bigint")


def n_cjk(c: Column) -> Column:
    return F.regexp_count(c, F.lit(CJK)).cast("bigint")


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeezed(c: Column) -> Column:
    """Trimmed, each run of white space as one space."""
    return F.btrim(F.regexp_replace(c, SPACE, " "))


def estimated_tokens(c: Column) -> Column:
    """1.3 a word and 0.6 a CJK character, where two of these count as a word less; 1 at least."""
    cjk = n_cjk(c)
    other = F.greatest(n_words(c) - F.floor(cjk / 2), F.lit(0).cast("bigint"))
    return F.greatest(F.ceil(cjk * 0.6 + other * 1.3), F.lit(1)).cast("bigint")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often use names it."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))
