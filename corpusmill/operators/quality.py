"""Text quality and toxicity."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dataset import Dataset, kind
from ..errors import ConfigError
from ..functions import kernels
from ..registry import NUMBER, Config, operator, option

WEIGHTS = dict(zip(kernels.QUALITY, (0.20, 0.15, 0.15, 0.15, 0.10, 0.08, 0.08, 0.05, 0.03, 0.01), strict=True))
LEXICON = [(phrase, weight) for weight, phrases in ((0.6, "stupid,idiot"), (0.7, "violence,shut up"), (0.8, "hate,abuse"), (0.9, "terrible person"), (1.0, "kill")) for phrase in phrases.split(",")]
NEGATIONS = frozenset("ain't hardly never no not without".split())
_PARTS = pa.struct([(c, pa.float64()) for c in kernels.QUALITY])


def components(text: Column) -> Column:
    """A struct of what the score is made of."""
    run = kernels.by_slice(kernels.quality, _PARTS)

    @F.arrow_udf("struct<" + ",".join(f"{c}:double" for c in kernels.QUALITY) + ">")
    def measured(texts: pa.Array) -> pa.Array:
        return run(texts)

    return measured(text)


def weighted(parts: Column, weights: dict[str, float] | None = None) -> Column:
    w = {**WEIGHTS, **(weights or {})}
    score = sum((parts.getField(c) * float(w[c]) for c in kernels.QUALITY), F.lit(0.0))
    return F.least(F.greatest(F.when(F.isnan(score), 0.0).otherwise(score), F.lit(0.0)), F.lit(1.0))


@operator("quality.score", row_wise=True)
def score(ds: Dataset, config: Config) -> Dataset:
    """A score from 0 to 1 as metadata, and its components if details_key is given; rows without text get none."""
    c, key = ds.text(option(config, "path", kinds=str)), option(config, "key", "quality", str)
    details, weights = option(config, "details_key", None, str), option(config, "weights", {}, dict)
    if not set(weights) <= set(WEIGHTS) or any(isinstance(v, bool) or not isinstance(v, NUMBER) for v in weights.values()):
        raise ConfigError(f"weights are numbers for {sorted(WEIGHTS)}")
    if c is None:
        return ds
    out = ds.put_meta(details or "_parts", components(c))
    parts = out.meta_column(details or "_parts")
    out = out.put_meta(key, F.when(c.isNotNull(), weighted(parts, weights)))
    return out if details else out.drop_meta("_parts")


@operator("quality.filter", row_wise=True)
def quality_filter(ds: Dataset, config: Config) -> Dataset:
    """Rows whose metadata number is at least min; those without one go."""
    key, least = option(config, "key", "quality", str), option(config, "min", kinds=NUMBER)
    c = ds.meta_column(key)
    if c is None or kind(ds.df.schema[ds.meta[key]].dataType) not in ("int", "float"):
        return ds.where(F.lit(False))
    return ds.where(c >= least)


_LEET = str.maketrans("0123456789", "oizeasgtbg")


def _plain(token: str) -> str:
    """Letters instead of look-alike digits, ASCII only."""
    return token if token.isascii() and token.isalpha() else "".join(c for c in token.translate(_LEET) if c.isascii() and c.isalnum())


def toxic_score(text: str, terms: dict[str, list[tuple[tuple[str, ...], float]]], size: int) -> float:
    """terms: by their first word, (words, weight)."""
    words = kernels.tokens(text)
    if not words:
        return 0.0
    seen: dict[str, str] = {}
    plain = [seen[w] if w in seen else seen.setdefault(w, _plain(w)) for w in words]
    weight, matches = 0.0, 0
    if not terms.keys().isdisjoint(seen.values()):
        for i, w in enumerate(plain):
            for term, value in terms.get(w, ()):
                if tuple(plain[i : i + len(term)]) != term:
                    continue
                if i and words[i - 1] in NEGATIONS:
                    value *= 0.4
                elif i > 1 and words[i - 2] in NEGATIONS:
                    value *= 0.7
                weight, matches = weight + value, matches + 1
    raw = text.split()
    loud = sum(1 for w in raw if w == w.upper() and any(map(str.isalpha, w)))
    emphasis = min(0.5 * loud / max(len(raw), 1) + min(text.count("!"), 6) / 6 * 0.3, 0.8)
    return min(1.0, 0.6 * min(weight / max(size, 1), 1) + 0.25 * min(matches / len(words), 1) + 0.15 * emphasis)


def toxicity(text: Column, lexicon: list[tuple[str, float]]) -> Column:
    terms: dict[str, list[tuple[tuple[str, ...], float]]] = {}
    for phrase, weight in lexicon:
        words = tuple(map(_plain, kernels.tokens(phrase)))
        if words:
            terms.setdefault(words[0], []).append((words, weight))
    size = len(lexicon)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else toxic_score(t, terms, size) for t in texts.to_pylist()], pa.float64())

    return scored(text)


@operator("quality.toxicity", row_wise=True)
def quality_toxicity(ds: Dataset, config: Config) -> Dataset:
    """A score from 0 to 1 as metadata: matches of the lexicon, less where negated, and shouting."""
    c, key = ds.text(option(config, "path", kinds=str)), option(config, "key", "toxicity", str)
    lexicon = LEXICON
    if "lexicon" in config:
        entries = option(config, "lexicon", kinds=list)
        if not entries:
            raise ConfigError("an empty lexicon")
        lexicon = [(option(e, "word", kinds=str), float(option(e, "weight", 1.0, NUMBER))) for e in entries]
    return ds.put_meta(key, toxicity(c, lexicon)) if c is not None else ds
