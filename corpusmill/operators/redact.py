"""Redaction of personal data by rules, all as column expressions: no text leaves the JVM."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dataset import Dataset
from ..errors import ConfigError
from ..functions.text import let
from ..registry import Config, operator, option
from .filters import java_regex


@dataclass(frozen=True)
class Rule:
    tag: str
    pattern: str
    strategy: str = "placeholder"
    placeholder: str = ""
    mask_char: str = "*"
    prefix: int = 0
    suffix: int = 0
    salt: int = 0
    window: int = 0
    original: bool = False

    def replacement(self, m: Column) -> Column:
        if self.strategy == "placeholder":
            return F.lit(self.placeholder)
        n, p, s = F.char_length(m), self.prefix, self.suffix
        head, tail = F.substring(m, 1, p), F.right(m, F.lit(s))
        if self.strategy == "mask":
            middle = F.least(F.greatest(n - (p + s), F.lit(1)), F.lit(4))
            return F.when(n <= p + s, F.repeat(F.lit(self.mask_char), n)).otherwise(F.concat(head, F.repeat(F.lit(self.mask_char), middle), tail))
        inner = F.substr(m, F.lit(p + 1), F.greatest(n - (p + s), F.lit(0)))
        digest = F.substring(F.sha2(F.concat(F.lit(f"{self.salt}:"), m), 256), 1, 16)
        bare = F.regexp_extract(inner, r"^[^\p{IsAlphabetic}\p{N}]*", 0)
        rest = F.substr(inner, F.char_length(bare) + 1, F.char_length(inner))
        last = F.regexp_extract(rest, r"[^\p{IsAlphabetic}\p{N}]*$", 0)
        return F.concat(head, bare, F.lit("<"), digest, F.lit(">"), last, tail)


_GAP = "[- ]?"
_DIGIT = r"\p{Nd}"
RULES = [
    Rule("email", r"(?i)[%+\-.0-9_a-z]+@[\-.0-9a-z]+\.[a-z]{2,}", placeholder="<EMAIL>", window=12, original=True),
    Rule("phone", rf"\b(?:[+]?{_DIGIT}{{1,3}}{_GAP})?(?:[(]?{_DIGIT}{{2,4}}[)]?{_GAP})?{_DIGIT}{{7,12}}\b", "mask", prefix=2, suffix=2, window=6),
    Rule("card", rf"\b(?:{_DIGIT}{_GAP}){{13,19}}\b", "mask", mask_char="#", prefix=4, suffix=2, window=4),
    Rule("url", r"(?i)https?://[#%&./=?\w]+", placeholder="<URL>", window=16),
]


def _rule(config: Config) -> Rule:
    strategy = option(config, "strategy", "placeholder", str)
    if strategy not in ("placeholder", "mask", "hash"):
        raise ConfigError("strategy must be placeholder, mask or hash")
    tag = option(config, "tag", kinds=str)
    return Rule(tag, option(config, "pattern", kinds=str), strategy, option(config, "placeholder", f"<{tag.upper()}>", str), option(config, "mask_char", "*", str)[:1] or "*", option(config, "prefix", 2, int, 0), option(config, "suffix", 2, int, 0), option(config, "salt", 0, int), option(config, "context_window", 0, int, 0), option(config, "store_original", False, bool))


_LOG = "array<struct<tag:string,original:string,redacted:string,strategy:string,context:string>>"


def _replaced(rule: Rule) -> Callable[[Column, Column], Column]:
    return lambda text, m: F.replace(text, m, rule.replacement(m))


def _logged(rule: Rule, text: Column) -> Callable[[Column], Column]:
    shown = lambda m: m if rule.original else F.lit(None).cast("string")
    return lambda m: F.struct(F.lit(rule.tag).alias("tag"), shown(m).alias("original"), rule.replacement(m).alias("redacted"), F.lit(rule.strategy).alias("strategy"), _context(text, m, rule.window).alias("context"))


def redact(text: Column, rules: list[Rule], allowlist: list[str], logged: bool = True) -> tuple[Column, Column]:
    """(text, matches): each rule sees what the ones before it left. Each step is bound once, so plans grow with the rules.

    logged: whether matches are wanted; without them placeholders are one replacement each.
    """
    allowed = F.array(*(F.lit(a.strip().lower()) for a in allowlist)) if allowlist else None
    if not logged:
        for rule in rules:
            text = _without_log(rule, text, allowed)
        return text, F.array().cast(_LOG)
    state = F.struct(text.alias("text"), F.array().cast(_LOG).alias("log"))
    for rule in rules:
        state = let(state, _with_log(rule, allowed))
    return let(state, lambda s: s["text"]), let(state, lambda s: s["log"])


def _without_log(rule: Rule, text: Column, allowed: Column | None) -> Column:
    pattern = java_regex(rule.pattern)
    if rule.strategy == "placeholder" and allowed is None:
        return F.regexp_replace(text, pattern, rule.placeholder.replace("\\", "\\\\").replace("$", "\\$"))
    return let(text, lambda t: F.aggregate(_found(t, pattern, allowed), t, _replaced(rule)))


def _with_log(rule: Rule, allowed: Column | None) -> Callable[[Column], Column]:
    pattern = java_regex(rule.pattern)

    def step(s: Column) -> Column:
        def of(found: Column) -> Column:
            new = F.aggregate(found, s["text"], _replaced(rule))
            return F.struct(new.alias("text"), F.concat(s["log"], F.transform(found, _logged(rule, s["text"]))).alias("log"))

        return F.when(s["text"].rlike(pattern), let(_found(s["text"], pattern, allowed), of)).otherwise(s)

    return step


def _found(text: Column, pattern: str, allowed: Column | None) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if allowed is None:
        return found
    low = lambda m: F.lower(F.btrim(m))
    return F.filter(found, lambda m: ~F.array_contains(allowed, low(m)) & ~F.arrays_overlap(F.split(low(m), r"\s+"), allowed))


def _context(text: Column, m: Column, window: int) -> Column:
    """What stands around the first occurrence."""
    if not window:
        return F.lit(None).cast("string")
    at = F.position(m, text)
    start = F.greatest(at - window, F.lit(1))
    return F.substr(text, start, at - start + F.char_length(m) + window)


@operator("pii.redact", row_wise=True)
def pii_redact(ds: Dataset, config: Config) -> Dataset:
    """E-mail addresses, phone and card numbers and URLs, and what custom rules find, are replaced; store_key names metadata for a log.

    The four usual rules come first, then custom ones; an allowed value, or one with an allowed word, stays.
    """
    path = option(config, "path", kinds=str)
    rules = [*RULES, *map(_rule, option(config, "custom", [], list))]
    allowlist = [a for a in option(config, "allowlist", [], list) if isinstance(a, str)]
    store, c = option(config, "store_key", None, str), ds.text(path)
    if c is None:
        return ds
    text, matches = redact(c, rules, allowlist, store is not None)
    if store:
        ds = ds.put_meta(store, F.when(c.isNotNull(), matches))
    return ds.put(path, text)
