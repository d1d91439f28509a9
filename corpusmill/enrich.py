"""Synthetic records, annotation and augmented copies."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .dataset import Dataset, kind, literal, quoted
from .errors import ConfigError
from .functions.ranks import hash_key, uniform
from .operators.augment import coin
from .registry import NUMBER, get, option

LOWER = "abcdefghijklmnopqrstuvwxyz"


def _hash(seed: int, name: str, index: Column) -> Column:
    return hash_key(f"{seed}:{name}", index.cast("string"))


def rule(name: str, kind: str, options: Mapping[str, Any], index: Column, seed: int) -> Column:
    """A column made by a rule from the row's number."""
    h = _hash(seed, name, index)
    u = uniform(h)
    if kind == "RandomInt":
        low, high = option(options, "min", kinds=int), option(options, "max", kinds=int)
        return (F.floor(u * (high - low + 1)) + low).cast("bigint")
    if kind == "RandomFloat":
        low, high = option(options, "min", kinds=NUMBER), option(options, "max", kinds=NUMBER)
        return F.round(u * (high - low) + low, option(options, "precision", 6, int, 0))
    if kind == "RandomString":
        chars = option(options, "charset", LOWER, str)
        if not chars:
            raise ConfigError("an empty charset")
        pick = lambda i: F.substr(F.lit(chars), (F.floor(coin(f"{seed}:{name}", index.cast("string"), i) * len(chars)) + 1).cast("int"), F.lit(1))
        n = option(options, "length", 10, int, 0)
        return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), pick), "") if n else F.lit("")
    if kind == "RandomChoice":
        values = option(options, "options", kinds=list)
        if not values:
            raise ConfigError("no options to choose from")
        return F.get(F.array(*map(literal, values)), F.floor(u * len(values)).cast("int"))
    if kind == "RandomBool":
        return u < float(option(options, "probability", 0.5, NUMBER))
    if kind == "Sequence":
        return (index * option(options, "step", 1, int) + option(options, "start", 0, int)).cast("bigint")
    if kind == "UUID":
        return h
    if kind == "RandomDate":
        low, high = option(options, "start", "2024-01-01", str), option(options, "end", "2024-01-01", str)
        days = F.datediff(F.lit(high).cast("date"), F.lit(low).cast("date"))
        return F.date_format(F.date_add(F.lit(low).cast("date"), F.floor(u * (days + 1)).cast("int")), "yyyy-MM-dd")
    if kind == "Regex":
        return F.lit("generated_text")
    if kind == "Faker":
        return F.lit(f"fake_{option(options, 'faker_type', kinds=str)}")
    if kind == "Transform":
        return F.lit(f"{option(options, 'source_field', kinds=str)}:{option(options, 'transform', kinds=str)}")
    raise ConfigError(f"unknown rule {kind!r}")


def template(text: str, variables: Mapping[str, Any], index: Column, seed: int) -> Column:
    """The text with {{index}}, {{random}} and {{uuid}} and variables filled in."""
    h = _hash(seed, "template", index)
    out = F.replace(F.lit(text), F.lit("{{index}}"), index.cast("string"))
    out = F.replace(out, F.lit("{{random}}"), F.floor(uniform(h) * (1 << 32)).cast("bigint").cast("string"))
    out = F.replace(out, F.lit("{{uuid}}"), h)
    for key, value in variables.items():
        out = F.replace(F.replace(out, F.lit("{{" + key + "}}"), F.lit(str(value))), F.lit("{" + key + "}"), F.lit(str(value)))
    return out


@dataclass(frozen=True)
class Synthesizer:
    """Records from a template, from rules, from both, or from a model that complete() asks."""

    count: int
    mode: str = "template"
    template: str = "{{text}}"
    variables: Mapping[str, Any] = field(default_factory=dict)
    #: {field: (rule, options)}
    rules: Mapping[str, tuple[str, Mapping[str, Any]]] = field(default_factory=dict)
    seed: int = 42
    id_prefix: str = ""
    complete: Callable[[list[str]], list[str]] | None = None

    def run(self, spark: SparkSession) -> Dataset:
        if self.mode not in ("template", "rule", "hybrid", "llm"):
            raise ConfigError(f"unknown mode {self.mode!r}")
        if self.mode == "hybrid":
            half = self.count // 2
            a, b = self._some(spark, "template", half, "hybrid_template"), self._some(spark, "rule", self.count - half, "hybrid_rule")
            return get("merge.concat")(a, {"inputs": [b]})
        return self._some(spark, self.mode, self.count, self.mode)

    def _some(self, spark: SparkSession, mode: str, n: int, name: str) -> Dataset:
        i = F.col("index")
        rows = spark.range(n).select(F.col("id").alias("index"))
        ident = F.concat(F.lit(f"{self.id_prefix}synth_{name}_" if not name.startswith("hybrid") else f"{self.id_prefix}{name}_"), i.cast("string")).alias("id")
        if mode == "rule":
            df = rows.select("index", ident, *(rule(f, k, o, i, self.seed).alias(f) for f, (k, o) in self.rules.items()))
        else:
            df = rows.select("index", ident, template(self.template, self.variables, i, self.seed).alias("text"))
        if mode == "llm":
            if self.complete is None:
                raise ConfigError("llm needs complete, a function from prompts to texts")
            ask = self.complete

            @F.arrow_udf("string")
            def answered(prompts: Iterator[pa.Array]) -> Iterator[pa.Array]:
                for batch in prompts:
                    yield pa.array(ask(batch.to_pylist()), pa.string())

            df = df.withColumn("text", answered("text"))
        return Dataset(df, "id", "index", {}, frozenset(["id", "index"]))

    def extend(self, ds: Dataset) -> Dataset:
        """The dataset, and the new records after it."""
        return get("merge.concat")(ds, {"inputs": [self.run(ds.df.sparkSession)]})


def annotate(ds: Dataset, style: str, name: str) -> Dataset:
    """Label: name_auto under label_name. Score: the payload's texts' bytes in thousands, 1 at most. Tag: [name_tagged]."""
    if style == "Label":
        return ds.put_meta(f"label_{name}", F.lit(f"{name}_auto"))
    if style == "Tag":
        return ds.put_meta(f"tag_{name}", F.array(F.lit(f"{name}_tagged")))
    if style != "Score":
        raise ConfigError("style must be Label, Score or Tag")
    texts = [quoted(c) for c in sorted(ds.payload) if kind(ds.df.schema[c].dataType) == "str"]
    return ds.put_meta(f"score_{name}", F.least(F.octet_length(F.concat_ws(" ", *texts)) / 1000, F.lit(1.0)))


def augment(ds: Dataset, methods: Sequence[tuple[str, Mapping[str, Any]]], keep: bool = True, seed: int = 42) -> Dataset:
    """Copies by each method, after the rows themselves if keep: Shuffle, Duplicate {count}, Noise {ratio, path}.

    Metadata augmented and augmentation_method mark a copy, and its id ends in the method if ids are texts. Noise drops
    characters with probability ratio.
    """
    parts = [ds] if keep else []
    for method, o in methods:
        name = method.lower()
        if method == "Duplicate":
            df = ds.df.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(option(o, "count", 1, int, 1) - 1))))
            new = ds.on(df)
            tail = F.concat(F.lit("_dup_"), F.col("_copy").cast("string"))
        elif method in ("Shuffle", "Noise"):
            new = get("shuffle.deterministic")(ds, {"seed": seed}) if method == "Shuffle" else ds
            tail = F.lit("_shuf" if method == "Shuffle" else "_noise")
        else:
            raise ConfigError(f"unknown method {method!r}")
        if method == "Noise":
            path, ratio = option(o, "path", "payload.text", str), float(option(o, "ratio", 0.1, NUMBER))
            c = ds.text(path)
            if c is not None:
                new = new.put(path, _thinned(c, ds.key(), ratio, seed))
        new = new.put_meta("augmented", F.lit(True)).put_meta("augmentation_method", F.lit(name))
        if ds.id and kind(ds.df.schema[ds.id].dataType) == "str":
            new = new.on(new.df.withColumn(ds.id, F.concat(quoted(ds.id), tail)))
        parts.append(new.on(new.df.drop("_copy")))
    if not parts:
        raise ConfigError("nothing to make")
    return get("merge.concat")(parts[0], {"inputs": parts[1:]}) if len(parts) > 1 else parts[0]


def _thinned(text: Column, key: Column, ratio: float, seed: int) -> Column:
    chars = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    return F.array_join(F.filter(chars, lambda _, i: coin(f"{seed}:noise", key, i) >= ratio), "")
