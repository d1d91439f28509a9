"""Whole-table inspection: metrics, profiles, statistics and differences. Tables out, so nothing large comes to the driver."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .dataset import Dataset, kind, quoted
from .functions.text import n_chars, n_words
from .operators.distribution import percentiles

PERCENTS = (25, 50, 75, 95, 99)


def leaves(schema: T.StructType, prefix: str = "") -> list[tuple[str, Column, T.DataType]]:
    """Every field that is no object, however deep, as (path, column, type)."""
    out = []
    for f in schema:
        path = f"{prefix}{f.name}"
        column = reduce(lambda c, p: c.getField(p), path.split("\0")[1:], quoted(path.split("\0")[0]))
        if isinstance(f.dataType, T.StructType):
            out += leaves(f.dataType, f"{path}\0")
        else:
            out.append((path.replace("\0", "."), column, f.dataType))
    return out


def _text(c: Column, dtype: T.DataType) -> Column:
    return F.to_json(c) if kind(dtype) in ("array", "object") else c.cast("string")


def metrics(ds: Dataset, quality_key: str = "quality", toxicity_key: str = "toxicity") -> DataFrame:
    """One row of figures over all records: sizes of the payload's JSON text, quality and toxicity, empty payloads."""
    text = F.coalesce(F.to_json(F.struct(*map(quoted, ds.payload))), F.lit("{}"))
    q, t = (F.coalesce(ds.meta_column(k).cast("double"), F.lit(0.0)) if k in ds.meta else F.lit(0.0) for k in (quality_key, toxicity_key))
    n = F.count(F.lit(1))
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return ds.df.select(n_chars(text).alias("chars"), n_words(text).alias("words"), q.alias("q"), t.alias("t"), (text == "{}").cast("int").alias("empty")).agg(
        n.alias("total_records"), mean("chars").alias("average_payload_chars"), mean("words").alias("average_payload_tokens"), mean("t").alias("toxicity_average"),
        F.coalesce(F.max("t"), F.lit(0.0)).alias("toxicity_max"), mean("q").alias("quality_score_average"), F.coalesce(F.sum("empty"), F.lit(0)).alias("empty_count"))


def profile(df: DataFrame, outliers: float = 3.0) -> DataFrame:
    """A row for each field: counts, distinct values, least and largest, mean and deviation, and how many values are anomalous.

    Distinct values are estimated (HyperLogLog++, 5 %). Anomalies: nulls if they are over a fifth, numbers further than
    outliers deviations from the mean, all texts if their lengths deviate by more than their mean.
    """
    fields = leaves(df.schema)
    numeric = lambda c, t: c.cast("double") if kind(t) in ("int", "float") else F.lit(None).cast("double")
    each = [F.struct(F.lit(p).alias("field"), F.lit(kind(t)).alias("type"), numeric(c, t).alias("x"), (n_chars(c) if kind(t) == "str" else F.lit(None).cast("bigint")).alias("len"), _text(c, t).alias("v")) for p, c, t in fields]
    rows = df.select(F.explode(F.array(*each)).alias("e")).select("e.*")
    first = rows.groupBy("field", "type").agg(
        F.count(F.lit(1)).alias("count"), F.count_if(F.col("v").isNull()).alias("null_count"), F.approx_count_distinct("v", 0.05).alias("unique_count"), F.min("x").alias("min"), F.max("x").alias("max"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"),
        F.min("len").alias("min_length"), F.max("len").alias("max_length"), F.avg("len").alias("avg_length"), F.stddev_pop("len").alias("std_length"), F.count("len").alias("texts"))
    numbers = [(p, c, t) for p, c, t in fields if kind(t) in ("int", "float")]
    if numbers:
        ends = first.filter("std > 0").select(F.col("field").alias("f"), F.col("mean").alias("m"), F.col("std").alias("s"))
        far = rows.filter("x is not null").join(F.broadcast(ends), F.col("field") == F.col("f")).filter(F.abs(F.col("x") - F.col("m")) > outliers * F.col("s"))
        first = first.join(far.groupBy(F.col("f")).agg(F.count(F.lit(1)).alias("outliers")), F.col("field") == F.col("f"), "left").drop("f")
    else:
        first = first.withColumn("outliers", F.lit(0))
    rate = F.col("null_count") / F.col("count")
    odd = F.when(rate > 0.2, F.col("null_count")).otherwise(0) + F.coalesce("outliers", F.lit(0)) + F.when(F.col("std_length") > F.col("avg_length"), F.col("texts")).otherwise(0)
    labels = F.array_compact(F.array(F.when(rate > 0.5, "high_null_rate").when(rate > 0.2, "elevated_null_rate"), F.when(F.coalesce("outliers", F.lit(0)) > 0, "numeric_outliers"), F.when(F.col("std_length") > F.col("avg_length"), "high_length_variance")))
    return first.withColumn("outliers", F.coalesce("outliers", F.lit(0))).withColumn("anomalies", labels).withColumn("anomalous", odd).drop("texts")


def summary(df: DataFrame, outliers: float = 3.0) -> DataFrame:
    """One row: records, repeated and empty ones, completeness, and a quality score of these and the anomalies."""
    whole = F.sha2(F.to_json(F.struct("*")), 256)
    counts = df.select(whole.alias("h"), (F.to_json(F.struct("*")) == "{}").cast("int").alias("e")).groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.sum("e").alias("e"))
    counts = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_records"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_count"), F.coalesce(F.sum("e"), F.lit(0)).alias("empty_count"))
    fields = profile(df, outliers).agg(F.coalesce(F.sum(F.col("count") - F.col("null_count")) / F.sum("count"), F.lit(0.0)).alias("completeness"), F.coalesce(F.avg(F.col("anomalous") / F.col("count")), F.lit(0.0)).alias("anomaly_rate"))
    n = F.col("total_records")
    score = 0.3 * F.col("completeness") + 0.25 * (1 - F.col("duplicate_count") / n) + 0.25 * (1 - F.col("empty_count") / n) + 0.2 * (1 - F.col("anomaly_rate"))
    return counts.crossJoin(F.broadcast(fields)).withColumn("quality_score", F.when(n > 0, F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))).otherwise(0.0))


def frequencies(df: DataFrame, field: str, k: int = 20) -> DataFrame:
    """(value, n): the commonest values of a column."""
    c = next(c for p, c, _ in leaves(df.schema) if p == field)
    return df.select(c.cast("string").alias("value")).filter("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(k)


def text_statistics(text: DataFrame, k: int = 50, gram: int = 2) -> dict[str, DataFrame]:
    """Of a column of texts: totals, characters, the commonest words, and character n-grams that come more than once."""
    (name,) = text.columns
    t = text.select(F.coalesce(quoted(name), F.lit("")).alias("t"))
    chars = F.regexp_extract_all("t", F.lit("(?s)."), F.lit(0))
    counted = lambda df: df.groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    starts = F.sequence(F.lit(1), F.greatest(F.char_length("t") - gram + 1, F.lit(1)))
    grams = t.filter(F.char_length("t") >= gram).select(F.explode(F.transform(starts, lambda i: F.substr("t", i, F.lit(gram)))).alias("x"))
    return {
        "totals": t.agg(F.coalesce(F.sum(n_chars(F.col("t"))), F.lit(0)).alias("chars"), F.coalesce(F.sum(n_words(F.col("t"))), F.lit(0)).alias("words")),
        "chars": counted(t.select(F.explode(chars).alias("x"))),
        "words": counted(t.select(F.explode(F.regexp_extract_all(F.lower("t"), F.lit(r"(?U)\S+"), F.lit(0))).alias("x"))).orderBy(F.desc("n"), "x").limit(k),
        "grams": counted(grams).filter("n > 1"),
    }


def statistics(df: DataFrame) -> DataFrame:
    """A row for each number and text among the fields: mean, population deviation, ends, percentiles by place floor(n p); lengths, empty and distinct texts."""
    out = []
    for path, c, t in leaves(df.schema):
        if kind(t) in ("int", "float"):
            one = df.select(c.cast("double").alias("x")).filter("x is not null")
            agg = one.agg(F.count("x").alias("count"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))
            at = percentiles(Dataset.of(one), "payload.x", PERCENTS).groupBy().agg(*(F.max(F.when(F.col("p") == p, F.col("value"))).alias(f"p{p}") for p in PERCENTS))
            row = agg.crossJoin(F.broadcast(at)).withColumn("empty", F.lit(None).cast("bigint")).withColumn("unique", F.lit(None).cast("bigint"))
        elif kind(t) == "str":
            one = df.select(c.alias("v"), n_chars(c).cast("double").alias("x")).filter("v is not null")
            agg = one.agg(F.count("x").alias("count"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"), F.count_if(F.col("x") == 0).alias("empty"), F.count_distinct("v").alias("unique"))
            row = agg.select("count", "mean", "std", "min", "max", *(F.lit(None).cast("double").alias(f"p{p}") for p in PERCENTS), "empty", "unique")
        else:
            continue
        out.append(row.select(F.lit(path).alias("field"), F.lit(kind(t)).alias("type"), "*"))
    return reduce(DataFrame.unionByName, out)


def statistic_summary(df: DataFrame, field: str) -> DataFrame:
    """One row of figures of a field's numbers: count, mean, population deviation, ends, median and percentiles by place.

    Of fewer than 4 numbers p25 and p75 are the largest, of fewer than 20 p95, of fewer than 100 p99; of none all is 0.
    """
    one = df.select(quoted(field).cast("double").alias("x")).filter("x is not null")
    agg = one.agg(F.count("x").alias("count"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std_dev"), F.min("x").alias("min"), F.max("x").alias("max"))
    at = percentiles(Dataset.of(one), "payload.x", PERCENTS).groupBy().agg(*(F.max(F.when(F.col("p") == p, F.col("value"))).alias(f"v{p}") for p in PERCENTS))
    guarded = [F.when(F.col("count") < least, F.col("max")).otherwise(F.col(f"v{p}")).alias(f"p{p}") for p, least in ((25, 4), (75, 4), (95, 20), (99, 100))]
    out = agg.crossJoin(F.broadcast(at)).select("count", "mean", "std_dev", "min", "max", F.col("v50").alias("median"), *guarded)
    return out.fillna(0.0)


def similarity(a: Column, b: Column, dtype: T.DataType) -> Column:
    """1 for equal values; of texts by edit distance, of arrays by common elements; else 0."""
    if kind(dtype) == "str":
        close = 1 - F.levenshtein(a, b) / F.greatest(F.char_length(a), F.char_length(b), F.lit(1))
    elif kind(dtype) == "array" and kind(dtype.elementType) not in ("object", "other"):
        close = F.when(F.size(F.array_union(a, b)) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))
    else:
        close = F.lit(0.0)
    return F.when(a.eqNullSafe(b), 1.0).otherwise(F.coalesce(close, F.lit(0.0)))


def diff(old: DataFrame, new: DataFrame, id: str) -> DataFrame:
    """(id, change, fields, similarity) of all records of two tables by their ids, which are unique: added, removed, modified or unchanged.

    fields: the columns that differ; similarity: the mean over all columns.
    """
    both = [c for c in old.columns if c in new.columns and c != id and old.schema[c].dataType == new.schema[c].dataType]
    others = [c for c in {*old.columns, *new.columns} - {*both, id}]
    a = old.select(quoted(id).alias("id"), F.struct(*map(quoted, old.columns)).alias("a"))
    b = new.select(quoted(id).alias("id2"), F.struct(*map(quoted, new.columns)).alias("b"))
    joined = a.join(b, F.col("id").eqNullSafe(F.col("id2")), "full")
    values = lambda c: (F.col("a").getField(c), F.col("b").getField(c))
    changed = [F.when(~values(c)[0].eqNullSafe(values(c)[1]), F.lit(c)) for c in sorted(both)] + [F.when(F.col("a" if c in old.columns else "b").getField(c).isNotNull(), F.lit(c)) for c in sorted(others)]
    fields = F.array_compact(F.array(*changed)) if changed else F.array().cast("array<string>")
    scores = [similarity(*values(c), old.schema[c].dataType) for c in both] + [F.lit(0.0)] * len(others)
    alike = sum(scores, F.lit(0.0)) / max(len(scores), 1) if scores else F.lit(1.0)
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.size(fields) > 0, "modified").otherwise("unchanged")
    two = F.col("a").isNotNull() & F.col("b").isNotNull()
    return joined.select(F.coalesce("id", "id2").alias("id"), change.alias("change"), F.when(two, fields).alias("fields"), F.when(two, alike).otherwise(0.0).alias("similarity"))


def diff_summary(changes: DataFrame) -> DataFrame:
    """One row: records by change, and a score: unchanged ones and half of the modified as a share of the larger table."""
    n = {c: F.count_if(F.col("change") == c).alias(c) for c in ("added", "removed", "modified", "unchanged")}
    out = changes.agg(*n.values())
    size = F.greatest(*(F.col("modified") + F.col("unchanged") + F.col(c) for c in ("added", "removed")))
    return out.withColumn("similarity_score", F.when(size > 0, (F.col("unchanged") + F.col("modified") / 2) / size).otherwise(1.0))


def field_changes(old: DataFrame, new: DataFrame) -> list[dict[str, Any]]:
    """Fields that were added or removed or have another type, from the schemas alone."""
    a, b = ({p: t.simpleString() for p, _, t in leaves(x.schema)} for x in (old, new))
    return [{"field": p, "old_type": a.get(p), "new_type": b.get(p)} for p in sorted({*a, *b}) if a.get(p) != b.get(p)]


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x, y, correlation) of all pairs of numeric columns, in one pass."""
    pairs = [(x, y) for i, x in enumerate(columns) for y in columns[i + 1 :]]
    row = df.agg(*(F.corr(quoted(x), quoted(y)).alias(f"{i}") for i, (x, y) in enumerate(pairs)))
    each = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"{i}").alias("correlation")) for i, (x, y) in enumerate(pairs)))
    return row.select(F.explode(each).alias("e")).select("e.*")

