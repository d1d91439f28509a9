"""Operator 9: a quality rule: hashed word and character n-gram logistic regression.

It is trained on the driver on a bounded sample of labelled rows, calibrated on a third of it that training doesn't see,
with texts and features in mapped files, so that long texts take no more of the driver's memory; it scores every document in Arrow batches against fixed thresholds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, slices, spooled, table, where
from .ngrams import TextModel, features, fit_sparse, platt

KEEP, SURE = 0.5, 0.9
MAX_LABELLED = 4000


def labelled(docs: DataFrame, labels: DataFrame, bound: int, *columns: str) -> pa.Table:
    """At most bound labelled documents, those whose ids hash lowest: (doc_id, quality, *columns). Blank texts have no
    features and aren't used; of several texts with one id the one that hashes lowest is. The table is a file that is mapped
    into memory: read it in batches."""
    known = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.avg("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    rows = docs.filter(F.col("text").rlike(r"\S")).select(F.col("doc_id").cast("bigint").alias("doc_id"), *columns)
    one = F.min(F.struct(F.xxhash64("text").alias("h"), *columns, "quality")).alias("one")
    rows = rows.join(known, "doc_id").groupBy("doc_id").agg(one).select("doc_id", "one.quality", *(f"one.{c}" for c in columns))
    return spooled(rows.orderBy("doc_id"))


def halves(ids: np.ndarray, part: int = 3) -> np.ndarray:
    """Which rows are kept for calibration: one in part, by id."""
    return mix(ids.astype(np.uint64)) % np.uint64(part) == 0


def train(rows: pa.Table) -> TextModel | None:
    """The calibrated model; None without rows of both classes in both parts."""
    if not rows.num_rows:
        return None
    y = (rows.column("quality").to_numpy() >= 0.5).astype(float)
    held = halves(rows.column("doc_id").to_numpy())
    if any(len(np.unique(y[part])) < 2 for part in (held, ~held)):
        return None
    model = TextModel(*fit_sparse([features(part.column("text") for part in where(rows, ~held))], y[~held]))
    model.weights = model.weights.astype(np.float32)
    model.a, model.b = platt(np.concatenate([model.score(part.column("text")) for part in where(rows, held)]), y[held])
    return model


def score(docs: DataFrame, labels: DataFrame, keep: float = KEEP, sure: float = SURE, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Rows (doc_id, p_quality, keep, sure), one for each row of docs: the probability of good quality, whether it is at
    least keep, and whether the verdict has a probability of at least sure.

    max_labelled bounds the labelled rows that are used, two thirds for training, a third for calibration.
    Null cases: null or blank texts have a null probability and aren't kept; null ids are scored and stay null; labels
    with a null id or quality are left out, repeated ones averaged; without labels of both classes there is no rule: the
    probability is null and every text that isn't blank is kept. Rows are scored apart from each other, so repeated ones
    agree, and so do ties; texts are read whole, however long. An empty table gives an empty one. Other columns are not
    read.
    """
    spark = docs.sparkSession
    model = train(labelled(docs, labels, max_labelled, "text"))
    shared = spark.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule = shared.value
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text")
                blank = np.array([not (x and x.strip()) for x in texts.to_pylist()], bool)
                p = rule.probability(texts) if rule else np.full(len(blank), np.nan)
                ok = ~blank & ((p >= keep) if rule else True)
                p = pa.array(p, mask=blank | np.isnan(p))
                firm = np.nan_to_num(np.maximum(p.to_numpy(zero_copy_only=False), 1 - p.to_numpy(zero_copy_only=False)), nan=0.0) >= sure
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), p, pa.array(ok), pa.array(firm)], names=["doc_id", "p_quality", "keep", "sure"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(apply, "doc_id bigint, p_quality double, keep boolean, sure boolean")


def probability(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Column:
    """The probability of good quality of docs' column text, fitted on docs and labels as by score(); null where score() gives null."""
    shared = docs.sparkSession.sparkContext.broadcast(train(labelled(docs, labels, max_labelled, "text")))

    @F.arrow_udf("double")
    def p(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out = [pa.array([], pa.float64())]
            for part in slices(pa.RecordBatch.from_arrays([texts], names=["text"])):
                text = part.column("text")
                blank = np.array([not (x and x.strip()) for x in text.to_pylist()], bool)
                out.append(pa.array(shared.value.probability(text) if shared.value else np.zeros(len(blank)), mask=blank | (shared.value is None)))
            yield pa.concat_arrays(out)

    return p(F.col("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir), table(spark, sf_dir, "labels"))
