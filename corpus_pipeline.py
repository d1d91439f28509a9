"""The training-data pipeline over documents: each stage's result is a table that the next one reads.

A stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of documents, the last one the packs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import table, written
from corpusmill.llm.cotraining import keep_good
from corpusmill.llm.lines import line_dedup
from corpusmill.llm.mixing import mix_sources
from corpusmill.llm.packing import pack
from corpusmill.llm.quality_rules import probability
from corpusmill.llm.simhash import near_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of good quality is at least a half, in all their rows.

    Null and blank texts go; null ids and metadata are scored like others; repeated rows stay or go together; without
    labels of both classes every text that isn't blank stays; an empty table gives an empty one, with all its columns.
    """
    return keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the blocks of lines that earlier ones have; those that lose every line go. n_chars follows the text.

    Null and blank texts stay as they are; of two documents the one of larger id loses, null last, ties by a hash; rows
    that are equal in id and text lose the same; an empty table gives an empty one; other columns pass through.
    """
    out = line_dedup(docs, drop_emptied=True)
    return out.select(*(F.length("text").cast(out.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies, the one of least id, null last, ties by a hash.

    Null and blank texts are no copies and stay; of repeated rows one stays; an empty table gives an empty one; other
    columns pass through.
    """
    return near_dedup(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many tokens as there are, shared among sources by the square roots of their sizes; a row for each time a document is taken.

    Within a source documents are drawn by their probability of good quality. Null and blank texts go; a null source is a
    source of its own; repeated rows are drawn as often as each other or in order of a hash; without labels the weight is a
    rule of the text; an empty table gives an empty one; other columns pass through.
    """
    labels = table(spark, sf_dir, "labels")
    known = labels.filter("doc_id is not null and quality is not null").limit(1).count()
    # fitted on documents as they were: the stages before leave too few of the bad ones
    return mix_sources(docs, weight=probability(table(spark, sf_dir), labels) if known else None)


def packs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(pack_id, slot, doc_id, start_token, end_token, n_tokens).

    Texts without tokens are in no pack; null ids are packed; repeated rows are each packed; an empty table gives none.
    """
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("SimHash near-dedup", near_copies),
    ("mixing sources to target weights", mixture),
    ("packing", packs),
]
#: A trained classifier, an alignment and a space-filling curve can't be written in SQL; tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{i}")
    return docs
