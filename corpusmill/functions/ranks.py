"""Ranks over whole tables without a sort in one partition.

A rank by a hash is found in cells: the hash's first digits. Counts per cell (a few thousand rows) say how many rows
come before a cell, and rows are numbered within their cell alone. So groups of any size are spread over all executors.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import written

CELLS = 3


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names that no column has."""
    tag = uuid.uuid5(uuid.NAMESPACE_OID, "|".join(df.columns)).hex[:6]
    return [f"_{n}_{tag}" for n in names]


def hash_key(seed: int | str, key: Column) -> Column:
    """The hexadecimal md5 of seed:key: the same order wherever it is computed."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key))


def uniform(key: Column) -> Column:
    """A number in (0, 1) from a hexadecimal hash."""
    return (F.conv(F.substring(key, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def ranked(df: DataFrame, key: Column, tie: Sequence[Column], by: Sequence[Column] = (), rank: str = "rank", total: str | None = None, cells: int = CELLS) -> DataFrame:
    """df with each row's rank from 0 by its hexadecimal key, whose first digits are its cell, then tie, within by; and by's number of rows, if named."""
    k, c, n, before, t, *g = unused(df, "key", "cell", "n", "before", "total", *(f"by{i}" for i in range(len(by))))
    keyed = df.withColumns({k: key} | dict(zip(g, by, strict=True))).withColumn(c, F.substring(F.col(k), 1, cells))
    counts = keyed.groupBy(*g, c).agg(F.count("*").alias(n))
    each = W.partitionBy(*g) if g else W.partitionBy(F.lit(0))
    counts = counts.withColumn(before, F.coalesce(F.sum(n).over(each.orderBy(c).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn(t, F.sum(n).over(each))
    renamed = {x: x + "r" for x in (*g, c)}
    counts = counts.drop(n).withColumnsRenamed(renamed)
    same = F.col(c) == F.col(renamed[c])
    for x in g:
        same &= F.col(x).eqNullSafe(F.col(renamed[x]))
    out = keyed.join(counts, same)
    within = F.row_number().over(W.partitionBy(*g, c).orderBy(k, *tie))
    out = out.withColumn(rank, (F.col(before) + within - 1).cast("bigint"))
    if total:
        out = out.withColumn(total, F.col(t).cast("bigint"))
    return out.drop(k, before, t, *g, c, *renamed.values())


def numbered(df: DataFrame, order: Sequence[Column], number: str = "number", total: str | None = None) -> DataFrame:
    """df with each row's number from 0 in the order given, and the number of rows, if named.

    Rows are sorted by range, and the ranges' counts are summed; a table in the shared folder fixes the ranges.
    """
    p, n, before, t, q = unused(df, "range", "n", "before", "total", "r")
    fixed = written(df.repartitionByRange(*order).withColumn(p, F.spark_partition_id()), "numbered")
    counts = fixed.groupBy(F.col(p).alias(q)).agg(F.count("*").alias(n))
    counts = counts.select(q, F.coalesce(F.sum(n).over(W.partitionBy(F.lit(0)).orderBy(q).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(before), F.sum(n).over(W.partitionBy(F.lit(0))).alias(t))
    out = fixed.join(counts, F.col(p) == F.col(q))
    out = out.withColumn(number, (F.col(before) + F.row_number().over(W.partitionBy(p).orderBy(*order)) - 1).cast("bigint"))
    if total:
        out = out.withColumn(total, F.col(t).cast("bigint"))
    return out.drop(p, q, before, t)
