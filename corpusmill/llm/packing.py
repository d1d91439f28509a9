"""Operator 6: packing along a space-filling curve.

A document's words are hashed into a vector of counts, whose direction is projected to three dimensions; the cell in
which it lies has a place on the Hilbert curve. Documents are range-sorted by that place, and neighbours are packed
together into sequences of a fixed number of tokens.

At scale: only (place, id, tokens) move. Sums of tokens over range partitions and then within them give every document
its offset along the curve; offsets cut the curve into regions of 1024 packs, which are packed apart from each other, so
the result is the same however the rows were partitioned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import slices, table, text_bytes, tie_key, word_hashes, words, written

DIMS, BUCKETS, BITS, REGION = 3, 512, 20, 1024


def projection(seed: int = 6) -> np.ndarray:
    r = np.random.default_rng(seed).standard_normal((BUCKETS, DIMS))
    return r / np.linalg.norm(r, axis=0)


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The place of each cell (a row of integers below 2**bits) on the Hilbert curve through all of them."""
    x = cells.T.astype(np.int64).copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # Skilling's transform: undo the turns and reflections of each level
        p = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(on, p, 0) ^ swap
            x[i] ^= swap if i else 0
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where(x[n - 1] & q, q - 1, 0)
        q >>= 1
    x ^= t
    out = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | (x[i] >> b & 1)
    return out


def places(texts: pa.Array, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: the number of its words and its place on the curve."""
    buf, starts = text_bytes(pa.compute.utf8_lower(texts))
    begin, end, doc = words(buf, starts)
    n = len(starts) - 1
    count = np.bincount(doc, minlength=n)
    bucket = (word_hashes(buf, begin, end) >> np.uint64(40)).astype(np.int64) % BUCKETS
    vectors = np.bincount(doc * BUCKETS + bucket, minlength=n * BUCKETS).reshape(n, BUCKETS)
    at = np.zeros((n, DIMS))
    some = count > 0
    at[some] = (vectors[some] / np.linalg.norm(vectors[some], axis=1, keepdims=True)) @ axes
    cells = np.clip(((at + 1) / 2 * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)
    return count, hilbert(cells)


def fill(tokens: np.ndarray, capacity: int, open_packs: int) -> Iterator[tuple[int, int, int, int]]:
    """First fit in the given order: (document, pack, first token, end). A document longer than a pack fills whole packs first."""
    last, room = -1, {}
    for i, n in enumerate(map(int, tokens)):
        at = 0
        while n - at >= capacity:
            last += 1
            yield i, last, at, at + capacity
            at += capacity
        if n == at:
            continue
        pack = next((p for p, r in room.items() if r >= n - at), None)
        if pack is None:
            last += 1
            pack, room[last] = last, capacity
            if len(room) > open_packs:
                del room[min(room, key=lambda p: (room[p], p))]
        yield i, pack, at, n
        room[pack] = room.get(pack, capacity) - (n - at)
        if room[pack] <= 0:
            del room[pack]


def pack(docs: DataFrame, capacity: int = 2048, open_packs: int = 16) -> DataFrame:
    """Rows (pack_id, slot, doc_id, start_token, end_token, n_tokens): the parts of documents in each pack, in order.

    Tokens are runs of non-space characters; a document that fits into a pack is never cut, and a longer one fills packs
    of its own before its rest is packed like a document. A pack never holds more than its capacity.
    Null cases: rows without tokens (null or blank texts) are in no pack; null ids are packed and come out as null;
    ids of any size come out as they are; repeated rows are each packed; ties on the curve are in order of id and a hash
    of id and text; texts are read whole, however long. An empty table gives an empty one; columns other than doc_id and
    text are not read.
    """
    axes = projection()

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                n, h = places(part.column("text"), axes)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("k"), pa.array(n, pa.int64()), pa.array(h, pa.int64())], names=["doc_id", "k", "n", "h"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", tie_key().alias("k")).mapInArrow(sketch, "doc_id bigint, k bigint, n bigint, h bigint").filter("n > 0")
    # the table fixes each row's range partition for both uses
    ranged = written(rows.repartitionByRange("h", "doc_id", "k").withColumn("pid", F.spark_partition_id()), "curve")
    sums = ranged.groupBy("pid").agg(F.sum("n").alias("n"))
    offsets = sums.select(F.col("pid").alias("p"), F.coalesce(F.sum("n").over(W.orderBy("pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    run = F.sum("n").over(W.partitionBy("pid").orderBy("h", "doc_id", "k").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
    placed = ranged.withColumn("run", run).join(offsets, F.col("pid") == F.col("p")).select("doc_id", "k", "n", "h", (F.col("offset") + F.col("run")).alias("at"))
    placed = placed.withColumn("region", F.floor(F.col("at") / (REGION * capacity)))

    names = ["pack_id", "slot", "doc_id", "start_token", "end_token", "n_tokens"]

    def packs(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("at").combine_chunks()
        i, no, start, end = np.array(list(fill(rows.column("n").to_numpy(), capacity, open_packs)), np.int64).reshape(-1, 4).T
        by = np.argsort(no, kind="stable")
        first = np.concatenate(([True], no[by][1:] != no[by][:-1]))
        slot = np.empty(len(no), np.int64)
        slot[by] = np.arange(len(no)) - np.repeat(np.flatnonzero(first), np.diff(np.append(np.flatnonzero(first), len(no))))
        region = rows.column("region")[0].as_py()
        return pa.table([pa.array((region << 24) + no), pa.array(slot), rows.column("doc_id").take(pa.array(i)), pa.array(start), pa.array(end), pa.array(end - start)], names=names)

    return placed.groupBy("region").applyInArrow(packs, ", ".join(f"{x} bigint" for x in names))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir))
