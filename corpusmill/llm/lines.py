"""Operator 2: line dedup by pairwise alignment.

Documents overlap if they share a line that is long or that few documents hold, or several lines that many hold, or
their whole text.
Every line and every two lines in a row link their first holder with each later one, so pairs grow with the lines,
whatever the number of holders, and each block of two lines meets a document that has it. A line that few hold links all
of its holders, as it may be out of order in the first; equal lists of holders are told apart once.
The lines of a pair are aligned by patience diff, and aligned common blocks are deleted from the later document. Links
are found by one 64-bit hash of a line; lines are aligned, and whole texts told equal, only if a second one agrees too.

At scale: the documents' line hashes are a narrow table; counting, linking and aligning read that alone, and texts are
read twice, for the hashes and for the deletion. Counts are summed before the shuffle, so lines that everyone holds are
no hot key there; in the joins with hashes of a line or a document they are split by adaptive execution.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW_KEY, fresh, row_key, table, written

RARE, LEAST_CHARS = 50, 20
#: A line of so many characters (fifty words have 99 at least) is a passage by itself, however many documents hold it.
LONG_CHARS = 99


def increasing(values: Sequence[int]) -> list[int]:
    """Places of a longest increasing subsequence."""
    tails: list[int] = []
    ends: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        j = bisect_left(tails, v)
        back[i] = ends[j - 1] if j else -1
        if j == len(tails):
            tails.append(v)
            ends.append(i)
        else:
            tails[j], ends[j] = v, i
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience(a: Sequence[int], b: Sequence[int]) -> list[tuple[int, int]]:
    """Matched places (in a, in b) of a patience diff: equal ends, then the longest increasing sequence of lines unique to both sides, then the gaps between."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        ca, cb = Counter(a[a0:a1]), Counter(b[b0:b1])
        at = {a[i]: i for i in range(a0, a1) if ca[a[i]] == 1 and cb.get(a[i]) == 1}
        anchors = [(at[b[j]], j) for j in range(b0, b1) if b[j] in at]
        anchors = [anchors[i] for i in increasing([i for i, _ in anchors])]
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        out.extend(anchors)
        if anchors:
            todo.extend((i + 1, i2, j + 1, j2) for (i, j), (i2, j2) in zip(edges, edges[1:], strict=False))
    return sorted(out)


def deletions(a: Sequence[int], b: Sequence[int], alone: set[int]) -> list[int]:
    """Places in b of its aligned blocks that have two lines or more, or one of those in alone (the rare and the long)."""
    out: list[int] = []
    block: list[int] = []
    last = (-2, -2)
    for i, j in [*patience(a, b), (-9, -9)]:
        if (i, j) != (last[0] + 1, last[1] + 1):
            if len(block) > 1 or block and b[block[0]] in alone:
                out.extend(block)
            block = []
        block.append(j)
        last = (i, j)
    return out


def _numbered(batch: pa.RecordBatch) -> Iterator[tuple[list[int], list[int], set[int], int]]:
    """Of each pair the lines of both documents as small numbers, equal where both hashes are, those that go alone, and its row."""
    sides = [batch.column(c) for c in ("a", "a2", "b", "b2")]
    first, second = (np.concatenate([sides[i].flatten().to_numpy(), sides[i + 2].flatten().to_numpy()]) for i in (0, 1))
    order = np.lexsort((second, first))
    new = np.ones(len(order), bool)
    new[1:] = (first[order][1:] != first[order][:-1]) | (second[order][1:] != second[order][:-1])
    code = np.empty(len(order), np.int64)
    code[order] = np.cumsum(new)
    ends = [np.cumsum(np.concatenate(([0], pc.list_value_length(x).to_numpy()))) for x in (sides[0], sides[2])]
    split = int(ends[0][-1])
    for i, rare in enumerate(batch.column("rare").to_pylist()):
        low, high = split + ends[1][i], split + ends[1][i + 1]
        rare = set(rare)
        alone = {int(c) for c, h in zip(code[low:high], first[low:high].tolist(), strict=True) if h in rare} if rare else set()
        yield code[ends[0][i] : ends[0][i + 1]].tolist(), code[low:high].tolist(), alone, i


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        rows, at = [], []
        places = batch.column("bp").to_pylist()
        for a, b, alone, i in _numbered(batch):
            if gone := [places[i][j] for j in deletions(a, b, alone)]:
                rows.append(i)
                at.append(gone)
        yield pa.RecordBatch.from_arrays([batch.column("bk").take(pa.array(rows, pa.int64())), pa.array(at, pa.list_(pa.int32()))], names=["k", "at"])


def _lines(text: Column) -> Column:
    """(place, two hashes, length) of each line that isn't blank; white space at its ends doesn't count."""
    all_lines = F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(i.alias("i"), F.btrim(x, F.lit(" \t\r")).alias("s")))
    return F.transform(F.filter(all_lines, lambda x: x["s"] != ""), lambda x: F.struct(x["i"].alias("i"), F.xxhash64(x["s"]).alias("h"), F.xxhash64(F.lit("other"), x["s"]).alias("h2"), F.length(x["s"]).alias("n")))


def found(docs: DataFrame, rare: int = RARE, least_chars: int = LEAST_CHARS, long_chars: int = LONG_CHARS) -> DataFrame:
    """(k, at): the places of the lines to delete of each document that loses any."""
    rows = docs.filter("text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), row_key().alias("k"), _lines(F.col("text")).alias("l"))
    rows = rows.filter(F.size("l") > 0).select("doc_id", "k", F.xxhash64("l.h", "l.h2").alias("all"), F.xxhash64("l.h2", "l.h").alias("all2"), F.col("l.h").alias("h"), F.col("l.h2").alias("h2"), F.col("l.i").alias("p"), F.col("l.n").alias("n"))
    held = written(rows, "lines")
    # documents in order: by id, null last, then key
    order = F.struct(F.col("doc_id").isNull().alias("o"), F.col("doc_id").alias("d"), F.col("k").alias("k"))
    none = F.lit(None).cast("bigint")
    kinds = F.transform(F.arrays_zip("h", "n"), lambda x: F.struct(x["h"].alias("h"), none.alias("h2"), F.when(x["n"] >= long_chars, 3).when(x["n"] >= least_chars, 1).otherwise(0).alias("kind")))
    after = F.slice("h", F.lit(2), F.greatest(F.size("h") - 1, F.lit(0)))
    # the last line has no next one
    twos = F.filter(F.zip_with("h", after, lambda x, y: F.when(y.isNotNull(), F.struct(F.xxhash64(F.lit("two"), x, y).alias("h"), none.alias("h2"), F.lit(4).alias("kind")))), lambda x: x.isNotNull())
    whole = F.array(F.struct(F.col("all").alias("h"), F.col("all2").alias("h2"), F.lit(2).alias("kind")))
    each = held.select(order.alias("at"), F.explode(F.array_distinct(F.concat(kinds, twos, whole))).alias("x"))
    each = each.select("at", "x.h", F.coalesce("x.h2", F.lit(0)).alias("h2"), "x.kind")
    firsts = each.groupBy("h", "h2", "kind").agg(F.min("at").alias("first"), F.count("*").alias("df")).filter("df > 1")
    repeated = written(each.join(firsts, ["h", "h2", "kind"]), "lines-repeated")
    few = F.col("kind").isin(1, 3) & (F.col("df") <= rare)
    alone = repeated.filter(few | (F.col("kind") == 3)).select(F.col("at.k").alias("bk"), "h").distinct().groupBy("bk").agg(F.collect_list("h").alias("rare"))
    pairs = repeated.filter(~few & (F.col("at.k") != F.col("first.k"))).groupBy(F.col("first.k").alias("ak"), F.col("at.k").alias("bk")).agg(
        F.bool_or(F.col("kind") > 2).alias("sure"), F.count(F.when(F.col("kind") != 2, 1)).alias("both"), F.bool_or(F.col("kind") == 2).alias("whole"))
    pairs = pairs.filter("whole or sure or both > 1")
    # a document that is a whole copy needs no other pair
    copies = pairs.filter("whole").select(F.col("bk").alias("k")).distinct()
    # rows equal in id and text are one document
    holders = repeated.filter(few).groupBy("h", "kind").agg(F.array_sort(F.collect_set("at")).alias("ats")).select("ats").distinct()
    holders = holders.select(F.col("ats.k").alias("ks")).select("ks", F.posexplode("ks").alias("i", "bk")).filter("i > 0").select(F.explode(F.slice("ks", F.lit(1), F.col("i"))).alias("ak"), "bk")
    others = pairs.filter("not whole").select("ak", "bk").union(holders).distinct().join(copies.withColumnRenamed("k", "bk"), "bk", "left_anti")
    unique = held.groupBy("k").agg(F.first("h").alias("h"), F.first("h2").alias("h2"), F.first("p").alias("p"))
    left = unique.select(F.col("k").alias("ak"), F.col("h").alias("a"), F.col("h2").alias("a2"))
    right = unique.select(F.col("k").alias("bk"), F.col("h").alias("b"), F.col("h2").alias("b2"), F.col("p").alias("bp"))
    right = right.join(alone, "bk", "left").withColumn("rare", F.coalesce("rare", F.array().cast("array<bigint>")))
    sides = others.join(right, "bk").join(left, "ak").select("bk", "a", "a2", "b", "b2", "bp", "rare")
    aligned = sides.mapInArrow(_align, f"k {ROW_KEY}, at array<int>")
    wholly = copies.join(unique, "k").select("k", F.col("p").alias("at"))
    return aligned.union(wholly).groupBy("k").agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"))


def line_dedup(docs: DataFrame, rare: int = RARE, least_chars: int = LEAST_CHARS, drop_emptied: bool = False, deleted: str | None = None, long_chars: int = LONG_CHARS) -> DataFrame:
    """docs with the lines deleted that they share with earlier documents; with the number of deleted lines, if named.

    Two documents are aligned if both hold a line of at least least_chars characters that at most rare documents hold,
    or if the earlier (by id, null last, then key) is the first holder of a line of at least long_chars characters, of
    two lines in a row, or of two lines of any kind, which the later one has too.
    A block is a run of aligned lines with no other line but blank ones between; it goes if it has two lines, a rare one
    or a long one. A document whose lines are all those of an earlier one, in order, loses them all.
    Null cases: rows with null or blank texts stay as they are; rows equal in id and text are one document, so they
    don't delete each other's lines and all lose the same; an empty table gives an empty one. drop_emptied leaves out
    documents that lose every line. Texts are read whole, however long; ties of id are decided by a hash of id and text.
    Other columns pass through, whatever their names.
    """
    k, at, ls = fresh(docs, "k", "at", "ls")
    gone = written(found(docs, rare, least_chars, long_chars).select(F.col("k").alias(k), F.col("at").alias(at)), "lines-gone")
    # by hashes of the narrow side in every partition, never by a copy of it on every executor: it grows with the documents
    out = docs.withColumn(k, row_key()).join(gone.hint("shuffle_hash"), k, "left")
    parts = F.split(F.col("text"), "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(at))
    out = out.withColumn(ls, F.when(F.col(at).isNotNull(), F.array_join(F.transform(kept, lambda i: F.get(parts, i)), "\n")))
    if drop_emptied:
        out = out.filter(F.col(ls).isNull() | (F.btrim(F.col(ls), F.lit(" \t\r\n")) != ""))
    columns = [F.coalesce(F.col(ls), F.col("text")).alias(c) if c == "text" else F.col(c) for c in docs.columns]
    extra = [F.coalesce(F.size(at), F.lit(0)).cast("bigint").alias(deleted)] if deleted else []
    return out.select(*columns, *extra)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir).select("doc_id", "text"), deleted="n_deleted")
