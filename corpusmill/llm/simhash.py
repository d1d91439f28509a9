"""Operator 4: SimHash near-duplicates by covering locality-sensitive hashing.

A document's fingerprint has n_blocks blocks of block_bits bits: the signs of sums over its distinct words, long words
counting more. A block has radius + 1 parts. Each table's mask holds one part of one block, whole, and some positions of
the block's rest: each of these has a vector of radius + 1 bits, and each of the 2**(radius+1) - 1 vectors v but zero is
a table whose mask holds the positions whose vector has an odd product with v. Two fingerprints that differ in at most
reach = n_blocks * (radius + 1) - 1 bits have a block in which they differ in at most radius positions; one of its parts
agrees, and some v is orthogonal to all of these positions' vectors, so that both agree under this table's mask: they
surely collide. What collides is compared in full and linked if it differs in at most reach bits, so the accepted radius
is the guaranteed one: no pair is missed, none is found by chance. A group is a connected component.

At scale: equal fingerprints are one node, so thousands of copies cost no more than one document. The 15 tables that
share a part are shuffled as one row, by the part's bits; the rest of the mask is taken in the task. So a node moves 40
times, not 600, whatever the corpus. Where so many nodes share a part's bits that a task couldn't take them (they are
counted first, in a table of at most a few thousand rows), their tables are shuffled apart. A task passes on a spanning
forest of its links, so that a group of n near-copies leaves n - 1 of them and never all pairs. A bucket is told apart
by about 16 bits. Comparisons in buckets grow with the square of the nodes over 2**16, so a corpus of more than some
hundred million nodes wants wider blocks, that is a longer fingerprint: see Cover.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ROW_KEY, components, fresh, mix, row_key, slices, table, text_bytes, word_hashes, words, written


@dataclass(frozen=True)
class Cover:
    """The shape of fingerprints and tables.

    The default links what differs in up to 39 of 250 bits. For larger corpora raise block_bits, and the radius by the
    same share (e.g. 10, 50, 7 for 79 of 500 bits): buckets are then told apart by twice the bits, for twice the rows.
    """

    n_blocks: int = 10
    block_bits: int = 25
    radius: int = 3

    def __post_init__(self) -> None:
        if not 0 <= self.radius < self.block_bits <= 50:
            raise ValueError("a block has more bits than the radius, and 50 at most")

    @property
    def reach(self) -> int:
        return self.n_blocks * (self.radius + 1) - 1

    @property
    def lanes(self) -> int:
        return -(-self.n_blocks * self.block_bits // 64)

    @property
    def columns(self) -> list[str]:
        """The words of a fingerprint."""
        return [f"f{i}" for i in range(self.lanes)]

    @cached_property
    def parts(self) -> np.ndarray:
        """The mask of each part of a block, as a word."""
        cuts = [self.block_bits * i // (self.radius + 1) for i in range(self.radius + 2)]
        return np.array([(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)], np.uint64)

    @cached_property
    def rests(self) -> np.ndarray:
        """For each part (a row) the masks of its tables over the block's rest, as words."""
        v = np.arange(1, 1 << (self.radius + 1))
        out = np.zeros((len(self.parts), len(v)), np.uint64)
        for i, part in enumerate(self.parts):
            rest = [p for p in range(self.block_bits) if not int(part) >> p & 1]
            vectors = np.random.default_rng(4).permutation(np.resize(v, len(rest)))
            for p, x in zip(rest, vectors, strict=True):
                out[i] |= (np.bitwise_count(v & x) & 1).astype(np.uint64) << np.uint64(p)
        return out


COVER = Cover()
ACCEPT = COVER.reach
SHORT = 8
#: Buckets up to this size are compared side by side, larger ones by chains.
SIDE_BY_SIDE = 256
#: A task's links are cut to a spanning forest whenever there are so many.
HELD = 1 << 21
#: So many nodes that share a part's bits are taken in one task; the tables of more are shuffled apart.
TOGETHER = 1 << 18
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()
_SALT = mix(np.arange(1, 65, dtype=np.uint64))


def fingerprints(texts: pa.Array, cover: Cover = COVER) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprints as rows of 64-bit words, and which texts have one (those that aren't blank).

    Texts of fewer than SHORT words are hashed as a whole, so only those with the same words in the same order match.
    """
    buf, starts = text_bytes(pc.utf8_lower(texts))
    n = len(starts) - 1
    begin, end, doc = words(buf, starts, punctuation=True)
    h = word_hashes(buf, begin, end)
    count = np.bincount(doc, minlength=n)
    short = count < SHORT
    if short.any():  # one feature, the sequence; without words, the characters
        b2, e2, d2 = words(buf, starts)
        has = np.bincount(d2, minlength=n) > 0
        chars = np.zeros(n, np.uint64)
        raw = word_hashes(buf, b2, e2)
        whole = np.zeros(n, np.uint64)
        for d in np.flatnonzero(short & has):
            lo, hi = np.searchsorted(doc, [d, d + 1])
            for x in h[lo:hi]:
                whole[d] = mix(whole[d : d + 1] * np.uint64(31) + x)[0]
            lo, hi = np.searchsorted(d2, [d, d + 1])
            for x in raw[lo:hi]:
                chars[d] = mix(chars[d : d + 1] * np.uint64(31) + x)[0]
        keep = ~short[doc]
        h, doc, size = h[keep], doc[keep], (end - begin)[keep]
        ids = np.flatnonzero(short & has)
        h = np.concatenate([h, np.where(count[ids] > 0, whole[ids], chars[ids] + np.uint64(1))])
        doc, size = np.concatenate([doc, ids]), np.concatenate([size, np.full(len(ids), 9)])
        has |= ~short
    else:
        has, size = np.ones(n, bool), end - begin
    order = np.lexsort((h, doc))
    h, doc, size = h[order], doc[order], size[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc, size = h[new], doc[new], size[new]
    weight = np.select([size <= 3, size <= 4, size <= 6], [1, 2, 5], 8).astype(np.uint64)
    out = np.zeros((n, cover.lanes), np.uint64)
    if not len(h):
        return out, has
    # eight one-byte counters in a word: 31 weights of at most 8 fit into each
    first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    rank = np.arange(len(doc)) - np.repeat(first, np.diff(np.append(first, len(doc))))
    part = np.flatnonzero(rank % 31 == 0)
    part_first = np.flatnonzero(np.concatenate(([True], doc[part][1:] != doc[part][:-1])))
    total = np.add.reduceat(weight.astype(np.int32), first)
    bits = np.empty((len(first), cover.lanes * 64), bool)
    for lane in range(cover.lanes):
        b = mix(h ^ _SALT[lane]).view(np.uint8).reshape(-1, 8)
        for byte in range(8):
            sums = np.add.reduceat(_SPREAD[b[:, byte]] * weight, part).view(np.uint8).reshape(-1, 8).astype(np.int32)
            sums = np.add.reduceat(sums, part_first, axis=0)
            at = lane * 64 + byte * 8
            bits[:, at : at + 8] = 2 * sums > total[:, None]
    bits[:, cover.n_blocks * cover.block_bits :] = False
    out[doc[first]] = np.packbits(bits, axis=1).view(np.uint64)
    return out, has


def blocks(prints: np.ndarray, cover: Cover = COVER) -> np.ndarray:
    """The blocks of each fingerprint, as words."""
    bits = np.unpackbits(prints.view(np.uint8).reshape(len(prints), -1), axis=1)[:, : cover.n_blocks * cover.block_bits]
    return (bits.reshape(len(prints), cover.n_blocks, -1) * (np.uint64(1) << np.arange(cover.block_bits, dtype=np.uint64))).sum(axis=2, dtype=np.uint64)


def routes(prints: np.ndarray, cover: Cover = COVER) -> tuple[np.ndarray, np.ndarray]:
    """Of each fingerprint: its bits in each part with the part's number above them, and the block that holds the part."""
    of = np.repeat(blocks(prints, cover), len(cover.parts), axis=1)
    low = np.tile(np.bitwise_count(cover.parts - np.uint64(1) & ~cover.parts).astype(np.uint64), cover.n_blocks)
    wide = np.uint64(cover.block_bits)
    return ((of & np.tile(cover.parts, cover.n_blocks)) >> low) | np.arange(of.shape[1], dtype=np.uint64) << wide, of


def keys(prints: np.ndarray, cover: Cover = COVER) -> np.ndarray:
    """The bucket of each fingerprint in each table: the part's bits, and the table's number with what its mask leaves of the rest."""
    route, of = routes(prints, cover)
    part = np.tile(np.arange(len(cover.parts)), cover.n_blocks)
    out = [mix(route ^ mix((of & cover.rests[part, t]) | np.uint64(t) << np.uint64(cover.block_bits))) for t in range(cover.rests.shape[1])]
    return np.concatenate(out, axis=1)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many bits fingerprints differ; their words lie along the first axis."""
    out = np.bitwise_count(a[0] ^ b[0]).astype(np.uint16)
    for x, y in zip(a[1:], b[1:], strict=True):
        out += np.bitwise_count(x ^ y)
    return out


def by_key(batches: Iterator[pa.RecordBatch], rows: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Sorted batches joined and cut so that no key is in two of them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            key = whole.column(0).to_numpy()
            cut = int(np.searchsorted(key, key[-1], "left"))
            if cut:
                yield whole.slice(0, cut)
            held = [whole.slice(cut)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (least, other) that join what the links (a, b) join, one for each node but the least of each component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    low = np.arange(len(nodes))
    while True:
        least = np.minimum(low[x], low[y])
        new = low.copy()
        np.minimum.at(new, x, least)
        np.minimum.at(new, y, least)
        np.minimum.at(new, low[x], least)
        np.minimum.at(new, low[y], least)
        new = new[new]
        if (new == low).all():
            break
        low = new
    on = np.flatnonzero(low != np.arange(len(low)))
    return nodes[low[on]], nodes[on]


def spanning(prints: np.ndarray, accept: int, at_once: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Links between fingerprints (along the second axis) that join what chains of pairs within accept join.

    A few at a time are compared with those not reached yet, then those reached from them: n near-copies take n
    comparisons times at_once. Only what is far apart is compared with all.
    """
    n = prints.shape[1]
    group, state = np.arange(n), np.zeros(n, np.int8)  # 0: not reached, 1: reached, 2: compared
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while True:
        rest, front = np.flatnonzero(state == 0), np.flatnonzero(state == 1)
        some = (front if len(front) else rest)[:at_once]
        if not len(some):
            return np.concatenate(left), np.concatenate(right)
        state[some] = 2
        if not len(front):
            others = rest
        elif len(np.unique(group[front])) > 1:  # what was reached from different ones may meet
            others = np.concatenate([rest, front])
        else:
            others = rest
        i, j = np.nonzero(distance(prints[:, some, None], prints[:, None, others]) <= accept)
        i, j = some[i], others[j]
        i, j = i[i != j], j[i != j]
        left.append(i)
        right.append(j)
        state[j[state[j] == 0]] = 1
        low, other = forest(group[i], group[j])
        if len(other):
            to = np.arange(n)
            to[other] = low
            group = to[group]


def buckets(key: np.ndarray, node: np.ndarray, prints: np.ndarray, accept: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links within the buckets, in parts. key: sorted; the words of fingerprints lie along the first axis."""
    out = []
    if not len(key):
        return out
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(first, len(key)))
    end = np.repeat(np.where(size <= SIDE_BY_SIDE, first + size, 0), size)
    at, step = np.flatnonzero(end > np.arange(len(key)) + 1), 1
    while len(at):
        near = at[distance(prints[:, at], prints[:, at + step]) <= accept]
        out.append((node[near], node[near + step]))
        step += 1
        at = at[at + step < end[at]]
    for f, s in zip(first[size > SIDE_BY_SIDE], size[size > SIDE_BY_SIDE], strict=True):
        i, j = spanning(prints[:, f : f + s], accept)
        out.append(forest(node[f + i], node[f + j]))
    return [forest(*(np.concatenate(x) for x in zip(*out, strict=True)))] if out else out


def _links(cover: Cover, accept: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.zeros(0, np.int64),) * 2]

        def cut() -> None:
            held[:] = [forest(*(np.concatenate(x) for x in zip(*held, strict=True)))]

        for batch in by_key(batches):
            route, rest, node = (batch.column(i).to_numpy() for i in range(3))
            prints = np.stack([batch.column(3 + i).to_numpy().view(np.uint64) for i in range(cover.lanes)])
            here = np.flatnonzero(rest >= 0)  # their tables are taken apart here; the others' were before
            part = (route[here] >> cover.block_bits) % len(cover.parts)
            _, group = np.unique(route[here], return_inverse=True)
            for t in range(cover.rests.shape[1]):
                key = group.astype(np.uint64) << np.uint64(cover.block_bits) | (rest[here].view(np.uint64) & cover.rests[part, t])
                order = np.argsort(key, kind="stable")
                held += buckets(key[order], node[here[order]], prints[:, here[order]], accept)
            there = np.flatnonzero(rest < 0)
            held += buckets(route[there], node[there], prints[:, there], accept)
            cut()
            if len(held[0][0]) > HELD:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names=["a", "b"])
                held[:] = [(np.zeros(0, np.int64),) * 2]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names=["a", "b"])

    return run


def _sketch(cover: Cover):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                prints, has = fingerprints(part.column("text"), cover)
                part, prints = part.filter(pa.array(has)), prints[has].view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("k"), *(pa.array(prints[:, i]) for i in range(cover.lanes))], names=["doc_id", "k", *cover.columns])

    return run


def _prints(part: pa.RecordBatch, cover: Cover) -> np.ndarray:
    return np.stack([part.column(c).to_numpy() for c in cover.columns], axis=1)


def _counts(cover: Cover):
    """How many nodes have a part's bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 20_000):
                route, n = np.unique(routes(_prints(batch.slice(first, 20_000), cover).view(np.uint64), cover)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(route.view(np.int64)), pa.array(n)], names=["route", "n"])

    return run


def _tables(cover: Cover, apart: np.ndarray):
    """Rows (route, rest, node, fingerprint): by the part's bits, with the block; or, for those in apart, by the bucket, with -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 2000):
                part = batch.slice(first, 2000)
                prints = _prints(part, cover)
                route, rest = (x.ravel() for x in routes(prints.view(np.uint64), cover))
                at = np.repeat(np.arange(part.num_rows), len(route) // max(1, part.num_rows))
                hot = np.isin(route, apart)
                route, rest, rows = route[~hot].view(np.int64), rest[~hot].view(np.int64), at[~hot]
                if hot.any():  # hashes of buckets lie above all routes
                    k = keys(prints.view(np.uint64), cover).reshape(part.num_rows, cover.rests.shape[1], -1)
                    i, j = at[hot], np.flatnonzero(hot) % k.shape[2]
                    k = (k[i, :, j] | np.uint64(1 << 62)) & np.uint64((1 << 63) - 1)
                    route = np.concatenate([route, k.ravel().view(np.int64)])
                    rest = np.concatenate([rest, np.full(k.size, -1)])
                    rows = np.concatenate([rows, np.repeat(i, k.shape[1])])
                columns = [route, rest, part.column("node").to_numpy()[rows], *prints[rows].T]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["route", "rest", "node", *cover.columns])

    return run


def _typed(*names: str) -> str:
    return ", ".join(f"{x} bigint" for x in names)


def duplicates(docs: DataFrame, cover: Cover = COVER, together: int = TOGETHER) -> tuple[DataFrame, DataFrame]:
    """(doc_id, k, kept_id, kept_k) of every document that goes, and (k, copies) of those whose rows repeat."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", row_key().alias("k"))
    prints = written(rows.mapInArrow(_sketch(cover), f"doc_id bigint, k {ROW_KEY}, {_typed(*cover.columns)}"), "simhash")
    # numbers that the written table fixes: two nodes never have the same
    nodes = written(prints.groupBy(*cover.columns).agg(F.count("*").alias("n")).select(F.monotonically_increasing_id().alias("node"), *cover.columns), "simhash-nodes")
    # at most n_blocks * (radius + 1) * 2**(bits of a part) rows, whatever the corpus
    apart = nodes.mapInArrow(_counts(cover), _typed("route", "n")).groupBy("route").agg(F.sum("n").alias("n")).filter(F.col("n") > together)
    apart = np.array([x["route"] for x in apart.select("route").collect()], np.int64).view(np.uint64)
    met = nodes.mapInArrow(_tables(cover, apart), _typed("route", "rest", "node", *cover.columns)).repartition("route").sortWithinPartitions("route")
    edges = written(met.mapInArrow(_links(cover, cover.reach), "a bigint, b bigint").distinct(), "simhash-edges")
    roots = components(edges, "simhash-components")
    member = prints.join(nodes, cover.columns).join(roots, "node", "left").select("doc_id", "k", F.coalesce("root", "node").alias("root"))
    one = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("k").alias("key"))
    groups = member.groupBy("root").agg(F.min(one).alias("kept"), F.count("*").alias("n")).filter("n > 1")
    gone = member.join(groups, "root").filter(F.col("k") != F.col("kept.key")).select("doc_id", "k", F.col("kept.id").alias("kept_id"), F.col("kept.key").alias("kept_k"))
    return written(gone, "simhash-gone"), prints.groupBy("k").agg(F.count("*").alias("copies")).filter("copies > 1")


def near_dedup(docs: DataFrame, cover: Cover = COVER) -> DataFrame:
    """docs without near-copies: of each group the document of least id (then key) stays, in one row.

    Null cases: rows with null or blank texts are never copies and stay; a null id is larger than any other; of rows
    equal in id and text one stays, the one whose other columns hash lowest; an empty table gives an empty one. Texts
    without words are copies only if their characters agree. Texts are read whole, however long; ties of id are decided
    by a hash of id and text. Other columns pass through, whatever their names.
    """
    gone, repeated = duplicates(docs, cover)
    k, h, rn = fresh(docs, "k", "h", "rn")
    out = docs.withColumn(k, row_key()).join(gone.select(F.col("k").alias(k)).distinct().hint("shuffle_hash"), k, "left_anti")
    repeated = written(repeated.select(F.col("k").alias(k)), "simhash-repeated")
    if repeated.limit(1).count():
        again = out.join(repeated, k, "left_semi").withColumn(h, F.xxhash64(*[F.col(c) for c in docs.columns]))
        again = again.withColumn(rn, F.row_number().over(W.partitionBy(k).orderBy(h))).filter(F.col(rn) == 1)
        out = out.join(repeated, k, "left_anti").select(*docs.columns).union(again.select(*docs.columns))
    return out.select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, duplicate_of): every document that goes and the one of its group that stays."""
    gone, _ = duplicates(table(spark, sf_dir))
    return gone.select("doc_id", F.col("kept_id").alias("duplicate_of"))
