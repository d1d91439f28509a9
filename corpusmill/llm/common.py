"""What the training-data operators share: the shared folder, row keys, and array code for texts.

Array code works on one slice of an Arrow batch at a time (a MB of text), so a Python worker's
memory does not depend on how Spark cut the batches, only on the longest single text.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.storage import spread

SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; a temporary one only on a single machine."""
    sc = spark.sparkContext
    at = sc.getCheckpointDir()
    if not at:
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            at = tempfile.mkdtemp(prefix="corpusmill-")
        sc.setCheckpointDir(at)
    return at


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: it survives lost executors and cuts the lineage."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spooled(df: DataFrame) -> pa.Table:
    """The rows of df in their order, in batches of about a slice, in a file of the driver that is mapped into memory.

    One partition at a time passes the driver, so its memory doesn't depend on how long the texts are.
    """
    schema = to_arrow_schema(df.schema)
    with tempfile.TemporaryDirectory(prefix="corpusmill-") as at:
        with pa.OSFile(f"{at}/rows", "wb") as f, pa.ipc.new_file(f, schema) as out:
            held, size = [], 0
            for row in df.toLocalIterator():
                held.append(row.asDict())
                size += sum(len(x) for x in row if isinstance(x, str))
                if size >= SLICE_BYTES:
                    out.write_batch(pa.RecordBatch.from_pylist(held, schema))
                    held, size = [], 0
            out.write_batch(pa.RecordBatch.from_pylist(held, schema))
        # the mapping outlives the file's name
        return pa.ipc.open_file(pa.memory_map(f"{at}/rows")).read_all()


def where(rows: pa.Table, mask: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows where mask holds, a batch at a time."""
    at = 0
    for batch in rows.to_batches():
        yield batch.filter(pa.array(mask[at : at + batch.num_rows]))
        at += batch.num_rows


def mapped(n: int, kind: type) -> np.ndarray:
    """n values in a file without a name that is mapped into memory: the system may write them to disk."""
    if not n:
        return np.zeros(0, kind)
    with tempfile.TemporaryFile(prefix="corpusmill-") as f:
        return np.asarray(np.memmap(f, kind, "w+", shape=(n,)))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of df has, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


ROW_KEY = "struct<a:bigint,b:bigint>"


def row_key() -> Column:
    """A document is its id and its text: rows that agree in both have the same key of 128 bits, null ids included."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("\0null"))
    return F.struct(F.xxhash64(name, F.col("text")).alias("a"), F.xxhash64(F.lit("other"), F.col("text"), name).alias("b"))


def tie_key() -> Column:
    """The first half of row_key(), where it only orders rows of one id."""
    return row_key()["a"]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most so many bytes of text, each of one row at least."""
    n = batch.num_rows
    if not n:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, done = 0, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(size, done + limit, "right")))
        yield batch.slice(at, to - at)
        at, done = to, int(size[to - 1])


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one array of bytes, each followed by a line feed; where each begins, and the total. Null counts as empty."""
    parts = [x.encode("utf-8", "surrogatepass") if x else b"" for x in texts.to_pylist()]
    starts = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in parts], out=starts[1:])
    return np.frombuffer(b"\n".join(parts) + b"\n", np.uint8), starts


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 12, 13, 32]] = True
_SPLIT = _SPACE.copy()
_SPLIT[:33] = True
_SPLIT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 128)]] = True


def words(buf: np.ndarray, starts: np.ndarray, punctuation: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and text number of each word: a run without white space (with punctuation: nor ASCII punctuation)."""
    gap = (_SPLIT if punctuation else _SPACE)[buf]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).view(np.int8)))
    begin, end = edge[::2], edge[1::2]
    return begin, end, np.searchsorted(starts, begin, "right") - 1


MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 5
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1), modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        out = np.ones(max(n, 1 << 16), np.uint64)
        out[1:] = np.uint64(base)
        have = _POWERS[base] = np.multiply.accumulate(out)
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Prefix:
    """Prefix polynomial hashes of a sequence of 64-bit values: the hash of any stretch in constant time."""

    def __init__(self, values: np.ndarray, base: int = _BASE):
        n = len(values)
        self.base = base
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * powers(base, n), out=self.sums[1:])
        self.undo = powers(inverse(base), n + 1)

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[begin]) * self.undo[begin]


def word_hashes(buf: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes. About a slice of them is worked on at a time: the hash doesn't depend on the place."""
    out, at = np.empty(len(begin), np.uint64), 0
    while at < len(begin):
        zero = begin[at]
        to = max(at + 1, int(np.searchsorted(end, zero + SLICE_BYTES, "right")))
        b, e = begin[at:to] - zero, end[at:to] - zero
        out[at:to] = mix(Prefix(_BYTE[buf[zero : end[to - 1]]]).of(b, e) + (e - b).astype(np.uint64))
        at = to
    return out


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root): the least node of each connected component of the undirected edges (a, b), a and b longs.

    Labels pass along edges and then jump to their label's label, so rounds grow with the logarithm of the
    longest path. Every round is a table in the shared folder; the driver sees one count a round.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), name)
    at = written(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("root")), name)
    while True:
        near = both.join(at, both.b == at.node).groupBy("a").agg(F.min("root").alias("near"))
        low = at.join(near, at.node == near.a).select("node", F.least("root", "near").alias("low"), F.col("root").alias("was"))
        low = written(low, name)
        up = low.select(F.col("node").alias("up"), F.col("low").alias("top"))
        new = written(low.join(up, low.low == up.up).select("node", F.least("low", "top").alias("root"), (F.least("low", "top") != F.col("was")).alias("moved")), name)
        at = new.select("node", "root")
        if not new.filter("moved").limit(1).count():
            return at
