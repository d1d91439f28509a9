"""Operator 5: a quality classifier by co-training.

One view is the text (hashed n-grams), the other the page's metadata (source, language, length). Starting from labelled
rows, in each round both views score every document, and each labels those that it is sure of for the other. These are
taken evenly from all sources, languages and classes, so that a source that fills the corpus doesn't fill the exchange.
Both views are then calibrated on labelled rows that no fit saw, and a logistic regression of their log-odds on these
combines them.

At scale: a round is one pass over the texts without a shuffle of them; each task keeps, of every source, language and
class, the documents whose keys hash lowest, a number that is summed up over tasks in the same way. What a fit reads on
the driver is bounded: max_labelled labelled rows, and a_round rows that each round's exchange labels.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, slices, table, tie_key, where
from .ngrams import DIMS, Sparse, TextModel, features, fit_dense, fit_sparse, logit, platt, sigmoid
from .quality_rules import halves, labelled

KEEP, SURE, ROUNDS, A_ROUND = 0.5, 0.97, 3, 600
MAX_LABELLED = 3000
META_DIMS = 1 << 16
#: Of each source, language and class a round takes so many documents at most, and of so many of these in a task.
SLOTS, MAX_STRATA = 8, 4096
META = ("source", "lang", "n_chars")


def _hash(name: str) -> int:
    """64 bits of a hash of the whole name."""
    return int.from_bytes(hashlib.blake2b(name.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def meta_matrix(source: list, lang: list, n_chars: list) -> Sparse:
    """The metadata as features: hashed source, language, their pair, and the power of two of the length. Null is a value."""
    columns = []
    for s, g, n in zip(source, lang, n_chars, strict=True):
        size = "none" if n is None else str(int(max(0, n)).bit_length())
        columns += [f"s:{s}", f"l:{g}", f"sl:{s}:{g}", f"n:{size}"]
    seen: dict[str, int] = {}
    codes = np.array([seen.setdefault(c, len(seen)) for c in columns], np.int64)
    bucket = np.array([_hash(name) % META_DIMS for name in seen], np.int32)
    return Sparse(np.arange(len(source) + 1) * 4, bucket[codes], np.ones(len(codes), np.float32))


@dataclass
class Views:
    text: TextModel
    meta: np.ndarray
    meta_bias: float
    meta_a: float
    meta_b: float
    both: np.ndarray

    def meta_score(self, part) -> np.ndarray:
        source, lang, n_chars = (part.column(c).to_pylist() for c in META)
        return meta_matrix(source, lang, n_chars).scores(self.meta) + self.meta_bias

    def probabilities(self, part) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By the text, by the metadata, by both."""
        texts = part.column("text")
        t = self.text.probability(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts)
        m = sigmoid(self.meta_a * self.meta_score(part) + self.meta_b)
        return t, m, sigmoid(np.column_stack([logit(t), logit(m)]) @ self.both[:2] + self.both[2])


def _fitted(known: pa.Table, held: np.ndarray, y: np.ndarray, given: dict[str, pa.Table], blocks: dict[str, list[Sparse]], before: Views | None, last: bool) -> Views:
    """The views fitted on what isn't held and on the rows that each was given, and calibrated on what is."""
    cal_y = y[held]
    models = {}
    for view, dims, decay in (("text", DIMS, 1e-6), ("meta", META_DIMS, 1e-3)):
        labels = np.concatenate([y[~held], given[view].column("label").to_numpy()])
        start = None if before is None else ((before.text.weights, before.text.bias) if view == "text" else (before.meta, before.meta_bias))
        models[view] = fit_sparse(blocks[view], labels, dims, 150 if start is None else 50, decay=decay, start=start)
    out = Views(TextModel(models["text"][0].astype(np.float32), models["text"][1]), models["meta"][0].astype(np.float32), models["meta"][1], 1.0, 0.0, np.zeros(3))
    out.text.a, out.text.b = platt(np.concatenate([out.text.score(part.column("text")) for part in where(known, held)]), cal_y)
    out.meta_a, out.meta_b = platt(out.meta_score(known.select(META).filter(pa.array(held))), cal_y)
    t, m = (np.concatenate(x) for x in zip(*(out.probabilities(part)[:2] for part in where(known, held)), strict=True))
    out.both = fit_dense(np.column_stack([logit(t), logit(m)]), cal_y, decay=1.0)
    return out


def train(known: pa.Table, exchange: Callable[[Views, int], pa.Table], rounds: int = ROUNDS) -> Views | None:
    """The views; None without labelled rows of both classes in both parts.

    exchange: from the views and the round to the documents of which one is sure, with the view that is told and the label.
    """
    if not known.num_rows:
        return None
    y = (known.column("quality").to_numpy() >= 0.5).astype(float)
    held = halves(known.column("doc_id").to_numpy())
    if any(len(np.unique(y[part])) < 2 for part in (held, ~held)):
        return None
    fit = known.select(META).filter(pa.array(~held))
    blocks = {"text": [features(part.column("text") for part in where(known, ~held))], "meta": [meta_matrix(*(fit.column(c).to_pylist() for c in META))]}
    none = pa.table({"k": pa.array([], pa.int64()), "label": pa.array([], pa.float64())})
    given = {"text": none, "meta": none}
    views = _fitted(known, held, y, given, blocks, None, False)
    for turn in range(1, rounds + 1):
        told = exchange(views, turn)
        for view in given:
            rows = told.filter(pc.equal(told.column("to"), view))
            rows = rows.filter(pc.invert(pc.is_in(rows.column("k"), given[view].column("k").combine_chunks())))
            if rows.num_rows:
                blocks[view].append(features(rows.column("text").chunks) if view == "text" else meta_matrix(*(rows.column(c).to_pylist() for c in META)))
            given[view] = pa.concat_tables([given[view], rows.select(["k", "label"])])
        views = _fitted(known, held, y, given, blocks, views, turn == rounds)
    return views


def _narrow(docs: DataFrame) -> DataFrame:
    kinds = {"doc_id": "bigint", "text": "string", "source": "string", "lang": "string", "n_chars": "bigint"}
    return docs.select(*(F.col(c).cast(k).alias(c) for c, k in kinds.items()))


_TOLD = "stratum bigint, slot int, h bigint, k bigint, to string, label double, text string, source string, lang string, n_chars bigint"


def _told(shared: Broadcast, turn: int, sure: float, known: np.ndarray):
    """Of each stratum (view, class, source, language) and slot the document of least hash, with its label for the other view."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        views: Views = shared.value
        held: dict[int, dict[int, tuple]] = {}
        strata: dict[tuple, int] = {}
        for batch in batches:
            for part in slices(batch):
                part = part.filter(pa.array(~np.isin(part.column("doc_id").fill_null(-1).to_numpy(), known) & np.array([bool(x and x.strip()) for x in part.column("text").to_pylist()], bool)))
                if not part.num_rows:
                    continue
                t, m, _ = views.probabilities(part)
                k = part.column("k").to_numpy()
                h = (mix(k.view(np.uint64) ^ np.uint64(turn)) >> np.uint64(1)).astype(np.int64)
                source, lang, n_chars = (part.column(c).to_pylist() for c in META)
                for p, to in ((t, "meta"), (m, "text")):
                    for i in np.flatnonzero((p >= sure) | (p <= 1 - sure)):
                        what = (to, float(p[i] > 0.5), source[i], lang[i])
                        if what not in strata:
                            strata[what] = _hash(repr(what)) >> 1
                        slots = held.setdefault(strata[what], {})
                        slot = int(h[i] % SLOTS)
                        if slot not in slots or (h[i], k[i]) < slots[slot][:2]:
                            slots[slot] = (int(h[i]), int(k[i]), to, what[1], part.column("text")[int(i)].as_py(), source[i], lang[i], n_chars[i])
                for x in sorted(held)[MAX_STRATA:]:
                    del held[x]
        rows = [(x, slot, *row) for x, slots in held.items() for slot, row in slots.items()]
        schema = pa.schema([(name, {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}[kind]) for name, kind in (c.split() for c in _TOLD.split(", "))])
        for at in range(0, len(rows), 500):
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows[at : at + 500]], schema)

    return run


def _trained(docs: DataFrame, labels: DataFrame, max_labelled: int, a_round: int, sure: float = SURE) -> Broadcast:
    """The trained views as a broadcast. docs: as of _narrow."""
    sc = docs.sparkSession.sparkContext
    known = labelled(docs, labels, max_labelled, "text", *META)
    ids = known.column("doc_id").to_numpy()
    keyed = docs.withColumn("k", tie_key())

    def exchange(views: Views, turn: int) -> pa.Table:
        shared = sc.broadcast(views)
        told = keyed.mapInArrow(_told(shared, turn, sure, ids), _TOLD)
        rest = [c.split()[0] for c in _TOLD.split(", ")][2:]
        told = told.groupBy("stratum", "slot").agg(F.min(F.struct(*rest)).alias("one")).select("slot", "stratum", "one.*")
        # one of each stratum, then a second one, and so on
        out = told.orderBy("slot", "h", "stratum").limit(a_round).toArrow()
        shared.unpersist()
        return out

    return sc.broadcast(train(known, exchange))


def cotrain(docs: DataFrame, labels: DataFrame, keep: float = KEEP, max_labelled: int = MAX_LABELLED, a_round: int = A_ROUND) -> DataFrame:
    """Rows (doc_id, p_text, p_meta, p_quality, keep), one for each row of docs.

    max_labelled bounds the labelled rows that training uses, chosen by a hash of the id; a_round the documents that the
    views label for each other in a round, chosen from all that one is sure of, evenly by source, language and class.
    Null cases: null or blank texts have null probabilities and aren't kept; null metadata are a value of their own;
    null ids are scored and stay null; labels with a null id or quality are left out, repeated ones averaged; without
    labels of both classes all probabilities are null and every text that isn't blank is kept. Rows are scored apart
    from each other, so repeated ones agree, and so do ties; texts are read whole, however long. An empty table gives an
    empty one. Other columns are not read.
    """
    docs = _narrow(docs)
    shared = _trained(docs, labels, max_labelled, a_round)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                ps, ok = verdicts(shared.value, part, keep)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *ps, ok], names=["doc_id", "p_text", "p_meta", "p_quality", "keep"])

    return docs.mapInArrow(apply, "doc_id bigint, p_text double, p_meta double, p_quality double, keep boolean")


def verdicts(views: Views | None, part: pa.RecordBatch, keep: float) -> tuple[list[pa.Array], pa.Array]:
    blank = np.array([not (x and x.strip()) for x in part.column("text").to_pylist()], bool)
    ps = views.probabilities(part) if views else (np.full(len(blank), np.nan),) * 3
    ok = ~blank & ((ps[2] >= keep) if views else True)
    return [pa.array(p, mask=blank | np.isnan(p)) for p in ps], pa.array(ok)


def keep_good(docs: DataFrame, labels: DataFrame, keep: float = KEEP, max_labelled: int = MAX_LABELLED, a_round: int = A_ROUND) -> DataFrame:
    """The rows of docs that cotrain() keeps, with all their columns, whatever their names and types."""
    shared = _trained(_narrow(docs), labels, max_labelled, a_round)

    @F.arrow_udf("boolean")
    def good(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for columns in batches:
            batch = pa.RecordBatch.from_arrays(list(columns), names=["text", *META])
            yield pa.concat_arrays([pa.array([], pa.bool_()), *(verdicts(shared.value, part, keep)[1] for part in slices(batch))])

    return docs.filter(good(F.col("text"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("n_chars").cast("bigint")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotrain(table(spark, sf_dir), table(spark, sf_dir, "labels"))
