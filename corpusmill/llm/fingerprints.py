"""Operator 3: I-Match fingerprints.

Of a document's distinct terms only those whose inverse document frequency lies within a band are kept and sorted; a
hash of them is its fingerprint. Hashes of what remains of them in several random parts of the lexicon still agree
between documents that differ in a few terms.

At scale: terms are counted over all documents, summed within partitions first. The band bounds the lexicon however
many documents there are (a document has so many terms, and a kept term is in at least the share exp(-idf_high) of
them), and it is broadcast only if its counted size is within max_broadcast_terms; else terms are joined with it. Both
ways take terms and make prints by the same functions, so they differ in what is shuffled, not in a result.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW_KEY, row_key, slices, table, written

STRIP = ".,;:!?\"'()[]{}|*#$%&<>-"
SUBSETS, MIN_TERMS = 8, 4
HELD = 400_000


def terms(text: str | None) -> set[str]:
    """Distinct words in lower case without punctuation at their ends."""
    out = {w.strip(STRIP) for w in set(text.lower().split())} if text else set()
    out.discard("")
    return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[str | None] = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["term", "df"])

    for batch in batches:
        for text in batch.column("text").to_pylist():
            if found := terms(text):
                held.update(found)
                held[None] += 1
            if len(held) > HELD:
                yield out()
                held.clear()
    yield out()


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The terms of each row."""
    for batch in batches:
        for part in slices(batch):
            found = [sorted(terms(x)) for x in part.column("text").to_pylist()]
            of = np.repeat(np.arange(len(found)), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([part.column("k").take(pa.array(of)), pa.array([t for x in found for t in x], pa.string())], names=["k", "term"])


def member(term: str, seed: int) -> int:
    """A bit for each part of the lexicon that holds the term: those whose hex digit of its hash is 0 or 1, one in eight."""
    digits = hashlib.md5(f"{seed}:{term}".encode()).hexdigest()
    return sum(1 << j for j in range(SUBSETS) if digits[j] in "01")


def prints(found: list[tuple[str, int]]) -> tuple[int, list[str | None]]:
    """The number of terms, and the hash of all and of each part's; null for fewer than MIN_TERMS. found: sorted terms with their bits."""
    hashed = []
    for kept in ([t for t, _ in found], *([t for t, bits in found if bits >> j & 1] for j in range(SUBSETS))):
        hashed.append(hashlib.md5(" ".join(kept).encode()).hexdigest() if len(kept) >= MIN_TERMS else None)
    return len(found), hashed


def _columns(rows: list[tuple[int, list[str | None]]]) -> list[pa.Array]:
    return [pa.array([n for n, _ in rows], pa.int64()), *(pa.array([h[j] for _, h in rows], pa.string()) for j in range(SUBSETS + 1))]


def _prints(names: list[str], seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [prints(sorted((t, member(t, seed)) for t in found)) for found in batch.column("terms").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("k"), *_columns(rows)], names=["k", "n_terms", *names])

    return run


def imatch(docs: DataFrame, idf_low: float = 2.0, idf_high: float = 7.0, seed: int = 42, max_broadcast_terms: int = 1_000_000) -> DataFrame:
    """Rows (doc_id, n_terms, fp, fp1 ... fp8), one for each row of docs.

    idf is ln(documents with a term / documents that hold this one). fp hashes all terms within the band, fp1 to fp8
    those in a random eighth of the lexicon each; a hash of fewer than four terms is null.
    Null cases: null or blank texts have no term and only null fingerprints, and don't count as documents; null ids stay;
    repeated rows each have their row and count each; terms of equal df are told apart by nothing, so both stay or go;
    texts are read whole, however long; an empty table gives an empty one. Other columns are not read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    counted = docs.select("text").mapInArrow(_counts, "term string, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
    counted = written(counted.filter("term is null or df > 0"), "imatch-df")
    n = counted.filter("term is null").agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n"))
    idf = F.log(F.col("n") / F.col("df"))
    lexicon = counted.filter("term is not null").crossJoin(F.broadcast(n)).filter((idf >= idf_low) & (idf <= idf_high)).select("term")
    names = ["fp", *(f"fp{j + 1}" for j in range(SUBSETS))]
    if lexicon.count() <= max_broadcast_terms:
        shared = spark.sparkContext.broadcast({t: member(t, seed) for t in lexicon.toArrow().column("term").to_pylist()})

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lex = shared.value
            for batch in batches:
                for part in slices(batch):
                    rows = [prints(sorted((t, lex[t]) for t in terms(x) if t in lex)) for x in part.column("text").to_pylist()]
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), *_columns(rows)], names=["doc_id", "n_terms", *names])

        return docs.mapInArrow(apply, "doc_id bigint, n_terms bigint, " + ", ".join(f"{x} string" for x in names))

    # a lexicon too large to broadcast is joined; terms and prints are made by the same functions
    keyed = docs.select("doc_id", row_key().alias("k"), "text")
    held = keyed.mapInArrow(_held, f"k {ROW_KEY}, term string").join(lexicon, "term").groupBy("k").agg(F.collect_set("term").alias("terms"))
    made = held.mapInArrow(_prints(names, seed), f"k {ROW_KEY}, n_terms bigint, " + ", ".join(f"{x} string" for x in names))
    return keyed.select("doc_id", "k").join(made, "k", "left").select("doc_id", F.coalesce("n_terms", F.lit(0).cast("bigint")).alias("n_terms"), *names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch(table(spark, sf_dir))


_PARTS = ",\n    ".join(f"case when count(*) filter (substr(md5('42:' || term), {j + 1}, 1) in ('0', '1')) >= 4 then md5(string_agg(term, ' ' order by term) filter (substr(md5('42:' || term), {j + 1}, 1) in ('0', '1'))) end as fp{j + 1}" for j in range(SUBSETS))
SQL = rf"""
with t as (select distinct doc_id, trim(w, '{STRIP.replace("'", "''")}') as term
    from (select doc_id, unnest(string_split_regex(lower(text), '\s+')) as w from documents)),
p as (select * from t where term <> ''),
n as (select count(distinct doc_id) as n from p),
l as (select term from p, n group by term, n having ln(n / count(*)) between 2.0 and 7.0),
f as (select doc_id, count(*) as n_terms,
    case when count(*) >= 4 then md5(string_agg(term, ' ' order by term)) end as fp,
    {_PARTS}
    from p join l using (term) group by doc_id)
select d.doc_id, coalesce(n_terms, 0)::bigint as n_terms, fp, {", ".join(f"fp{j + 1}" for j in range(SUBSETS))}
from documents d left join f using (doc_id)
"""
