"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names."""

import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from corpusmill.llm import common, cotraining, fingerprints, licenses, lines, mixing, packing, quality_rules, secrets, simhash, suffixes  # noqa: E402

from .conftest import prose  # noqa: E402


def no_labels(docs):
    return docs.sparkSession.createDataFrame([], "doc_id long, quality int, toxic int")


def some_labels(docs):
    return docs.sparkSession.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (2, None, 0), (8, 0, 1), (4, 1, 1)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "suffixes": suffixes.repeated_passages, "lines": lambda d: lines.line_dedup(d, deleted="n_deleted_lines"), "lines drop": lambda d: lines.line_dedup(d, drop_emptied=True), "prints": fingerprints.imatch, "prints by joins": lambda d: fingerprints.imatch(d, max_broadcast_terms=0),
    "simhash": simhash.near_dedup, "cotrain": lambda d: cotraining.cotrain(d, some_labels(d)), "cotrain bare": lambda d: cotraining.cotrain(d, no_labels(d)), "keep good": lambda d: cotraining.keep_good(d, no_labels(d)),
    "pack": packing.pack, "mix": lambda d: mixing.mix_sources(d, epoch="epoch_no"), "licenses": licenses.licenses, "rules": lambda d: quality_rules.score(d, some_labels(d)), "secrets": secrets.secrets,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_edges(edges, clashing, nothing, name):
    run = OPERATORS[name]
    out = run(edges)
    plain = sorted(map(str, out.collect()))
    assert len(plain) or name in ("licenses", "secrets")
    assert run(nothing).collect() == []
    # spread otherwise, and beside columns of the operators' own names
    other = run(clashing.repartition(5, F.rand(3)))
    rows = other.collect()
    extra = [c for c in other.columns if c not in out.columns]
    assert len(extra) == (22 if name in ("lines", "lines drop", "simhash", "keep good", "mix") else 0) and all(r[c] == 7 for r in rows for c in extra)
    assert sorted(str(Row(**{c: r[c] for c in out.columns})) for r in rows) == plain


def test_scores_of_edges(edges):
    for out in (cotraining.cotrain(edges, some_labels(edges)), quality_rules.score(edges, some_labels(edges))):
        rows = out.collect()
        assert len(rows) == edges.count()
        blank = [r for r in rows if r["doc_id"] in (3, 4, 5)]
        assert len(blank) == 3 and not any(r["keep"] for r in blank) and all(r["p_quality"] is None for r in blank)


def test_near_copies_of_edges(edges):
    kept = simhash.near_dedup(edges).collect()
    ids = [r["doc_id"] for r in kept]
    assert ids.count(1) == 1 and 2 not in ids and ids.count(None) == 1  # the copy with a null id goes, the null text stays
    assert (6 in ids) != (7 in ids) and {3, 4, 5, 8} <= set(ids)


def test_lines_of_edges(edges):
    rows = lines.line_dedup(edges, deleted="gone").collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert [r["gone"] for r in by[1]] == [0, 0] and by[2][0]["text"].strip() == "" and by[2][0]["gone"] == 2
    assert by[6][0]["gone"] == 0 and by[7][0]["gone"] >= 1499
    assert len(lines.line_dedup(edges, drop_emptied=True).filter("doc_id = 2").collect()) == 0


def test_mixing_leaves_out_blank_texts(edges):
    ids = {r["doc_id"] for r in mixing.mix_sources(edges, total_tokens=10**6).collect()}
    assert ids.isdisjoint({3, 4, 5}) and {1, 6, None} <= ids


def test_mixing_draws_null_ids_apart(spark):
    rows = [(None, f"text number {i} of several", "en", "a", 9) for i in range(300)] + [(i, f"another {i} of these", "en", "a", 9) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = mixing.mix_sources(docs, total_tokens=600).collect()
    null = [r["text"] for r in got if r["doc_id"] is None]
    assert len(set(null)) == len(null) and 30 < len(null) < 120  # a quarter of all, as of the others


def test_mixing_by_weights_that_crowd(spark):
    """Symbol-heavy texts, equal weights, null weights: the same sums as by sorting all keys."""
    rows = [(i, "{} [] => == ;; | " * 5 + f"x{i}", "en", "code" if i % 2 else "prose", 9) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for weight in (None, F.lit(None), F.lit(1e-9), F.when(F.col("doc_id") % 4 < 2, 1e3).otherwise(1e-3)):
        got = mixing.mix_sources(docs, total_tokens=9000, weight=weight, tokens="t").groupBy("source").agg(F.sum("t").alias("t")).collect()
        assert all(4500 - 31 <= r["t"] <= 4500 for r in got) and len(got) == 2


def test_packing_keeps_large_ids_beside_null_ones(spark):
    ids = [(1 << 53) + 1, (1 << 53) + 3, None, (1 << 62) + 5, -(1 << 62) - 7]
    rows = [(i, "some words to pack", "en", "a", 9) for i in ids]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out) == sorted((i is None, i or 0) for i in ids)


def tables(spark, tmp_path, docs, labels):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels(docs).write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("labels", [no_labels, some_labels])
def test_stages_on_edges(spark, tmp_path, edges, labels):
    at = tables(spark, tmp_path, edges, labels)
    docs = edges
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, at)
        assert out.schema == docs.schema, name
        ids = [r["doc_id"] for r in out.collect()]
        assert set(ids) <= {r["doc_id"] for r in docs.collect()} and len(ids), name
        # each stage on the edges themselves, too
        assert stage(spark, edges, at).schema == edges.schema
        docs = out
    assert corpus_pipeline.run(spark, at).count() > 0


def test_stages_with_clashing_columns(spark, tmp_path, edges, clashing):
    at = tables(spark, tmp_path, clashing, some_labels)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows, plain = stage(spark, clashing, at), stage(spark, edges, at)
        assert rows.columns == clashing.columns, name
        assert sorted(map(str, rows.select(*edges.columns).collect())) == sorted(map(str, plain.collect())), name
        assert all(r[c] == 7 for r in rows.collect() for c in clashing.columns if c not in edges.columns), name


def test_stages_on_an_empty_table(spark, tmp_path, nothing):
    at = tables(spark, tmp_path, nothing, no_labels)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, at).collect() == []
    assert corpus_pipeline.run(spark, at).collect() == []


def test_texts_above_a_slice(spark):
    """Texts of more than the megabyte that array code takes at a time are read whole."""
    r = random.Random(3)
    long = "\n".join(prose(r, 40) for _ in range(5500))
    assert len(long) > 1.1 * common.SLICE_BYTES
    rows = [(1, long, "en", "a", None), (2, prose(r, 30) + "\n" + long, "en", "a", None), (3, prose(r, 60), "en", "a", None), (4, long + f"\npassword = '{r.randbytes(32).hex()}'\nReleased under the MIT License", "en", "b", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {(x["doc_id"], x["license"]) for x in licenses.licenses(docs).collect()} == {(4, "MIT")}
    assert {r["doc_id"] for r in simhash.near_dedup(docs).collect()} == {1, 3}
    got = {r["doc_id"]: r["gone"] for r in lines.line_dedup(docs, deleted="gone").collect()}
    assert got[1] == got[3] == 0 and got[2] == 5500 and got[4] == 5500
    found = {r["doc_id"]: (r["start_word"], r["end_word"]) for r in suffixes.repeated_passages(docs).collect()}
    assert found == {2: (30, 30 + len(long.split())), 4: (0, len(long.split()))}
    assert {r["doc_id"]: r["n_terms"] > 0 for r in fingerprints.imatch(docs, idf_low=0.1).collect()}[4]
    assert sum(r["n_tokens"] for r in packing.pack(docs).collect()) == sum(len(t.split()) for _, t, *_ in rows)
    assert quality_rules.score(docs, some_labels(docs)).count() == cotraining.cotrain(docs, some_labels(docs)).count() == 4
    assert len(secrets.secrets(docs).collect()) == mixing.mix_sources(docs, total_tokens=10**9).filter("doc_id = 4").limit(1).count() == 1
