"""The pipeline's stages one by one against what each must do."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from corpusmill.llm import cotraining, lines, simhash  # noqa: E402

from .test_results import brute_lines, check_packs  # noqa: E402

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    from corpusmill.llm.common import written

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, DIR), "test")
        out.append(docs)
    return out


def test_stages(spark, stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "SimHash near-dedup", "mixing sources to target weights", "packing"]
    for s in stages[1:-1]:
        assert s.schema.simpleString() == stages[0].schema.simpleString()


def test_quality_keeps_clean_documents(spark, stages):
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    kept = {x["doc_id"] for x in stages[1].collect()}
    rows = stages[0].join(labels, "doc_id").collect()
    good, bad = [x for x in rows if x["quality"]], [x for x in rows if not x["quality"]]
    assert np.mean([x["doc_id"] in kept for x in good]) >= 0.95 and np.mean([x["doc_id"] in kept for x in bad]) <= 0.2
    assert kept == {x["doc_id"] for x in cotraining.cotrain(stages[0], labels).collect() if x["keep"]}


def test_lines_by_brute_force(stages):
    rows = sorted(stages[1].collect(), key=lambda x: x["doc_id"])
    want = {x["doc_id"]: t for x, t in zip(rows, brute_lines([x["text"] for x in rows], lines.RARE, lines.LEAST_CHARS, lines.LONG_CHARS), strict=True)}
    got = {x["doc_id"]: x["text"] for x in stages[2].collect()}
    # a document that loses every line goes; one that was kept reads as brute force says
    assert got == {d: t for d, t in want.items() if t.strip()}
    assert all(x["n_chars"] == len(x["text"]) for x in stages[2].collect())


def test_near_copies_by_brute_force(stages):
    rows = sorted(stages[2].collect(), key=lambda x: x["doc_id"])
    prints, has = simhash.fingerprints(pa.array([x["text"] for x in rows]))
    group = list(range(len(rows)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(prints[i + 1 :] ^ prints[i]).sum(1) <= simhash.ACCEPT):
            a, b = sorted((root(i), root(i + 1 + int(j))))
            group[b] = a
    want = {rows[i]["doc_id"] for i in range(len(rows)) if root(i) == i}
    got = {x["doc_id"] for x in stages[3].collect()}
    assert got == want


def test_mixture_and_packs(stages):
    before, after = stages[3].collect(), stages[4].collect()
    size = lambda rows: sum(len(x["text"].split()) for x in rows)
    assert size(after) <= size(before) and size(after) > 0.6 * size(before)
    assert {x["doc_id"] for x in after} <= {x["doc_id"] for x in before}
    tokens = Counter()
    for x in after:
        tokens[x["doc_id"]] += len(x["text"].split())
    check_packs(stages[5].collect(), tokens, 2048)
    assert corpus_pipeline.ORACLE_SQL is None


def test_run_gives_the_last_stage(spark, stages):
    assert sorted(map(str, corpus_pipeline.run(spark, DIR).collect())) == sorted(map(str, stages[-1].collect()))
