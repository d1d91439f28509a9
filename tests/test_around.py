"""Pipelines, graphs, programs, plugins, files, inspection, synthesis."""

import json

import pytest

from corpusmill import Dataset, Pipeline
from corpusmill.dag import Graph
from corpusmill.dsl import parse
from corpusmill.enrich import Synthesizer, annotate, augment
from corpusmill.errors import PipelineError, SchemaError
from corpusmill.inspect import diff, diff_summary, metrics, profile, statistics, summary, text_statistics
from corpusmill.pipeline import step
from corpusmill.plugins import Dependency, PluginManifest, Runtime, satisfies
from corpusmill.sources import detect, read, read_envelope, write, write_envelope
from corpusmill.sources.formats import by_content, by_name
from corpusmill.sources.manifest import Manifest
from corpusmill.versions import VersionStore, dataset_hash


def at(field):
    return {"path": f"payload.{field}"}


@pytest.fixture
def docs(spark):
    return Dataset.of(spark.createDataFrame([("a", "hello world", 1), ("b", "bad", 2), ("c", None, None)], "id string, text string, n int"), id="id")


LONG = step("filter.length_range", at("text") | {"min": 5})


def test_pipeline(docs):
    assert Pipeline([LONG]).run(docs).df.count() == 1
    p = Pipeline([{"if": [LONG], "then": [step("limit", {"count": 2})], "else": []}])
    assert p.run(docs).df.count() == 2
    assert Pipeline([{"parallel": [[LONG], [step("limit", {"count": 2})]]}]).run(docs).df.count() == 3
    for wrong in ([], [{"parallel": []}], [{"operator": 3}], [{"x": 1}]):
        with pytest.raises(PipelineError):
            Pipeline(wrong)
    out, seen = Pipeline([LONG]).observed(docs)
    out.df.collect()
    assert seen[0][1].get["rows"] == 1
    a = Pipeline([LONG]).cached(docs, "v1").df
    assert a.collect() == Pipeline([LONG]).cached(docs, "v1").df.collect()
    assert Pipeline([LONG]).timed(docs)[1]["rows"] == 1


def test_graph(docs):
    g = Graph().add("a", "limit", {"count": 1}).add("b", LONG["operator"], LONG["config"]).add("c", "limit", {"count": 9}, cache=True)
    g.edge("a", "c").edge("b", "c")
    assert g.levels() == [["a", "b"], ["c"]] and g.run(docs).df.count() == 2
    g.edge("c", "a")
    with pytest.raises(PipelineError):
        g.order()


def test_programs(docs):
    lines = parse('# comment\n$n=2\nlimit count=$n\nfilter.contains path=payload.text contains="hello world"')
    assert lines.compile().run(docs).df.count() == 1
    yaml = parse("steps:\n  - operator: limit\n    config: {count: 2}\n")
    assert yaml.compile().run(docs).df.count() == 2
    assert parse(yaml.to_json()).steps == yaml.steps
    loose = parse(json.dumps({"steps": [{"config": {}}, step("limit", {"count": 1})]}), strict=False)
    assert len(loose.steps) == 1 and loose.warnings
    with pytest.raises(PipelineError):
        parse("limit count=$none")


def test_plugins(docs):
    m = PluginManifest("shout", "1.2.0", operators=("shout.loud",), dependencies=(Dependency("base", "^1.0"),))
    assert PluginManifest.from_json(m.to_json()) == m
    r = Runtime()
    with pytest.raises(PipelineError):
        r.load(m, {"shout.loud": lambda ds, c: ds})
    r.load(PluginManifest("base", "1.4.0"), {})
    seen = []
    r.load(m, {"shout.loud": lambda ds, c: seen.append(set(ds.meta)) or ds})
    from pyspark.sql import functions as F

    Pipeline([step("shout.loud", {})]).run(docs.put_meta("pii", F.lit(1)).put_meta("x", F.lit(2)))
    assert seen == [{"x"}] and r.audit[0]["hidden"] == ["pii"]
    with pytest.raises(PipelineError):
        r.unload("base")
    r.unload("shout")
    assert satisfies("1.2.3", ">=1.0, <2") and not satisfies("2.0.0", "^1.0") and satisfies("0.3.1", "~0.3")


@pytest.mark.parametrize("format", ["jsonl", "json", "csv", "parquet"])
@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_files_round_trip(spark, tmp_path, docs, format, compression):
    path = str(tmp_path / "out")
    done = write(docs.df.coalesce(1), path, format, compression)
    assert done.rows == 3 and done.bytes > 0
    schema = docs.df.schema if format in ("json", "jsonl") else None
    back = read(spark, path, format, schema=schema).df
    assert sorted(str(r["text"]) for r in back.collect()) == ["None", "bad", "hello world"]


@pytest.mark.parametrize("format", ["jsonl", "csv", "parquet"])
def test_envelopes_round_trip(spark, tmp_path, docs, format):
    from pyspark.sql import functions as F

    path = str(tmp_path / "out")
    write_envelope(docs.put_meta("lang", F.lit("en")), path, format)
    back = read_envelope(spark, path, "text string, n int", "lang string", format)
    assert sorted((r["id"], str(r["text"]), r[back.meta["lang"]]) for r in back.df.collect()) == [("a", "hello world", "en"), ("b", "bad", "en"), ("c", "None", "en")]


def test_bad_lines_and_comments(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\nnot json\n# comment\n{"id": "r", "payload": {"a": 2}}\n')
    path = str(tmp_path / "x.jsonl")
    assert read(spark, path, schema="a int", skip_errors=True).df.count() == 2
    with pytest.raises(SchemaError):
        read(spark, path, schema="a int", skip_errors=True, max_errors=1)
    env = read_envelope(spark, path, "a int", allow_comments=True, skip_errors=True)
    assert sorted((str(r["id"]), r["a"]) for r in env.df.collect()) == [("None", 1), ("r", 2)]


def test_formats(spark, tmp_path):
    assert by_name("x/a.jsonl.gz").compression == "gzip" and by_name("b.pq").name == "parquet" and by_name("c.txt") is None
    assert by_content(b'{"a":1}\n{"b":2}').name == "jsonl" and by_content(b"[1]").name == "json" and by_content(b"a,b,c\n1,2,3").name == "csv" and by_content(b"PAR1").name == "parquet"
    (tmp_path / "f.data").write_text("a,b,c\n1,2,3\n")
    assert detect(spark, str(tmp_path / "f.data")).name == "csv"


def test_manifest_and_versions(spark, tmp_path, docs):
    path = str(tmp_path / "out")
    write(docs.df.repartition(2), path, rows_per_file=2)
    m = Manifest("d").add_folder(spark, path, "parquet").add_source("crawl").add_transform("limit", {"count": 3}).seal()
    assert m.stats["records"] == 3 and Manifest.from_json(m.to_json()) == m and m.verify() == []
    m.files[0].hash = "0"
    assert m.verify() != []
    assert dataset_hash(docs.df) == dataset_hash(docs.df.repartition(3)) != dataset_hash(docs.df.limit(2))
    s = VersionStore()
    a = s.create(docs.df, metrics={"q": 1.0})
    b = s.create(docs.df.limit(1), Pipeline([LONG]), a.id, metrics={"q": 3.0})
    s.save(tmp_path / "v.json")
    assert [v.id for v in VersionStore.load(tmp_path / "v.json").history(b.id)] == [b.id, a.id]
    assert s.compare(a.id, b.id) == {"data": True, "code": True, "environment": False, "metrics": {"q": 2.0}}


def test_inspection(spark, docs):
    assert metrics(docs).first()["total_records"] == 3
    p = {r["field"]: r for r in profile(docs.df).collect()}
    assert p["text"]["null_count"] == 1 and p["n"]["mean"] == 1.5 and p["text"]["anomalies"] == ["elevated_null_rate"]
    assert summary(docs.df).first()["duplicate_count"] == 0
    s = {r["field"]: r for r in statistics(docs.df).collect()}
    assert s["n"]["p50"] == 2.0 and s["text"]["max"] == 11
    t = text_statistics(docs.df.select("text"))
    assert t["totals"].first()["chars"] == 14 and {r["x"]: r["n"] for r in t["chars"].collect()}["l"] == 3
    new = spark.createDataFrame([("a", "hello worlds", 1), ("c", None, None), ("d", "x", 4)], docs.df.schema)
    changes = diff(docs.df, new, "id")
    assert {r["id"]: r["change"] for r in changes.collect()} == {"a": "modified", "b": "removed", "c": "unchanged", "d": "added"}
    assert diff_summary(changes).first()["similarity_score"] == 0.5


def test_enrichment(spark, docs):
    s = Synthesizer(5, "rule", rules={"i": ("RandomInt", {"min": 3, "max": 4}), "s": ("RandomString", {"length": 6}), "q": ("Sequence", {"start": 10, "step": 5}), "c": ("RandomChoice", {"options": ["x", "y"]}), "f": ("RandomFloat", {"min": 0, "max": 1, "precision": 2}), "b": ("RandomBool", {"probability": 1.0}), "u": ("UUID", {}), "d": ("RandomDate", {}), "k": ("Faker", {"faker_type": "name"})})
    got = s.run(spark).df.orderBy("index").collect()
    assert [r["q"] for r in got] == [10, 15, 20, 25, 30] and all(r["i"] in (3, 4) and len(r["s"]) == 6 and r["b"] and r["d"] == "2024-01-01" and r["k"] == "fake_name" for r in got)
    assert got == s.run(spark).df.orderBy("index").collect()
    t = Synthesizer(2, template="n {{index}} {name}", variables={"name": "v"}).extend(docs)
    assert "n 1 v" in [r["text"] for r in t.df.collect()]
    assert Synthesizer(3, "hybrid", template="x", rules={"text": ("Faker", {"faker_type": "t"})}).run(spark).df.count() == 3
    asked = Synthesizer(2, "llm", template="{{index}}", complete=lambda xs: [x + "!" for x in xs]).run(spark)
    assert sorted(r["text"] for r in asked.df.collect()) == ["0!", "1!"]
    out = augment(docs, [("Duplicate", {"count": 2}), ("Noise", {"ratio": 0.5}), ("Shuffle", {})])
    assert out.df.count() == 15 and "a_dup_1" in [r["id"] for r in out.df.collect()]
    assert annotate(docs, "Score", "s").df.filter("id = 'a'").first()["score_s"] == 0.013
