"""Operators on small literal tables."""

import random

import pytest
from pyspark.sql import functions as F

from corpusmill import ConfigError, Dataset, SchemaError, apply_operator, names
from corpusmill.dataset import quoted
from corpusmill.errors import OperatorError
from corpusmill.pipeline import step


ANSWER = "<|im_start|>assistant\n"


def at(field):
    return {"path": f"payload.{field}"}


def some(*fields):
    return [f"payload.{f}" for f in fields]


def ds(spark, rows, schema, **kw):
    return Dataset.of(spark.createDataFrame(rows, schema), **kw)


def values(out, column):
    return [r[0] for r in out.df.select(quoted(column)).collect()]


def run(data, name, config):
    return apply_operator(data, name, config)


def meta(out, key):
    return values(out, out.meta[key])


def test_all_operators_are_there():
    assert len(set(names()) - {"split.k_fold"}) == 90


TEXT = "id long, text string"


@pytest.mark.parametrize(("name", "config", "schema", "data", "kept"), [
    ("filter.equals", at("text") | {"equals": "hello"}, TEXT, [(1, "hello"), (2, "world"), (3, None)], [1]),
    ("filter.not_equals", at("text") | {"equals": "hello"}, TEXT, [(1, "hello"), (2, "world"), (3, None)], [2, 3]),
    ("filter.equals", at("v") | {"equals": 1}, "id long, v double", [(1, 1.0)], []),
    ("filter.equals", at("v") | {"equals": 1.0}, "id long, v double", [(1, 1.0)], [1]),
    ("filter.equals", at("nothing") | {"equals": 1}, TEXT, [(1, "a")], []),
    ("filter.not_equals", at("nothing") | {"equals": 1}, TEXT, [(1, "a")], [1]),
    ("filter.any", {"paths": some("a", "b"), "equals": "x"}, "id long, a string, b string, c string", [(1, "x", None, None), (2, None, "x", None), (3, None, None, "x")], [1, 2]),
    ("filter.contains", at("text") | {"contains": "WORLD", "case_insensitive": True}, TEXT, [(1, "hello world"), (2, "goodbye")], [1]),
    ("filter.starts_with", at("text") | {"prefix": "hello"}, TEXT, [(1, "hello world"), (2, "world hello")], [1]),
    ("filter.ends_with", at("text") | {"suffix": "hello"}, TEXT, [(1, "hello world"), (2, "world hello")], [2]),
    ("filter.regex", at("text") | {"pattern": r"^\S+@\S+\.\S+$"}, TEXT, [(1, "email@test.com"), (2, "not an email")], [1]),
    ("filter.greater_than", at("score") | {"threshold": 7}, "id long, score long", [(1, 10), (2, 5), (3, None)], [1]),
    ("filter.less_than", at("score") | {"threshold": 7}, "id long, score long", [(1, 10), (2, 5), (3, None)], [2]),
    ("filter.between", at("score") | {"min": 5, "max": 12}, "id long, score long", [(1, 10), (2, 5), (3, 15)], [1, 2]),
    ("filter.range", at("score") | {"max": 9.5}, "id long, score long", [(1, 10), (2, 5), (3, None)], [2]),
    ("filter.in", at("c") | {"values": [*"red blue".split(), 1]}, "id long, c string", [(1, "red"), (2, "blue"), (3, "green"), (4, None)], [1, 2]),
    ("filter.not_in", at("c") | {"values": "red blue".split()}, "id long, c string", [(1, "red"), (2, "blue"), (3, "green"), (4, None)], [3, 4]),
    ("filter.is_null", at("text"), TEXT, [(1, None), (2, "hello")], [1]),
    ("filter.is_null", at("nothing") | {"include_missing": False}, TEXT, [(1, None)], []),
    ("filter.exists", at("text"), TEXT, [(1, None), (2, "hello")], [2]),
    ("filter.not_exists", at("text"), TEXT, [(1, None), (2, "hello")], [1]),
    ("filter.length_range", at("text") | {"min": 3, "max": 8}, TEXT, [(1, "hi"), (2, "hello"), (3, "hello world"), (4, "äöü")], [2, 4]),
    ("filter.token_range", at("text") | {"min": 2, "max": 4}, TEXT, [(1, "hi"), (2, "hello  world"), (3, "a b c d e")], [2]),
    ("filter.contains_all", at("tags") | {"contains_all": ["a", "b"]}, "id long, tags array<string>", [(1, ["a", "b", "c"]), (2, ["a", "b"]), (3, ["c"]), (4, None)], [1, 2]),
    ("filter.contains_any", at("tags") | {"contains_any": ["vip"]}, "id long, tags array<string>", [(1, ["vip", "gold"]), (2, ["basic"]), (3, [])], [1]),
    ("filter.contains_none", at("text") | {"contains_none": ["bad", "spam"]}, TEXT, [(1, "clean text"), (2, "bad content"), (3, None)], [1, 3]),
    ("filter.array_contains", at("tags") | {"element": "a"}, "id long, tags array<string>", [(1, ["a"]), (2, ["b"]), (3, None), (4, [None])], [1, 3]),
    ("field.require", {"fields": some("a", "b")}, "id long, a string, b string", [(1, "x", "y"), (2, "x", None)], [1]),
    ("token.filter", {"text_field": "payload.text", "min_tokens": 2}, TEXT, [(1, "a b"), (2, "a"), (3, None)], [1]),
    ("llm.context_length", {"min_tokens": 3, "max_tokens": 10}, TEXT, [(1, "a b c"), (2, "a"), (3, None)], [1]),
    ("limit", {"count": 2}, TEXT, [(3, "c"), (1, "a"), (2, "b")], [1, 2]),
])
def test_rows_that_stay(spark, name, config, schema, data, kept):
    assert sorted(values(run(ds(spark, data, schema, id="id"), name, config), "id")) == kept


@pytest.mark.parametrize(("name", "config"), [
    ("filter.between", at("text") | {"min": 3, "max": 2}), ("filter.range", at("text")), ("filter.equals", {"path": "text", "equals": 1}), ("filter.equals", at("text")),
    ("filter.in", at("text") | {"values": []}), ("limit", {"count": "1"}), ("limit", {"count": True}), ("sample.random", {}), ("sample.random", {"ratio": 2}), ("split.random", {"ratios": [0.5, 0.4], "names": ["a", "b"]}),
    ("split.kfold", {"k": 1}), ("transform.map", at("text") | {"transform": "Nothing"}), ("filter.regex", at("text") | {"pattern": "a(?=b)"}), ("no.such", {}), ("metadata.keep", {"keys": []}),
    ("llm.context_length", {"action": {"Split": {"max_tokens": 5, "overlap": 5}}}), ("token.count", {"tokenizer_type": "other"}), ("token.count", {"tokenizer_type": "cl100k_base", "vocabulary": "/nothing"}),
])
def test_wrong_config(spark, name, config):
    with pytest.raises(ConfigError):
        run(ds(spark, [(1, "a")], TEXT, id="id"), name, config)


def test_filters_reach_the_scan(spark):
    out = run(Dataset.of(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), id="doc_id"), "filter.in", at("lang") | {"values": ["en", "de"]})
    plan = out.df.select("doc_id")._jdf.queryExecution().toString()
    assert "PushedFilters: [In(lang, [de,en])" in plan
    assert "text" not in plan.split("ReadSchema")[1]


def test_metadata(spark):
    d = ds(spark, [(1, "x", "y", 3)], "id long, a string, b string, n int", id="id", metadata=("a", "b"))
    out = run(d, "metadata.rename", {"keys": {"a": "b", "b": "a"}})
    assert (meta(out, "a"), meta(out, "b")) == (["y"], ["x"])
    assert set(run(d, "metadata.keep", {"keys": ["b"]}).meta) == {"b"}
    assert meta(run(d, "metadata.enrich", {"entries": {"n": 7}}), "n") == [7]  # payload has an n of its own
    assert values(run(d, "metadata.enrich", {"entries": {"n": 7}}), "n") == [3]
    with pytest.raises(SchemaError):
        run(d, "metadata.require", {"keys": ["c"]})
    out = run(d, "metadata.extract", {"keys": {"payload.n": "count", "payload.none": {"name": "z", "default": "q"}}})
    assert (meta(out, "count"), meta(out, "z")) == ([3], ["q"])
    out = run(d, "metadata.extract", {"keys": {"payload.none": "z"}})
    with pytest.raises(Exception, match="nothing to extract"):
        out.df.collect()


def test_transforms(spark):
    d = ds(spark, [(1, "  Hello   WORLD ", 1.0), (2, None, None)], "id long, text string, v double", id="id")
    assert values(run(d, "transform.normalize", at("text") | {"lowercase": True}), "text") == ["hello world", None]
    t = ds(spark, [(1, "John", 30)], "id long, name string, age int", id="id")
    assert values(run(t, "transform.template", {"template": "{{payload.name}} is {{payload.age}} {{payload.no}} {{other}}", "output_field": "payload.g"}), "g") == ["John is 30 {{payload.no}} {{other}}"]
    assert values(run(t, "transform.map", at("name") | {"transform": {"RegexReplace": {"pattern": "(o)(h)", "replacement": "$2$1"}}}), "name") == ["Jhon"]
    assert values(run(t, "transform.map", at("age") | {"transform": "Uppercase"}), "age") == [30]
    assert values(run(t, "transform.map", at("name") | {"transform": "JsonStringify"}), "name") == ['"John"']
    n = ds(spark, [(1, [1, 2]), (2, []), (3, None)], "id long, xs array<int>", id="id")
    assert sorted(map(str, values(run(n, "transform.flat_map", at("xs") | {"output_field": "payload.x"}), "x"))) == ["1", "2", "None"]
    c = ds(spark, [(1, None, "fallback")], "id long, a string, b string", id="id")
    assert values(run(c, "transform.coalesce", {"paths": some("a", "b"), "output_field": "payload.o"}), "o") == ["fallback"]


def test_fields(spark):
    d = ds(spark, [(1, (2, (3, "x")))], "id long, o struct<a:int,b:struct<c:int,d:string>>", id="id")
    out = run(d, "field.flatten", {"field": "payload.o"})
    assert sorted(out.payload) == ["id", "o_a", "o_b_c", "o_b_d"]
    out = run(d, "field.copy", {"source": "payload.o.b.d", "target": "metadata.d"})
    assert meta(out, "d") == ["x"]
    assert run(d, "field.move", {"source": "payload.o", "target": "payload.p"}).payload == ["id", "p"]
    assert run(d, "field.rename", {"mappings": {"payload.o": "payload.p"}}).payload == ["id", "p"]
    assert run(d, "field.select", {"fields": ["o"], "mode": "Exclude"}).payload == ["id"]
    assert values(run(d, "field.default", {"field": "payload.z", "default_value": 5}), "z") == [5]


def numbers(spark, n=100):
    return ds(spark, [(i, "abc"[i % 3] if i % 7 else None, float(i)) for i in range(n)], "id long, g string, v double", id="id", metadata=("v",))


def test_samples_and_splits(spark):
    d = numbers(spark)
    assert run(d, "sample.random", {"ratio": 0.5, "seed": 1}).df.count() == 50
    assert run(d, "sample.random", {"count": 7, "weight_key": "v"}).df.count() == 7
    assert run(d, "sample.random", {"count": 1000}).df.count() == 100
    assert sorted(values(run(d, "sample.top", {"key": "v", "count": 2}), "id")) == [98, 99]
    counts = {r["g"]: r["count"] for r in run(d, "sample.balanced", {"label_field": "payload.g", "strategy": "oversample"}).df.groupBy("g").count().collect()}
    assert len(set(counts.values())) == 1
    assert run(d, "sample.by_distribution", {"field": "payload.g", "target_distribution": {"a": 1, "b": 1}, "total_count": 20}).df.count() == 20
    assert run(d, "sample.stratified", {"field": "payload.g", "count": 10}).df.count() <= 10
    out = run(d, "split.random", {"ratios": [0.8, 0.2], "names": ["a", "b"]})
    assert sorted(values(out, out.meta["split"])).count("a") == 80
    folds = meta(run(d, "split.k_fold", {"k": 7}), "fold_index")
    assert sorted(folds.count(i) for i in range(7)) == [14] * 5 + [15] * 2
    assert meta(run(d, "split.chunk", {"chunk_size": 30}), "total_chunks")[0] == 4
    from corpusmill.operators.split import parts

    assert {k: p.df.count() for k, p in parts(run(d, "split.sequential", {"test_size": 0.25}), ["train", "test"]).items()} == {"train": 75, "test": 25}


@pytest.mark.parametrize(("name", "config"), [("shuffle", {"seed": 1}), ("shuffle", {"algorithm": "Block", "block_size": 10}), ("shuffle.stratified", {"field": "g"}), ("shuffle.window", {"window_size": 6})])
def test_shuffles_are_permutations(spark, name, config):
    from corpusmill.operators.shuffle import ordered

    d = numbers(spark)
    out = run(d, name, config)
    ids = [r["id"] for r in ordered(out).collect()]
    assert sorted(ids) == list(range(100)) and ids != list(range(100))
    if name == "shuffle.window":
        assert all(abs(i - x) < 6 for i, x in enumerate(ids))
    again = run(d.on(d.df.repartition(5)), name, config)
    assert [r["id"] for r in ordered(again).collect()] == ids


def test_empty_table(spark):
    d = ds(spark, [], "id long, text string, g string", id="id")
    for name, config in [("sample.random", {"ratio": 0.5}), ("split.random", {"test_size": 0.5}), ("split.chunk", {"chunk_size": 2}), ("shuffle", {}), ("token.stats", {}), ("token.histogram", {}), ("dedup.simhash", at("text")), ("dedup.minhash", at("text")), ("dedup.semantic", at("text")), ("quality.score", at("text")), ("merge.batch", {}), ("distribution.correlation", {"field_x": "id", "field_y": "id"}), ("sample.balanced", {"label_field": "payload.g"})]:
        assert run(d, name, config).df.count() == 0, name


def test_merges(spark):
    a = ds(spark, [(1, "x"), (2, "y")], "id long, text string", id="id")
    b = ds(spark, [(3, "x", 1)], "id long, text string, n int", id="id")
    out = run(a, "merge.concat", {"inputs": [b]})
    assert sorted(map(str, values(out, "n"))) == ["1", "None", "None"]
    with pytest.raises(SchemaError):
        run(a, "merge.concat", {"inputs": [b], "field_mode": "Strict"})
    assert sorted(values(run(a, "merge.union", {"inputs": [b], "key_field": "text"}), "id")) == [1, 2]
    assert values(run(a, "merge.intersect", {"inputs": [b], "key_field": "text"}), "id") == [1]
    assert values(run(a, "merge.difference", {"inputs": [b], "key_field": "text"}), "id") == [2]
    c = ds(spark, [(1, 1, "a", None), (1, 2, "b", 5), (2, 3, "c", 6)], "id long, o long, t string, n int", id="id", order="o")
    got = {r["id"]: (r["t"], r["n"]) for r in run(c, "merge.batch", {"conflict_strategy": "Last"}).df.collect()}
    assert got == {1: ("b", 5), 2: ("c", 6)}
    with pytest.raises(Exception, match="field conflict"):
        run(c, "merge.batch", {"conflict_strategy": "Error"}).df.collect()
    assert values(run(a, "merge.zip", {}), "text") == [["x", "y"]]


def test_language(spark):
    d = ds(spark, [(1, "Hello world, this is the end and that was the thing"), (2, "你好世界"), (3, "  "), (4, "это просто русский текст"), (5, None)], TEXT, id="id")
    got = dict(zip(values(d, "id"), meta(run(d, "lang.detect", at("text")), "lang"), strict=True))
    assert got == {1: "en", 2: "zh", 3: "und", 4: "ru", 5: None}


def test_quality(spark):
    d = ds(spark, [(1, "A sentence of plain words, and another one."), (2, ""), (3, None), (4, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa")], TEXT, id="id")
    out = run(d, "quality.score", at("text") | {"details_key": "parts"})
    q = meta(out, "quality")
    assert 0.8 < q[0] <= 1 and q[1] == 0 and q[2] is None and q[3] < q[0]
    t = meta(run(ds(spark, [(1, "you are an IDIOT"), (2, "not an idiot"), (3, "1d10t"), (4, "fine")], TEXT, id="id"), "quality.toxicity", at("text")), "toxicity")
    assert t[0] > t[1] > 0 and t[2] > 0 and t[3] == 0


def test_redaction(spark):
    d = ds(spark, [(1, "My email is test@example.com"), (2, "see http://a.b/c or call 12345678901"), (3, "mine@ok.org and yours@ok.org"), (4, None)], TEXT, id="id")
    got = values(run(d, "pii.redact", at("text") | {"store_key": "log", "allowlist": ["mine@ok.org"]}), "text")
    assert got[0] == "My email is <EMAIL>" and got[1] == "see <URL> or call 12****01" and got[2] == "mine@ok.org and <EMAIL>" and got[3] is None
    out = run(d, "pii.redact", at("text") | {"store_key": "log"})
    assert meta(out, "log")[0][0]["original"] == "test@example.com"
    out = values(run(d, "pii.redact", at("text") | {"custom": [{"tag": "x", "pattern": "call", "strategy": "hash", "prefix": 1, "suffix": 1}]}), "text")[1]
    assert out.startswith("see <URL> or c<") and ">l 12" in out


def test_prompts(spark):
    d = ds(spark, [(1, ("be kind", ["hi", "hello", "bye"])), (2, None)], "id long, conversation struct<system:string,turns:array<string>>", id="id")
    got = values(run(d, "llm.conversation_format", {"format": "ChatML"}), "messages")
    assert [m["role"] for m in got[0]] == ["system", "user", "assistant", "user"] and got[1] == []
    q = ds(spark, [(1, "Q: one?\nA: yes\nmore\nQ: two?\nA: no"), (2, "## Question: what? ## Answer: that"), (3, "Q1: a A1: b")], TEXT, id="id")
    got = [[tuple(p) for p in x] for x in values(run(q, "llm.qa_extract", {}), "qa_pairs")]
    assert got == [[("one?", "yes more"), ("two?", "no")], [("## Question: what?", "## Answer: that")], [("a", "b")]]
    i = ds(spark, [(1, "do", ""), (2, "do", "it")], "id long, instruction string, input string", id="id")
    got = values(run(i, "llm.instruction_format", {"input_field": "payload.input", "format": "ChatML"}), "formatted")
    assert got == ["<|im_start|>user\ndo<|im_end|>\n" + ANSWER, "<|im_start|>user\ndo\n\nit<|im_end|>\n" + ANSWER]
    long = ds(spark, [("a", "word " * 100), ("b", "short")], "id string, text string", id="id")
    out = run(long, "llm.context_length", {"action": {"Split": {"max_tokens": 50, "overlap": 10}}})
    assert sorted(values(out, "id"))[:2] == ["a_chunk_0", "a_chunk_1"] and "b" in values(out, "id")


def brute_semantic(texts, threshold):
    import math
    from collections import Counter

    from corpusmill.functions.kernels import tokens

    toks = [tokens(t) for t in texts]
    df = Counter(w for t in toks for w in set(t))
    n = sum(1 for t in toks if t)
    vec = []
    for t in toks:
        v = {w: c / len(t) * (math.log((n + 1) / (df[w] + 1)) + 1) for w, c in Counter(t).items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1
        vec.append({w: x / norm for w, x in v.items()})
    kept = []
    for i, v in enumerate(vec):
        if not v or all(sum(x * vec[j].get(w, 0) for w, x in v.items()) < threshold for j in kept):
            kept.append(i)
    return kept


def test_near_duplicates_against_brute_force(spark):
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(60):
        base = [r.choice(vocabulary) for _ in range(r.randint(3, 30))]
        texts.append(" ".join(base))
        for _ in range(r.randint(0, 2)):
            texts.append(" ".join(w if r.random() < 0.85 else r.choice(vocabulary) for w in base))
    texts += ["", "!!!", texts[0]]
    d = ds(spark, [*enumerate(texts), (len(texts), None)], TEXT, id="id")
    for threshold in (0.6, 0.8):
        assert sorted(values(run(d, "dedup.semantic", at("text") | {"threshold": threshold}), "id")) == [*brute_semantic(texts, threshold), len(texts)]
    import pyarrow as pa

    from corpusmill.functions import kernels

    h = [x % (1 << 64) for x in kernels.simhash(pa.array(texts)).to_pylist()]
    for threshold in (0.85, 0.95):
        kept = []
        for i, x in enumerate(h):
            if all(1 - (x ^ h[j]).bit_count() / 64 < threshold for j in kept):
                kept.append(i)
        assert sorted(values(run(d, "dedup.simhash", at("text") | {"threshold": threshold}), "id")) == [*kept, len(texts)]
    out = run(d, "dedup.semantic", at("text") | {"threshold": 0.8, "details_key": "gone"})
    assert sum(len(x or []) for x in meta(out, "gone")) == len(texts) - len(brute_semantic(texts, 0.8))


def test_greedy_in_one_task_and_in_rounds(spark):
    from corpusmill.operators.dedup import later_of_greedy

    r = random.Random(1)
    edges = {tuple(sorted(r.sample(range(80), 2))) for _ in range(120)}
    gone = set()
    for b in range(80):
        if any((a, b) in edges and a not in gone for a in range(b)):
            gone.add(b)
    df = spark.createDataFrame(sorted(edges), "a long, b long")
    for most in (0, 1000):
        assert {x["o"] for x in later_of_greedy(df, most).collect()} == gone


def test_streams_take_row_wise_operators_only(spark, tmp_path):
    from corpusmill import Pipeline
    from corpusmill.streaming import apply, window_counts

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    path = str(tmp_path / "in")
    events.write.parquet(path)
    stream = spark.readStream.schema(events.schema).parquet(path)
    out = apply(stream, Pipeline([step("filter.equals", at("event_type") | {"equals": "view"})]), id="event_id")
    q = out.df.writeStream.format("memory").queryName("views").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert spark.table("views").count() == events.filter("event_type = 'view'").count()
    with pytest.raises(OperatorError):
        apply(stream, Pipeline([step("limit", {"count": 1})]), id="event_id")
    assert window_counts(events, "ts", "event_type", "1 day").agg({"n": "sum"}).first()[0] == events.count()


def test_the_simhash_query_has_the_default_threshold(spark):
    import pyarrow as pa

    from corpusmill.functions import kernels
    from corpusmill.plans import queries

    sf_dir = "/root/testdata/sf0.001"
    rows = sorted((x["doc_id"], x["text"]) for x in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if x["text"] is not None)
    kept: list[tuple[int, int]] = []
    for (i, _), x in zip(rows, kernels.simhash(pa.array([t for _, t in rows])).to_pylist(), strict=True):
        if all(1 - ((x ^ y) % (1 << 64)).bit_count() / 64 < 0.85 for _, y in kept):
            kept.append((i, x))
    got = queries.QUERIES["dedup_simhash"](spark, sf_dir).join(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id").select("doc_id").collect()
    assert sorted(x["doc_id"] for x in got) == [i for i, _ in kept]


def test_summaries_of_few_numbers(spark):
    from corpusmill.inspect import statistic_summary

    for n in (0, 1, 3, 4, 19, 20, 99, 100):
        x = sorted(float((i * 7) % 31) for i in range(n))
        [got] = statistic_summary(spark.createDataFrame([(v,) for v in x] + [(None,)], "v double"), "v").collect()
        if not n:
            assert set(got) == {0}
            continue
        mean = sum(x) / n
        place = lambda p, least: x[int(n * p)] if n >= least else x[-1]
        want = (n, mean, (sum((v - mean) ** 2 for v in x) / n) ** 0.5, x[0], x[-1], x[n // 2], place(0.25, 4), place(0.75, 4), place(0.95, 20), place(0.99, 100))
        assert all(abs(a - b) < 1e-9 for a, b in zip(got, want, strict=True))


def test_covering_masks():
    from itertools import combinations

    from corpusmill.operators.dedup import covering_masks

    r = random.Random(2)
    for distance in (0, 1, 2, 3, 9, 14, 20):
        masks = covering_masks(distance)
        some = list(combinations(range(64), distance)) if distance < 3 else [r.sample(range(64), distance) for _ in range(3000)]
        assert all(any(not m & sum(1 << b for b in bits) for m in masks) for bits in some)


def test_redaction_plans_grow_with_the_rules(spark):
    from corpusmill.operators.redact import RULES, Rule, redact

    df = spark.createDataFrame([("mail a@b.org or call 4912345678901",)], "t string")
    for n in (0, 2, 4):
        rules = [*RULES, *(Rule(f"r{i}", f"x{i}y", "mask") for i in range(n))]
        for logged in (False, True):
            text, log = redact(F.col("t"), rules, [], logged)
            out = df.select(text.alias("t"), log.alias("m"))
            plan = out._jdf.queryExecution().optimizedPlan().toString()
            assert plan.count("a-z]{2,}") <= 4
            assert out.collect()[0]["t"].startswith("mail <EMAIL> or call 49")


@pytest.mark.parametrize("seed", range(3))
def test_greedy_in_one_task_and_in_rounds(spark, seed):
    from corpusmill.operators.dedup import later_of_greedy

    r = random.Random(seed)
    edges = {tuple(sorted(r.sample(range(60), 2))) for _ in range(r.choice((20, 90, 300)))}
    dropped = set()
    for a, b in sorted(edges, key=lambda e: (e[1], e[0])):
        if a not in dropped:
            dropped.add(b)
    df = spark.createDataFrame(sorted(edges), "a long, b long")
    for bound in (0, 10**6):
        assert {x["o"] for x in later_of_greedy(df, bound).collect()} == dropped


def test_chunks_dont_change_results(spark):
    from corpusmill.errors import ConfigError
    from corpusmill.pipeline import Pipeline, step

    docs = spark.createDataFrame([(i, f"text {i % 3}") for i in range(9)], "id long, text string")
    run = Pipeline([step("dedup.simhash", {"path": "payload.text", "threshold": 1.0})])
    assert run.run_chunked(docs, 2).df.count() == run.run(docs).df.count() == 3
    with pytest.raises(ConfigError):
        run.run_chunked(docs, 0)


def test_signatures_that_are_all_near_are_scanned_in_rounds(spark):
    from corpusmill.operators.dedup import later_of_signatures

    r = random.Random(5)
    h = [sum(1 << b for b in r.sample(range(64), r.randint(0, 12))) for _ in range(500)]
    kept: list[int] = []
    for i, x in enumerate(h):
        if all((x ^ h[j]).bit_count() > 9 for j in kept):
            kept.append(i)
    nodes = spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for i, x in enumerate(h)], "o long, h long")
    for most in (7, 100, 1000):
        gone = [x["o"] for x in later_of_signatures(nodes, 9, most).collect()]
        assert sorted(gone) == [i for i in range(500) if i not in kept], most


def test_minhash_pairs_by_prefixes_against_brute_force(spark):
    import pyarrow as pa

    from corpusmill.functions import kernels

    r = random.Random(8)
    texts = []
    for _ in range(50):
        base = [f"w{int(r.paretovariate(0.7)) % 300}" for _ in range(r.randint(1, 40))]
        texts += [" ".join(w if r.random() < 0.95 else r.choice(base) + "x" for w in base) for _ in range(3)]
    sets = [set(x.split()) for x in texts]
    keys = kernels.bands(kernels.token_sets(pa.array(texts)), 64, 8, False).to_pylist()
    d = ds(spark, [*enumerate(texts)], TEXT, id="id")
    for threshold in (0.3, 0.8, 1.0):
        like = lambda i, j: any(map(int.__eq__, keys[i], keys[j])) and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= threshold  # noqa: B023, E731
        kept = [i for i in range(len(texts)) if not any(like(i, j) for j in range(i))]
        assert sorted(values(run(d, "dedup.minhash", at("text") | {"threshold": threshold}), "id")) == kept


def test_language_and_signature_queries_are_their_sql_on_other_scripts_and_nulls(spark, tmp_path):
    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    from corpusmill.plans import queries

    texts = [None, "", "!!!", "Привет, мир, и всё", "नमस्ते दुनिया हिन्दी", "مَرْحَبًا بالعالم", "ΟΔΥΣΣΕΥΣ ΟΔΟΣ", "❤️ a\u0301b", "ⓐⓑ mixed 中文 x²"]
    pq.write_table(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts)}), tmp_path / "documents.parquet")
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{tmp_path}/documents.parquet'")
    for name in ("lang_confidence", "simhash_signature"):
        got = sorted(map(tuple, queries.QUERIES[name](spark, str(tmp_path)).collect()))
        assert got == sorted(db.execute(queries.SQL[name]).fetchall()), name


def test_cosines_in_rounds_against_brute_force(spark):
    from corpusmill.operators.dedup import later_of_cosines

    r = random.Random(4)
    rows = []
    for i in range(120):
        w = {r.randrange(12): r.random() + 0.1 for _ in range(r.randint(1, 6))}
        norm = sum(x * x for x in w.values()) ** 0.5
        rows.append((i, [(t, w[t] / norm) for t in sorted(w)]))
    kept, gone = [], {}
    for i, v in rows:
        at = next((j for j in kept if sum(x * dict(rows[j][1]).get(t, 0) for t, x in v) >= 0.8), None)
        if at is None:
            kept.append(i)
        else:
            gone[i] = at
    vectors = spark.createDataFrame(rows, "o long, v array<struct<t:long,w:double>>")
    for most, weights in ((16, 1 << 20), (1000, 100), (1000, 1 << 20)):
        assert {x["b"]: x["a"] for x in later_of_cosines(vectors, 0.8, most, weights).collect()} == gone
