"""Operators for language-model data: token estimates, conversations, context length, questions and instructions."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..dataset import Dataset, Field, kind, quoted
from ..errors import ConfigError
from ..functions.text import estimated_tokens, let, n_chars
from ..registry import Config, operator, option
from .filters import java_regex


@operator("llm.token_count", row_wise=True)
def token_count(ds: Dataset, config: Config) -> Dataset:
    """An estimate of the tokens of a text; a missing text counts as empty."""
    text = _text(ds, option(config, "text_field", "payload.text", str))
    return ds.put(option(config, "output_field", "metadata.token_count", str), estimated_tokens(text))


def _text(ds: Dataset, path: str) -> Column:
    c = ds.text(path)
    return F.coalesce(c, F.lit("")) if c is not None else F.lit("")


def variant(value: Any) -> tuple[str, Mapping[str, Any]]:
    """The name and options of a choice: "Name" or {"Name": {...}}."""
    if isinstance(value, str):
        return value, {}
    if isinstance(value, dict) and len(value) == 1:
        name, options = next(iter(value.items()))
        return name, options or {}
    raise ConfigError(f"no choice: {value!r}")


_MESSAGES = "array<struct<role:string,content:string>>"


def _message(role: str | Column, content: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), content.alias("content"))


def _member(f: Field, name: str) -> Field | None:
    if isinstance(f.type, T.StructType) and name in f.type.names:
        return Field(f.column.getField(name), f.type[name].dataType)
    return None


def messages(f: Field, style: str, options: Mapping[str, Any]) -> Column:
    """(role, content) of a conversation; nothing of what isn't in the style's form."""
    none = F.array().cast(_MESSAGES)

    def one(name: str, role: str) -> Column:
        m = _member(f, name)
        if m is None or m.kind != "str":
            return none
        return F.when(m.column.isNotNull(), F.array(_message(role, m.column))).otherwise(none)

    if style == "ChatML":
        turns = _member(f, "turns")
        said = none
        if turns and turns.kind == "array" and kind(turns.type.elementType) == "str":
            each = F.transform(turns.column, lambda x, i: _message(F.when(i % 2 == 0, "user").otherwise("assistant"), x))
            said = F.coalesce(F.filter(each, lambda x: x["content"].isNotNull()), none)
        return F.concat(one("system", "system"), said)
    if style == "ShareGPT":
        said = _member(f, "conversations")
        if not said or said.kind != "array" or not isinstance(said.type.elementType, T.StructType):
            return none
        have = said.type.elementType.names
        part = lambda x, n, d: F.coalesce(x[n], F.lit(d)) if n in have else F.lit(d)
        return F.coalesce(F.transform(said.column, lambda x: _message(part(x, "from", "user"), part(x, "value", ""))), none)
    if style == "Alpaca":
        return F.concat(one("instruction", "user"), one("output", "assistant"))
    if style == "OpenAI":
        return F.coalesce(f.column, F.array().cast(f.type)) if f.kind == "array" else none
    if style == "Custom":
        return F.concat(*(one(option(options, f"{r}_key", kinds=str), r) for r in ("system", "user", "assistant")))
    raise ConfigError(f"unknown conversation format {style!r}")


@operator("llm.conversation_format", row_wise=True)
def conversation_format(ds: Dataset, config: Config) -> Dataset:
    """A conversation of one of five formats as messages with role and content."""
    style, options = variant(option(config, "format", "ChatML"))
    found = ds.find(option(config, "input_field", "payload.conversation", str))
    target = option(config, "output_field", "payload.messages", str)
    return ds.put(target, messages(found or Field(F.lit(None), T.NullType()), style, options))


@operator("llm.context_length", row_wise=True)
def context_length(ds: Dataset, config: Config) -> Dataset:
    """Rows filtered by estimated tokens, or texts cut to so many, or split into parts of so many that overlap.

    Parts are rows; the id of part i ends in _chunk_i if it is a string. overlap must be smaller than max_tokens.
    """
    path = option(config, "text_field", "payload.text", str)
    text = _text(ds, path)
    name, o = variant(option(config, "action", "Filter"))
    if name == "Filter":
        return ds.where(estimated_tokens(text).between(option(config, "min_tokens", 0, int, 0), option(config, "max_tokens", 8192, int, 0)))
    most = option(o, "max_tokens", kinds=int, least=1)
    size = lambda x: F.floor(most * (x["n"] / x["tokens"])).cast("int")
    known = lambda t: F.struct(t.alias("text"), estimated_tokens(t).alias("tokens"), n_chars(t).alias("n"))
    if name == "Truncate":
        return ds.put(path, let(let(text, known), lambda x: F.when(x["tokens"] > most, F.substr(x["text"], F.lit(1), size(x))).otherwise(x["text"])))
    if name != "Split":
        raise ConfigError(f"unknown action {name!r}")
    overlap = option(o, "overlap", 0, int, 0)
    if overlap >= most:
        raise ConfigError("overlap must be smaller than max_tokens")
    sized = lambda x: F.struct(x["text"].alias("text"), (x["tokens"] > most).alias("cut"), x["n"].alias("n"), F.greatest(size(x), F.lit(1)).alias("size"), F.greatest(size(x) - F.floor(overlap * (x["n"] / x["tokens"])).cast("int"), F.lit(1)).alias("step"))
    # the last part is the first that reaches the end
    last = lambda x: F.greatest(F.ceil((x["n"] - x["size"]) / x["step"]), F.lit(0)).cast("int")
    parts = lambda x: F.transform(F.sequence(F.lit(0), last(x)), lambda i: F.substr(x["text"], i * x["step"] + 1, x["size"]))
    cuts = let(let(let(text, known), sized), lambda x: F.struct(x["cut"].alias("cut"), F.when(x["cut"], parts(x)).otherwise(F.array(x["text"])).alias("parts")))
    out = ds.df.withColumn("_cuts", cuts).select("*", F.posexplode("_cuts.parts").alias("_i", "_part")).withColumn("_cut", F.col("_cuts.cut"))
    if ds.id and kind(ds.df.schema[ds.id].dataType) == "str":
        out = out.withColumn(ds.id, F.when(F.col("_cut"), F.concat(quoted(ds.id), F.lit("_chunk_"), F.col("_i"))).otherwise(quoted(ds.id)))
    keep = ds.on(out)
    old = keep.text(path)
    if old is not None:
        keep = keep.put(path, F.when(F.col("_cut"), F.col("_part")).otherwise(old))
    return keep.on(keep.df.drop("_cut", "_cuts", "_i", "_part"))


_PAIRS = pa.list_(pa.struct([("question", pa.string()), ("answer", pa.string())]))
_PAIRS_DDL = "array<struct<question:string,answer:string>>"
_SEP, _NUM = r"[\s:]+", r"\d+"


def _either(word: str) -> str:
    return f"[{word[0]}{word[0].lower()}]{word[1:]}"


def _heading(word: str) -> str:
    return rf"##\s*{_either(word)}"


_MARK = [regex.compile(f"{_heading(a)}{_SEP}.*?(?={_heading(b)}|$)") for a, b in (("Question", "Answer"), ("Answer", "Question"))]
_NUMBER = [regex.compile(rf"{_either(a)}({_NUM}){_SEP}(.*?)(?={_either(b)}{_NUM}[\s:]|$)") for a, b in ("QA", "AQ")]


def qa_markdown(text: str) -> list[tuple[str, str]]:
    """Sections headed Question and Answer, headings included, paired in order."""
    q, a = ([m[0].strip() for m in r.finditer(text)] for r in _MARK)
    return list(zip(q, a, strict=False))


def qa_numbered(text: str) -> list[tuple[str, str]]:
    """Q1 with A1 and so on."""
    answers: dict[int, str] = {}
    for m in _NUMBER[1].finditer(text):
        answers.setdefault(int(m[1]), m[2].strip())
    return [(m[2].strip(), answers[int(m[1])]) for m in _NUMBER[0].finditer(text) if int(m[1]) in answers]


def qa_lines(text: str) -> list[tuple[str, str]]:
    """Lines that begin with Q: and A: (or Question: and Answer:), with the lines that follow them."""
    out: list[tuple[str, str]] = []
    said = {"q": "", "a": ""}
    at = "q"

    def close() -> None:
        if said["q"] and said["a"]:
            out.append((said["q"].strip(), said["a"].strip()))

    for line in text.split("\n"):
        line = line.strip()
        if line.startswith(("Q:", "Question:")):
            close()
            said.update(q=line.partition(":")[2], a="")
            at = "q"
        elif line.startswith(("A:", "Answer:")):
            said["a"], at = line.partition(":")[2], "a"
        else:
            said[at] += " " + line
    close()
    return out


def qa_auto(text: str) -> list[tuple[str, str]]:
    if any(x in text for x in ("## Q", "**Q:**")):
        return qa_markdown(text)
    return qa_numbered(text) if any(x in text for x in ("Q1:", "Question 1:", "1. ")) else qa_lines(text)


@operator("llm.qa_extract", row_wise=True)
def qa_extract(ds: Dataset, config: Config) -> Dataset:
    """Question and answer pairs of a text. pattern: Auto, MarkdownQA, NumberedQA, Heuristic or {Custom: {question_pattern, answer_pattern}}."""
    text = _text(ds, option(config, "text_field", "payload.text", str))
    target = option(config, "output_field", "payload.qa_pairs", str)
    name, o = variant(option(config, "pattern", "Auto"))
    if name == "Custom":
        q, a = (F.regexp_extract_all(text, F.lit(java_regex(option(o, k, kinds=str))), F.lit(0)) for k in ("question_pattern", "answer_pattern"))
        both = F.least(F.size(q), F.size(a))
        zipped = F.transform(F.arrays_zip(F.slice(q, F.lit(1), both).alias("q"), F.slice(a, F.lit(1), both).alias("a")), lambda x: F.struct(F.btrim(x["q"]).alias("question"), F.btrim(x["a"]).alias("answer")))
        return ds.put(target, zipped)
    runs = {"Auto": qa_auto, "MarkdownQA": qa_markdown, "NumberedQA": qa_numbered, "Heuristic": qa_lines}
    if name not in runs:
        raise ConfigError(f"unknown pattern {name!r}")
    run = runs[name]

    @F.arrow_udf(_PAIRS_DDL)
    def pairs(texts: pa.Array) -> pa.Array:
        return pa.array([[{"question": q, "answer": a} for q, a in run(t)] for t in texts.to_pylist()], _PAIRS)

    return ds.put(target, pairs(text))


#: The line that opens a Vicuna prompt.
PREAMBLE = " ".join(["A chat between a curious user and an artificial intelligence assistant.", "The assistant gives helpful, detailed,", "and polite answers to the user's questions."])


_END = "<|im_end|>\n"


def _turn(role: str) -> str:
    return f"<|im_start|>{role}\n"


@operator("llm.instruction_format", row_wise=True)
def instruction_format(ds: Dataset, config: Config) -> Dataset:
    """A prompt from an instruction and an input. format: Alpaca, Vicuna, Llama2, ChatML or {Custom: {template}}."""
    said = _text(ds, option(config, "instruction_field", "payload.instruction", str))
    given = _text(ds, config["input_field"]) if config.get("input_field") else F.lit("")
    name, o = variant(option(config, "format", "Alpaca"))
    join = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    bare = given == ""
    made = {
        "Alpaca": lambda: join("### Instruction:\n", said, F.when(bare, "").otherwise(join("\n\n### Input:\n", given)), "\n\n### Response:\n"),
        "Vicuna": lambda: join(f"{PREAMBLE}\n\nUSER: ", said, "\nASSISTANT:"),
        "Llama2": lambda: join("<s>[INST] ", said, " [/INST]"),
        "ChatML": lambda: join(_turn("user"), said, F.when(bare, "").otherwise(join("\n\n", given)), _END, _turn("assistant")),
        "Custom": lambda: F.replace(F.replace(F.lit(option(o, "template", kinds=str)), F.lit("{{instruction}}"), said), F.lit("{{input}}"), given),
    }
    if name not in made:
        raise ConfigError(f"unknown instruction format {name!r}")
    return ds.put(option(config, "output_field", "payload.formatted", str), made[name]())
