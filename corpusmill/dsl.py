"""Programs as text: JSON, YAML, or a line for each step, compiled to pipelines."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field
from pathlib import Path
from typing import Any

from .errors import PipelineError
from .pipeline import Pipeline
from .registry import get


@dataclass(frozen=True)
class Step:
    operator: str
    config: dict[str, Any] = field(default_factory=dict)
    input: str | None = None
    output: str | None = None


@dataclass
class Program:
    steps: list[Step]
    warnings: list[str] = field(default_factory=list)
    variables: dict[str, Any] = field(default_factory=dict)

    def compile(self) -> Pipeline:
        """A pipeline; names of operators are checked."""
        for s in self.steps:
            get(s.operator)
        return Pipeline([{"operator": s.operator, "config": s.config} for s in self.steps])

    def to_json(self) -> str:
        return json.dumps({"steps": [asdict(s) for s in self.steps]})


def parse_file(path: str | Path, strict: bool = True) -> Program:
    """By the file's extension: json, yaml or yml, else by its content."""
    text, kind = Path(path).read_text(), Path(path).suffix.lower()
    return parse(text, {".json": "json", ".yaml": "yaml", ".yml": "yaml"}.get(kind), strict)


def parse(text: str, kind: str | None = None, strict: bool = True) -> Program:
    """Unless strict, steps that can't be read become warnings and are left out."""
    if kind is None:
        start = text.lstrip()
        kind = "json" if start[:1] in ("{", "[") else "yaml" if re.search(r"^\s*(steps:|pipeline:|- operator:)", start, re.M) else "lines"
    if kind == "lines":
        return _lines(text, strict)
    try:
        if kind == "json":
            raw = json.loads(text)
        else:
            import yaml

            raw = yaml.safe_load(text)
    except Exception as e:
        raise PipelineError(f"no {kind}: {e}") from e
    return _tree(raw, strict)


def _tree(raw: Any, strict: bool) -> Program:
    variables: dict[str, Any] = {}
    if isinstance(raw, dict):
        variables = dict(raw.get("variables") or {})
        steps = raw.get("steps", raw.get("pipeline", [raw] if "operator" in raw else None))
    else:
        steps = raw
    if not isinstance(steps, list):
        raise PipelineError("a program is a list of steps")
    program = Program([], [], variables)
    for i, s in enumerate(steps):
        try:
            if not isinstance(s, dict) or not isinstance(s.get("operator"), str):
                raise PipelineError("a step needs an operator")
            program.steps.append(Step(s["operator"], resolve(s.get("config") or {}, variables), s.get("input"), s.get("output")))
        except PipelineError as e:
            if strict:
                raise PipelineError(f"step {i + 1}: {e}") from e
            program.warnings.append(f"step {i + 1}: {e}")
    return program


_VALUE = re.compile(r"""([^\s=]+)=("[^"]*"|'[^']*'|\S+)""")


def value(text: str) -> Any:
    """A quoted or bare text, a number, true or false, or JSON in brackets."""
    text = text.strip()
    if text[:1] in ('"', "'"):
        return text.strip(text[0])
    if text in ("true", "false"):
        return text == "true"
    if text[:1] in ("[", "{"):
        try:
            return json.loads(text)
        except ValueError as e:
            raise PipelineError(f"no JSON: {text}") from e
    for number in (int, float):
        try:
            return number(text)
        except ValueError:
            continue
    return text


def _lines(text: str, strict: bool) -> Program:
    program = Program([])
    for n, line in enumerate(text.split("\n"), 1):
        line = line.strip()
        if not line or line.startswith(("#", "//")):
            continue
        try:
            if line.startswith("$"):
                name, sign, given = line[1:].partition("=")
                if not sign:
                    raise PipelineError("a variable is written $name=value")
                program.variables[name.strip()] = value(given)
                continue
            name, _, rest = line.partition(" ")
            rest = rest.strip()
            if rest.startswith("{"):
                config = value(rest)
            else:
                config = {k: value(v) for k, v in _VALUE.findall(rest)}
            program.steps.append(Step(name, resolve(config, program.variables)))
        except PipelineError as e:
            if strict:
                raise PipelineError(f"line {n}: {e}") from e
            program.warnings.append(f"line {n}: {e}")
    return program


def resolve(config: Any, variables: dict[str, Any]) -> Any:
    """$name and ${name}, where they are a whole text, become the variable's value."""
    if isinstance(config, dict):
        return {k: resolve(v, variables) for k, v in config.items()}
    if isinstance(config, list):
        return [resolve(v, variables) for v in config]
    m = re.fullmatch(r"\$(?:\{(\w+)\}|(\w+))", config) if isinstance(config, str) else None
    if not m:
        return config
    name = m[1] or m[2]
    if name not in variables:
        raise PipelineError(f"unknown variable ${name}")
    return variables[name]
