"""Packages of operators: a manifest, functions by name, dependencies, and what of a table they may see."""

from __future__ import annotations

import hashlib
import importlib.util
import json
import re
import zipfile
from collections.abc import Callable, Mapping
from dataclasses import asdict, dataclass, field
from pathlib import Path
from typing import Any

from .dataset import Dataset
from .errors import ConfigError, PipelineError, SchemaError
from .registry import operator, unregister

ABI = 1
MANIFEST = "mill_plugin.json"
SENSITIVE = ("pii", "pii_matches", "pii.redact")


@dataclass(frozen=True)
class Dependency:
    name: str
    version_range: str = "*"


@dataclass(frozen=True)
class PluginManifest:
    name: str
    version: str
    description: str = ""
    author: str = ""
    abi_version: int = ABI
    dependencies: tuple[Dependency, ...] = ()
    operators: tuple[str, ...] = ()
    capabilities: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if not re.fullmatch(r"[A-Za-z][\w.-]*", self.name):
            raise ConfigError(f"no name for a plugin: {self.name!r}")
        version(self.version)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> PluginManifest:
        raw = json.loads(text)
        return PluginManifest(**{**raw, "dependencies": tuple(Dependency(**d) for d in raw.get("dependencies", ())), "operators": tuple(raw.get("operators", ())), "capabilities": tuple(raw.get("capabilities", ()))})


def version(text: str) -> tuple[int, ...]:
    m = re.fullmatch(r"(\d+)(?:\.(\d+))?(?:\.(\d+))?(?:[-+].*)?", text)
    if not m:
        raise ConfigError(f"no version: {text!r}")
    return tuple(int(x or 0) for x in m.groups())


def satisfies(found: str, wanted: str) -> bool:
    """Whether a version lies in a range: *, ^1.2, ~1.2, or comparisons joined by commas."""
    have = version(found)
    for part in (p.strip() for p in wanted.split(",")):
        if part in ("*", ""):
            continue
        sign, number = re.fullmatch(r"(\^|~|>=|<=|>|<|==?)?\s*(.*)", part).groups()
        want = version(number)
        ok = {"^": have >= want and (have[0] == want[0] and (want[0] > 0 or have[1] == want[1])), "~": have >= want and have[:2] == want[:2], ">=": have >= want, "<=": have <= want, ">": have > want, "<": have < want}.get(sign or "=", have == want)
        if not ok:
            return False
    return True


@dataclass(frozen=True)
class Policy:
    """What an operator of a plugin may see: all but the hidden metadata, unless it is trusted."""

    hidden: tuple[str, ...] = SENSITIVE
    trusted: frozenset[str] = frozenset()

    def view(self, plugin: str, ds: Dataset) -> Dataset:
        return ds if plugin in self.trusted else ds.drop_meta(*(k for k in ds.meta if k in self.hidden))


@dataclass
class Runtime:
    policy: Policy = field(default_factory=Policy)
    plugins: dict[str, PluginManifest] = field(default_factory=dict)
    audit: list[dict[str, Any]] = field(default_factory=list)

    def load(self, manifest: PluginManifest, functions: Mapping[str, Callable[[Dataset, Mapping[str, Any]], Dataset]]) -> None:
        """Registers the plugin's operators; its dependencies must be there."""
        if manifest.abi_version != ABI:
            raise PipelineError(f"{manifest.name} needs ABI {manifest.abi_version}, this is {ABI}")
        for d in manifest.dependencies:
            if d.name not in self.plugins or not satisfies(self.plugins[d.name].version, d.version_range):
                raise PipelineError(f"{manifest.name} needs {d.name} {d.version_range}")
        if set(manifest.operators) != set(functions):
            raise SchemaError(f"{manifest.name} declares other operators than it has")
        for name, run in functions.items():
            operator(name)(self._guarded(manifest.name, name, run))
        self.plugins[manifest.name] = manifest

    def _guarded(self, plugin: str, name: str, run: Callable[[Dataset, Mapping[str, Any]], Dataset]) -> Callable[[Dataset, Mapping[str, Any]], Dataset]:
        def call(ds: Dataset, config: Mapping[str, Any]) -> Dataset:
            seen = self.policy.view(plugin, ds)
            self.audit.append({"plugin": plugin, "operator": name, "hidden": sorted(set(ds.meta) - set(seen.meta))})
            return run(seen, config)

        return call

    def unload(self, name: str) -> None:
        users = [p.name for p in self.plugins.values() if any(d.name == name for d in p.dependencies)]
        if users:
            raise PipelineError(f"{name} is needed by {users}")
        for op in self.plugins.pop(name).operators:
            unregister(op)

    def load_package(self, path: str | Path, sha256: str | None = None) -> PluginManifest:
        """A folder or zip file with a manifest and plugin.py, whose OPERATORS are functions by name. sha256: of the zip file, checked first."""
        path = Path(path)
        if path.is_dir():
            text, code = (path / MANIFEST).read_text(), (path / "plugin.py").read_text()
        else:
            if sha256 is not None and hashlib.sha256(path.read_bytes()).hexdigest() != sha256:
                raise PipelineError(f"{path.name} isn't the file that was signed for")
            with zipfile.ZipFile(path) as z:
                text, code = z.read(MANIFEST).decode(), z.read("plugin.py").decode()
        manifest = PluginManifest.from_json(text)
        module = importlib.util.module_from_spec(importlib.util.spec_from_loader(f"mill_plugin_{manifest.name}", loader=None))
        exec(compile(code, f"{path}/plugin.py", "exec"), module.__dict__)
        self.load(manifest, module.OPERATORS)
        return manifest
