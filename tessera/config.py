"""Configuration: dataclasses that check themselves, files with ``${...}``, overrides by dotted name, and kinds of models.

Files are JSON, or YAML where that package is there.
"""

from __future__ import annotations

import dataclasses
import json
import os
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any, get_args, get_origin, get_type_hints

#: Where a file is looked for: the name given, this variable, this name in the working folder or above.
VARIABLE, FILE = "TESSERA_CONFIG", "tessera.json"


def _require(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


@dataclass
class Chunking:
    max_tokens: int = 512
    overlap_tokens: int = 64
    min_tokens: int = 24
    noise_ratio: float = 0.4
    extra_skip: list[str] = field(default_factory=list)

    def __post_init__(self):
        _require(self.overlap_tokens < self.max_tokens, "chunking.overlap_tokens must be below max_tokens")
        _require(0 <= self.noise_ratio <= 1, "chunking.noise_ratio must be from 0 to 1")


@dataclass
class Extraction:
    backend: str = "auto"
    images: bool = True

    def __post_init__(self):
        _require(self.backend in ("auto", "html", "pdf"), "extraction.backend must be auto, html or pdf")


@dataclass
class Model:
    """A kind that is registered, or package.module:factory, with the settings that it is built with."""

    kind: str
    enabled: bool = True
    settings: dict[str, Any] = field(default_factory=dict)


@dataclass
class Lexical:
    enabled: bool = False
    k1: float = 1.5
    b: float = 0.75
    rrf_k: int = 60
    fetch_multiplier: int = 3

    def __post_init__(self):
        _require(self.fetch_multiplier >= 1, "lexical.fetch_multiplier must be at least 1")


@dataclass
class Faithfulness:
    enabled: bool = False
    checker: Model = field(default_factory=lambda: Model("overlap"))
    contradiction_max: float = 0.05
    entailment_min: float = 0.3

    def __post_init__(self):
        _require(self.contradiction_max < self.entailment_min, "faithfulness.contradiction_max must be below entailment_min")


@dataclass
class Retrieval:
    candidates: int = 20
    max_rounds: int = 8
    min_k: int = 2
    max_k: int = 10
    elbow: bool = True
    mad_multiplier: float = 3.0
    prominence: float = 0.15

    def __post_init__(self):
        _require(self.max_rounds >= 2, "retrieval.max_rounds must be at least 2")
        _require(self.min_k <= self.max_k, "retrieval.min_k must be at most max_k")
        _require(self.max_k <= self.candidates, "retrieval.max_k must be at most candidates")
        _require(self.mad_multiplier > 0, "retrieval.mad_multiplier must be above 0")
        _require(0 < self.prominence < 1, "retrieval.prominence must be between 0 and 1")


@dataclass
class MultiQuery:
    enabled: bool = False
    n: int = 3
    fetch_multiplier: int = 3

    def __post_init__(self):
        _require(self.n >= 1, "multi_query.n must be at least 1")
        _require(self.fetch_multiplier >= 1, "multi_query.fetch_multiplier must be at least 1")


@dataclass
class Tagging:
    min_tags: int = 5
    max_tags: int = 12
    max_chars: int = 6000

    def __post_init__(self):
        _require(self.min_tags <= self.max_tags, "tagging.min_tags must be at most max_tags")


@dataclass
class Paper:
    name: str
    arxiv_id: str = ""

    def __post_init__(self):
        _require(not self.name.endswith("_display"), f"{self.name}: names that end in _display are taken by display copies")


@dataclass
class Config:
    data_path: str = "data"
    index_path: str = "data/index"
    pool_path: str = "data/pool"
    embedder: Model = field(default_factory=lambda: Model("hashing"))
    scorer: Model = field(default_factory=lambda: Model("overlap"))
    model: Model = field(default_factory=lambda: Model("none", enabled=False))
    lexical: Lexical = field(default_factory=Lexical)
    faithfulness: Faithfulness = field(default_factory=Faithfulness)
    chunking: Chunking = field(default_factory=Chunking)
    extraction: Extraction = field(default_factory=Extraction)
    retrieval: Retrieval = field(default_factory=Retrieval)
    multi_query: MultiQuery = field(default_factory=MultiQuery)
    tagging: Tagging = field(default_factory=Tagging)
    resamples: int = 2000
    papers: list[Paper] = field(default_factory=list)


PATHS = ("data_path", "index_path", "pool_path")


def made(kind: type, data: Any, at: str = "") -> Any:
    """A dataclass, a list of them, or a plain value, from what a file holds; names that aren't known are errors."""
    if dataclasses.is_dataclass(kind):
        _require(isinstance(data, dict), f"{at or 'the configuration'} must be a mapping")
        hints = get_type_hints(kind)
        unknown = sorted(set(data) - set(hints))
        _require(not unknown, f"unknown settings: {', '.join(f'{at}.{u}'.lstrip('.') for u in unknown)}")
        return kind(**{k: made(hints[k], v, f"{at}.{k}".lstrip(".")) for k, v in data.items()})
    if get_origin(kind) is list:
        return [made(get_args(kind)[0], x, at) for x in data]
    if kind in (int, float) and not isinstance(data, bool):
        return kind(data)
    return data


def resolved(data: Any, root: Any = None, seen: tuple[str, ...] = ()) -> Any:
    """``${a.b}`` replaced by what stands there; a value that is nothing but one such mark keeps its type."""
    root = data if root is None else root

    def look(name: str) -> Any:
        _require(name not in seen, f"${{{name}}} refers to itself")
        here = root
        for part in name.split("."):
            _require(isinstance(here, dict) and part in here, f"${{{name}}} is not there")
            here = here[part]
        return resolved(here, root, (*seen, name))

    if isinstance(data, dict):
        return {k: resolved(v, root, seen) for k, v in data.items()}
    if isinstance(data, list):
        return [resolved(v, root, seen) for v in data]
    if isinstance(data, str):
        if whole := re.fullmatch(r"\$\{([\w.]+)\}", data):
            return look(whole[1])
        return re.sub(r"\$\{([\w.]+)\}", lambda m: str(look(m[1])), data)
    return data


def overridden(data: dict, arguments: Sequence[str]) -> dict:
    """``--retrieval.max_k=5`` and the like laid over a file's values; values are read as JSON where they are such."""
    out = json.loads(json.dumps(data))
    for argument in arguments:
        found = re.fullmatch(r"--([\w.]+)=(.*)", argument, re.S)
        _require(bool(found), f"not a setting: {argument}")
        *above, last = found[1].split(".")
        here = out
        for part in above:
            here = here.setdefault(part, {})
        try:
            here[last] = json.loads(found[2])
        except ValueError:
            here[last] = found[2]
    return out


def discovered(path: str | None = None, start: Path | None = None) -> Path:
    """The file: as named, else by the variable, else in the working folder or the nearest one above."""
    named = path or os.environ.get(VARIABLE)
    here = start or Path.cwd()
    found = Path(named) if named else next((d / FILE for d in (here, *here.parents) if (d / FILE).exists()), None)
    if found is None or not found.exists():
        raise FileNotFoundError(f"no configuration: name a file, set {VARIABLE}, or put {FILE} here or above")
    return found


def read(path: Path) -> dict:
    text = path.read_text(encoding="utf-8")
    if path.suffix in (".yaml", ".yml"):
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError(f"{path} is YAML, and the package for it is not there: write JSON") from e
        return yaml.safe_load(text) or {}
    return json.loads(text)


def load(path: str | None = None, arguments: Sequence[str] = (), start: Path | None = None) -> Config:
    """The configuration of a file with overrides on top; what refers to other values sees the overrides.

    Relative paths start at the file's folder, unless they name a file system.
    """
    file = discovered(path, start)
    config = made(Config, resolved(overridden(read(file), arguments)))
    for name in PATHS:
        value = getattr(config, name)
        if "://" not in value and not Path(value).is_absolute():
            setattr(config, name, str((file.resolve().parent / value).resolve()))
    return config


def _changed(path: Path, change: Callable[[dict], Any]) -> Any:
    """Read, change and write a JSON file; the new one appears whole or not at all."""
    data = read(path)
    said = change(data)
    written = path.with_name(path.name + ".new")
    written.write_text(json.dumps(data, indent=2, ensure_ascii=False) + "\n", encoding="utf-8")
    written.replace(path)
    return said


def add_paper(path: Path, name: str, arxiv_id: str) -> str | None:
    """A paper more in the file; the name of the one that has its id already, if any, and then nothing is added."""

    def change(data: dict) -> str | None:
        papers = data.setdefault("papers", [])
        known = next((p["name"] for p in papers if str(p.get("arxiv_id")) == arxiv_id), None)
        if known is None:
            papers.append(dataclasses.asdict(Paper(name, arxiv_id)))
        return known

    return _changed(path, change)


def remove_paper(path: Path, name: str) -> bool:
    def change(data: dict) -> bool:
        before = data.get("papers") or []
        data["papers"] = [p for p in before if p["name"] != name]
        return len(data["papers"]) < len(before)

    return _changed(path, change)


def block(**settings) -> str:
    """Settings as a piece of a file, nested by their dots, to be pasted."""
    return json.dumps(overridden({}, [f"--{k.replace('__', '.')}={json.dumps(v)}" for k, v in settings.items()]), indent=2)


def grid(text: str, kind: type = int) -> list:
    """``10,20,20,40`` as sorted, different values."""
    values = sorted({kind(x) for x in text.split(",") if x.strip()})
    _require(bool(values), f"no values in {text!r}")
    return values
