"""Settings of the pipelines: defaults, a file over them, profiles, explicit values last."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields, is_dataclass
from pathlib import Path


@dataclass
class Text:
    max_sentences: int = 40
    max_tokens: int = 64
    vocabulary: int = 30_000
    sequence: int = 400
    shingle: int = 5


@dataclass
class Sketches:
    width: int = 4096
    depth: int = 6
    bloom_rate: float = 0.01


@dataclass
class Duplicates:
    threshold: float = 0.85
    permutations: int = 128
    bands: int = 16
    rows: int = 8


@dataclass
class Graph:
    relations: tuple[str, ...] = ("P31", "P279", "P17", "P569", "P570", "P27", "P19", "P106", "P159")
    dim: int = 96
    epochs: int = 40


@dataclass
class Split:
    train: float = 0.8
    val: float = 0.1
    seed: int = 42


@dataclass
class Settings:
    text: Text = field(default_factory=Text)
    sketches: Sketches = field(default_factory=Sketches)
    duplicates: Duplicates = field(default_factory=Duplicates)
    graph: Graph = field(default_factory=Graph)
    split: Split = field(default_factory=Split)


PROFILES = {"fast": {"graph": {"dim": 32, "epochs": 10}}, "balanced": {}, "accuracy": {"graph": {"dim": 128, "epochs": 80}}}


def _over(target, values: dict, where: str = "") -> None:
    known = {f.name for f in fields(target)}
    for k, v in values.items():
        if k not in known:
            raise KeyError(f"no setting {where}{k}")
        old = getattr(target, k)
        if is_dataclass(old):
            _over(old, v, f"{where}{k}.")
        else:
            setattr(target, k, type(old)(v))


def load(path: str | None = None, profile: str = "balanced", **explicit: dict) -> Settings:
    """Settings from the profile, then the file (JSON, or YAML where a reader is installed), then explicit values; unknown names raise KeyError."""
    out = Settings()
    _over(out, PROFILES[profile])
    if path:
        text = Path(path).read_text()
        if path.endswith((".yaml", ".yml")):
            import yaml

            _over(out, yaml.safe_load(text) or {})
        else:
            _over(out, json.loads(text))
    _over(out, explicit)
    return out


def as_dict(settings: Settings) -> dict:
    return asdict(settings)


def make_dirs(*paths: str) -> None:
    """Create folders; paths with a dot in their last part are files and are skipped."""
    for p in map(Path, paths):
        if "." not in p.name:
            p.mkdir(parents=True, exist_ok=True)
