"""Settings of a catalogue from a TOML file."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass
from pathlib import Path


@dataclass(frozen=True)
class Config:
    music_root: Path
    data_root: Path
    short_ms: int = 2000
    medium_ms: int = 3000
    long_ms: int = 5000
    auto_equivalent: float = 0.985
    review_floor: float = 0.93


def load(path: str | Path) -> Config:
    data = tomllib.loads(Path(path).read_text(encoding="utf-8"))
    two = data.get("duplicates", {})
    return Config(**{k: Path(data["paths"][k]) for k in ("music_root", "data_root")}, **two.get("duration", {}), **two.get("chromaprint", {}))
