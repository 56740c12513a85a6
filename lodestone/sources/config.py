"""Configuration, the state folder, and the current commit."""

from __future__ import annotations

import subprocess
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

STATE = ".lodestone"
DEFAULT = """debug = false

[llm]
provider = "none"
model = ""
batch_size = 10
parallel = 4

[features]
summaries = false
"""
ABOUT = """# Index state

`index/` holds the tables of the index as Parquet, `index.json` the same as one
document, `rank.json` the levels. `config.toml` is yours to change; this file is
written anew by every run.
"""


@dataclass
class Llm:
    provider: str = "none"
    api_key: str | None = None
    model: str = ""
    batch_size: int = 10
    parallel: int = 4


@dataclass
class Features:
    summaries: bool = False


@dataclass
class Config:
    debug: bool = False
    llm: Llm = field(default_factory=Llm)
    features: Features = field(default_factory=Features)


def _of(kind: type, values: object):
    known = kind.__dataclass_fields__
    return kind(**{k: v for k, v in values.items() if k in known}) if isinstance(values, dict) else kind()


def load_config(state: str | Path) -> Config:
    """``config.toml`` of the state folder; defaults where it is missing or broken."""
    try:
        read = tomllib.loads((Path(state) / "config.toml").read_text(encoding="utf-8"))
    except (OSError, tomllib.TOMLDecodeError, UnicodeDecodeError):
        return Config()
    return Config(read.get("debug") is True, _of(Llm, read.get("llm")), _of(Features, read.get("features")))


def init_state_dir(root: str | Path = ".") -> Path:
    """Make the state folder, its cache and a default configuration."""
    state = Path(root) / STATE
    (state / "cache").mkdir(parents=True, exist_ok=True)
    if not (state / "config.toml").exists():
        (state / "config.toml").write_text(DEFAULT, encoding="utf-8")
    (state / "README.md").write_text(ABOUT, encoding="utf-8")
    return state


def git_head(root: str | Path = ".") -> str:
    """The current commit; empty without one."""
    try:
        done = subprocess.run(["git", "rev-parse", "HEAD"], cwd=root, capture_output=True, text=True, timeout=30)
    except (OSError, subprocess.SubprocessError):
        return ""
    return done.stdout.strip() if done.returncode == 0 else ""
