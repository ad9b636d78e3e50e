"""Configuration from a TOML file; every setting has a default."""

from __future__ import annotations

import tomllib
from dataclasses import asdict, dataclass, field
from pathlib import Path

from siftwork.errors import ConfigError
from siftwork.functions.paths import SKIPPED_WHEN_SCANNING
from siftwork.functions.scores import Weights
from siftwork.operators.scan import ScanOptions
from siftwork.operators.select import Diversity

FILE_NAME = "siftwork.toml"


@dataclass(frozen=True)
class Dedup:
    exact: bool = True
    near: bool = False
    hamming_threshold: int = 3
    shingle_size: int = 3


@dataclass(frozen=True)
class Selection:
    solver: str = "auto"
    diverse: bool = True
    decay: float = 0.7
    grouping: str = "directory"

    @property
    def diversity(self) -> Diversity | None:
        return Diversity(self.decay, self.grouping) if self.diverse else None


@dataclass(frozen=True)
class Feedback:
    """``folder`` is below the corpus's root unless it is absolute or a URI. ``min_sessions`` gates learning only where ``strict`` is set."""

    folder: str = ".siftwork/feedback"
    learning_rate: float = 0.1
    min_sessions: int = 5
    strict: bool = False


@dataclass(frozen=True)
class Config:
    extra_ignore: tuple[str, ...] = SKIPPED_WHEN_SCANNING
    max_file_bytes: int = 524_288
    max_file_tokens: int = 8000
    max_ast_bytes: int = 262_144
    include_extensions: tuple[str, ...] = ()
    weights: Weights = field(default_factory=Weights)
    dedup: Dedup = field(default_factory=Dedup)
    selection: Selection = field(default_factory=Selection)
    feedback: Feedback = field(default_factory=Feedback)

    def scan_options(self) -> ScanOptions:
        return ScanOptions(tuple(self.extra_ignore), tuple(self.include_extensions), self.max_file_bytes, self.max_file_tokens, self.max_ast_bytes, self.dedup.shingle_size, self.dedup.near)

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def parse(cls, text: str, name: str = "configuration") -> Config:
        try:
            raw = tomllib.loads(text)
        except tomllib.TOMLDecodeError as e:
            raise ConfigError(f"{name}: {e}") from e
        parts = {"weights": Weights, "dedup": Dedup, "selection": Selection, "feedback": Feedback}
        if isinstance(sel := raw.get("selection"), dict) and isinstance(div := sel.pop("diversity", None), dict):
            sel |= {{"enabled": "diverse"}.get(k, k): v for k, v in div.items()}
        try:
            values = {k: parts[k](**v) if k in parts else tuple(v) if isinstance(v, list) else v for k, v in raw.items()}
            return cls(**values)
        except TypeError as e:
            raise ConfigError(f"{name}: {e}") from e

    @classmethod
    def load(cls, path: str | Path) -> Config:
        """From a file; the defaults where there is none."""
        p = Path(path)
        return cls.parse(p.read_text(), str(p)) if p.exists() else cls()

    @classmethod
    def find(cls, start: str | Path) -> Config:
        """From the nearest file at or above a directory; the defaults where there is none."""
        at = Path(start).resolve()
        for d in (at, *at.parents):
            if (d / FILE_NAME).exists():
                return cls.load(d / FILE_NAME)
        return cls()
