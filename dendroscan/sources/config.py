"""Configuration from TOML."""

from __future__ import annotations

import os
import tomllib
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path

#: Directories whose changes aren't followed by default.
WATCH_EXCLUDES = ("node_modules", ".git", "target", ".cache", ".venv", "__pycache__")


@dataclass
class Config:
    roots: list[str] = field(default_factory=lambda: [str(Path.home())])
    scan_excludes: list[str] = field(default_factory=list)
    exclude_paths: list[str] = field(default_factory=list)
    watch_excludes: list[str] = field(default_factory=lambda: list(WATCH_EXCLUDES))
    max_results: int = 500
    watch_budget: int = 400_000
    watch_debounce_ms: int = 200
    watch_rescan_s: int = 600
    snapshot_dir: str = field(default_factory=lambda: str(Path.home() / ".dendroscan" / "snapshot"))

    @classmethod
    def load(cls, *paths: str) -> Config:
        """From the first file that exists; what it leaves out keeps its default. None: all defaults."""
        for path in paths or (str(Path.home() / ".dendroscan" / "config.toml"),):
            if os.path.exists(path):
                with open(path, "rb") as f:
                    got = tomllib.load(f)
                return cls(**{k: v for k, v in got.items() if k in {x.name for x in fields(cls)}})
        return cls()

    def save(self, path: str) -> None:
        """In one step: a reader sees the old file or the new one."""
        import json

        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        with open(f"{path}.new", "w", encoding="utf-8") as f:
            f.writelines(f"{k} = {json.dumps(v, ensure_ascii=False)}\n" for k, v in asdict(self).items())
        os.replace(f"{path}.new", path)
