"""Settings: an environment variable, else a .env file, else a default."""

from __future__ import annotations

import os
from dataclasses import dataclass
from pathlib import Path


def dotenv(path: str = ".env") -> dict[str, str]:
    """KEY=value lines; comments, quotes and an export in front are dropped."""
    p = Path(path)
    if not p.exists():
        return {}
    out = {}
    for line in p.read_text().splitlines():
        line = line.strip().removeprefix("export ")
        if line and not line.startswith("#") and "=" in line:
            k, v = line.split("=", 1)
            out[k.strip()] = v.strip().strip("\"'")
    return out


@dataclass(frozen=True)
class Settings:
    file: dict[str, str]

    def text(self, name: str, default: str = "") -> str:
        return os.environ.get(name) or self.file.get(name) or default

    def number(self, name: str, default: float) -> float:
        try:
            return float(self.text(name))
        except ValueError:
            return default

    def flag(self, name: str, default: bool = False) -> bool:
        v = self.text(name).strip().lower()
        return default if v not in ("1", "0", "true", "false", "yes", "no", "on", "off") else v in ("1", "true", "yes", "on")


def settings(path: str = ".env") -> Settings:
    return Settings(dotenv(path))
