"""Settings and configuration files."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from ..functions.calendar import Period, periods_of


class ConfigError(ValueError):
    """A setting is missing or wrong."""


@dataclass(frozen=True)
class Settings:
    """Credentials of the paged source."""

    api_key: str
    user: str
    shared_secret: str | None = None


def dotenv(path: str | Path) -> dict[str, str]:
    """NAME=value lines of a file; blank lines and comments are passed over, quotes are taken off. No file is no settings."""
    out: dict[str, str] = {}
    p = Path(path)
    for line in p.read_text(encoding="utf-8").splitlines() if p.exists() else []:
        name, eq, value = line.strip().removeprefix("export ").partition("=")
        if eq and name and not name.startswith("#"):
            out[name.strip()] = value.strip().strip("\"'")
    return out


def settings(prefix: str = "LISTENING", env: dict[str, str] | None = None, file: str | Path = ".env") -> Settings:
    """Settings from the environment, which wins, and a file. The key and the user are required."""
    known = dotenv(file) | dict(os.environ if env is None else env)
    get = lambda n: (known.get(f"{prefix}_{n}") or "").strip()
    if missing := [f"{prefix}_{n}" for n in ("API_KEY", "USERNAME") if not get(n)]:
        raise ConfigError(f"missing {', '.join(missing)}")
    return Settings(get("API_KEY"), get("USERNAME"), get("SHARED_SECRET") or None)


def read_config(path: str | Path, default: Any = None) -> Any:
    """A JSON file; ``default``, where given, stands in for a file that is missing or damaged."""
    try:
        return json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        if default is None:
            raise
        return default


def boundary(path: str | Path, field: str = "consistent_tracking_from") -> str:
    """The era boundary of an analytics config, as an instant in UTC."""
    value = str(read_config(path)[field])
    return value if "T" in value else f"{value}T00:00:00+00:00"


def periods(path: str | Path) -> list[Period]:
    return periods_of(read_config(path))


#: Used where the enrichment config is missing or damaged.
ENRICHMENT = {"entity_interval_seconds": 1.0, "tag_interval_seconds": 0.5, "artist_tag_limit": 20, "agent": "cadenza (local enrichment)"}


def enrichment(path: str | Path) -> dict:
    found = read_config(path, {})
    return ENRICHMENT | (found if isinstance(found, dict) else {})
