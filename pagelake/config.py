"""Settings from the environment and an optional .env file; all names start with PAGELAKE_."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields
from pathlib import Path

PREFIX = "PAGELAKE_"
MOCK_MODEL = "mock-model"


class Secret(str):
    """A string that doesn't show itself."""

    def __repr__(self) -> str:
        return "'***'" if len(self) else "''"

    __str__ = __repr__

    def reveal(self) -> str:
        return str.__str__(self)


@dataclass(frozen=True)
class Settings:
    default_backend: str = "mock"
    default_model: str = MOCK_MODEL
    openrouter_api_key: Secret = field(default=Secret(""), repr=False)
    together_api_key: Secret = field(default=Secret(""), repr=False)
    gemini_api_key: Secret = field(default=Secret(""), repr=False)
    s3_endpoint_url: str = ""
    s3_access_key: Secret = field(default=Secret(""), repr=False)
    s3_secret_key: Secret = field(default=Secret(""), repr=False)
    log_costs: bool = False
    private_runtime: bool = False

    def key_for(self, backend: str) -> str:
        return getattr(self, f"{backend}_api_key", Secret("")).reveal()


def read_env_file(path: str | Path) -> dict[str, str]:
    out = {}
    if Path(path).is_file():
        for line in Path(path).read_text().splitlines():
            name, equals, value = line.strip().partition("=")
            if equals and not name.startswith("#"):
                out[name.removeprefix("export ").strip()] = value.strip().strip("\"'")
    return out


def load_settings(env: dict[str, str] | None = None, env_file: str | Path = ".env") -> Settings:
    """The environment wins over the file; unknown names are left aside."""
    values = read_env_file(env_file) | dict(os.environ if env is None else env)
    found = {}
    for f in fields(Settings):
        raw = values.get(PREFIX + f.name.upper())
        if raw is not None:
            found[f.name] = raw.lower() in ("1", "true", "yes", "on") if f.type == "bool" else Secret(raw) if f.type == "Secret" else raw
    return Settings(**found)


_cached: Settings | None = None


def settings() -> Settings:
    """The settings, read once."""
    global _cached
    if _cached is None:
        _cached = load_settings()
    return _cached


def reset_settings() -> None:
    global _cached
    _cached = None
