"""Settings from the environment and an optional ``.env`` file."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from pathlib import Path


def cache_root() -> Path:
    named = os.environ.get("XDG_CACHE_HOME")
    if named:
        return Path(named) / "shiori"
    home = os.environ.get("HOME")
    return (Path(home) / ".cache" if home else Path(".cache")) / "shiori"


@dataclass(frozen=True)
class Config:
    db_path: str = field(default_factory=lambda: str(cache_root() / "db"))
    model_dir: str = field(default_factory=lambda: str(cache_root() / "model"))
    #: Where ``init`` finds the model's files, if it is not told.
    model_url: str = ""
    search_limit: int = 5
    search_rrf_k: int = 60
    search_adjacent_window: int = 1

    @staticmethod
    def load(env_file: str = ".env") -> Config:
        """The environment wins over ``env_file``; numbers that can't be read keep their default, ``~`` stays as it is."""
        values: dict[str, str] = {}
        if os.path.isfile(env_file):
            for line in Path(env_file).read_text(encoding="utf-8").splitlines():
                name, sign, value = line.strip().removeprefix("export ").partition("=")
                if sign and not name.startswith("#"):
                    values[name.strip()] = value.strip().strip("\"'")
        values |= os.environ
        base = Config()

        def number(name: str, default: int) -> int:
            text = values.get(name, "")
            return int(text) if text.isascii() and text.removeprefix("+").isdigit() else default

        return Config(
            values.get("DB_PATH", base.db_path), values.get("MODEL_DIR", base.model_dir), values.get("MODEL_URL", base.model_url), number("SEARCH_LIMIT", base.search_limit), number("SEARCH_RRF_K", base.search_rrf_k),
            number("SEARCH_ADJACENT_WINDOW", base.search_adjacent_window),
        )
