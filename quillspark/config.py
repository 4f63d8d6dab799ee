"""Settings of an application: defaults, a JSON file over them, the environment over both."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, fields

#: Environment variables that hold the keys of providers: the provider's name and this.
KEY, PREFIX = "_API_KEY", "QUILL_"


@dataclass(frozen=True)
class Config:
    chat: str = "echo"
    embedding: str = "hash"
    neighbours: int = 5
    chunk_size: int = 1200
    chunk_overlap: int = 300
    backward_depth: int = 2
    forward_depth: int = 1
    max_papers: int | None = None
    scope: str = "cited_local"


def load(path: str | None = None, env: dict[str, str] | None = None) -> Config:
    """A Config of the file at path, if there is one, and of QUILL_<NAME> in the environment. Unknown names are an error."""
    env = os.environ if env is None else env
    given = {}
    if path and os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
    kinds = {f.name: f.type for f in fields(Config)}
    if unknown := set(given) - set(kinds):
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    for name, kind in kinds.items():
        if (text := env.get(PREFIX + name.upper())) is not None:
            given[name] = int(text) if "int" in kind else text
    return Config(**given)


def api_key(provider: str, env: dict[str, str] | None = None) -> str:
    """The key of a provider, from the environment alone."""
    env = os.environ if env is None else env
    if not (key := env.get(provider.upper() + KEY)):
        raise ValueError(f"{provider.upper()}{KEY} isn't set")
    return key
