"""Settings: defaults, then a JSON (or, where PyYAML is there, YAML) file, then environment variables."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field, fields, replace

from codeloom.functions.languages import EXTENSIONS

_SECRET = ("key", "token", "password", "secret")


@dataclass(frozen=True)
class Settings:
    """Everything the engine can be told; ``CODELOOM_<NAME>`` in the environment overrides a field."""

    file_extensions: list[str] = field(default_factory=lambda: sorted(EXTENSIONS))
    chunk_lines: int = 50
    chunk_overlap: int = 2
    max_chunk_tokens: int = 8192
    max_summary_tokens: int = 512
    tokenizer: str = "character"
    dimension: int = 64
    default_limit: int = 10
    candidates: int = 20
    rerank_multiplier: int = 5
    graph_enabled: bool = True
    graph_depth: int = 3
    context_tokens: int = 8192
    debounce_ms: int = 2000
    api_key: str = ""

    def __post_init__(self):
        if not 0 <= self.chunk_overlap < self.chunk_lines:
            raise ValueError("chunk_overlap must be at least 0 and below chunk_lines")
        if self.debounce_ms < 0 or self.dimension < 1 or self.default_limit < 1:
            raise ValueError("debounce_ms, dimension and default_limit are out of range")
        if self.tokenizer not in ("character", "simple", "bpe"):
            raise ValueError(f"unknown tokenizer {self.tokenizer!r}")

    def shown(self) -> dict:
        """All fields, secrets masked."""
        return {k: "***" if v and any(s in k.lower().split("_") for s in _SECRET) else v for k, v in asdict(self).items()}


def _parse(text: str, like):
    if isinstance(like, bool):
        return text.strip().lower() in ("1", "true", "yes", "on")
    if isinstance(like, int):
        return int(text)
    return [x for x in text.split(",") if x] if isinstance(like, list) else text


def load_settings(path: str | None = None, environment: dict[str, str] | None = None) -> Settings:
    """Settings of a file (unknown keys are ignored) under those of the environment."""
    out = Settings()
    known = {f.name for f in fields(Settings)}
    if path:
        with open(path, encoding="utf-8") as file:
            if path.endswith((".yaml", ".yml")):
                import yaml

                given = yaml.safe_load(file) or {}
            else:
                given = json.load(file)
        out = replace(out, **{k: v for k, v in given.items() if k in known})
    env = os.environ if environment is None else environment
    found = {f.name: _parse(env[f"CODELOOM_{f.name.upper()}"], getattr(out, f.name)) for f in fields(Settings) if f"CODELOOM_{f.name.upper()}" in env}
    return replace(out, **found)


def save_settings(settings: Settings, path: str) -> None:
    """Write the settings as JSON, secrets left out; ``load_settings`` reads them back."""
    kept = {k: v for k, v in asdict(settings).items() if not any(s in k.lower().split("_") for s in _SECRET)}
    with open(path, "w", encoding="utf-8") as file:
        json.dump(kept, file, indent=2, sort_keys=True)
