"""File name extensions and the languages they stand for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The project's extension registry.
REGISTRY = {
    "python": [".py", ".pyw", ".pyi"],
    "javascript": [".js", ".jsx", ".mjs", ".cjs"],
    "typescript": [".ts", ".tsx", ".mts", ".cts"],
    "go": [".go"],
    "rust": [".rs"],
    "c": [".c", ".h"],
    "cpp": [".cpp", ".cc", ".cxx", ".hpp", ".hxx"],
    "java": [".java"],
    "kotlin": [".kt", ".kts"],
    "scala": [".scala", ".sc"],
    "csharp": [".cs"],
    "swift": [".swift"],
    "ruby": [".rb", ".rake", ".gemspec"],
    "php": [".php"],
    "lua": [".lua"],
    "r": [".r"],
    "shell": [".sh", ".bash", ".zsh"],
    "sql": [".sql"],
    "markdown": [".md", ".markdown"],
    "yaml": [".yaml", ".yml"],
    "json": [".json"],
}
EXTENSIONS = {ext: language for language, exts in REGISTRY.items() for ext in exts}


def register_language(name: str, extensions: list[str]) -> None:
    """Add a language, or extensions to one; an extension belongs to the language that was registered last."""
    for ext in (e.lower() if e.startswith(".") else "." + e.lower() for e in extensions):
        EXTENSIONS[ext] = name.strip().lower()


def unregister_language(name: str) -> None:
    for ext in [e for e, n in EXTENSIONS.items() if n == name.strip().lower()]:
        del EXTENSIONS[ext]


def load_registry(path: str) -> None:
    """Replace the registry by a JSON (or, where PyYAML is there, YAML) file of language: [extensions]."""
    with open(path, encoding="utf-8") as file:
        if path.endswith((".yaml", ".yml")):
            import yaml

            given = yaml.safe_load(file)
        else:
            import json

            given = json.load(file)
    EXTENSIONS.clear()
    for name, extensions in given.items():
        register_language(name, extensions)


def extension_of(path: Column) -> Column:
    """Lower-case suffix of the last path component, with its dot; empty where there is none (a leading dot is none)."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def detect_language(path: Column) -> Column:
    """Language of a path by its extension, ``unknown`` where the registry has none; null for a null path."""
    known = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.when(path.isNotNull(), F.coalesce(known[extension_of(path)], F.lit("unknown")))
