"""Parsing as DataFrame operators; one pass over the files gives definitions, references and import lines."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.parse import braces, python

#: language: (definitions, references); other languages have neither. More may be registered.
PARSERS: dict[str, tuple[Callable, Callable]] = {"python": (python.definitions, python.references)} | {
    name: (lambda text, n=name: braces.definitions(text, n), lambda text, n=name: braces.references(text, n)) for name in ("javascript", "typescript", "go", "java", "c", "cpp")
}

#: language: what is wrong with a source, or None; for languages whose parser can tell.
CHECKS: dict[str, Callable[[str], str | None]] = {"python": python.syntax_error}
#: language: (text, language) -> import lines, where the built-in reader does not do.
IMPORTS: dict[str, Callable[[str, str], list[str]]] = {}


def register_parser(language: str, definitions: Callable[[str], list[tuple]], references: Callable[[str], list[tuple]], imports: Callable[[str, str], list[str]] | None = None, check: Callable[[str], str | None] | None = None) -> None:
    """Add or replace the parser of a language, for plans made afterwards: the functions travel with the plan."""
    name = language.strip().lower()
    PARSERS[name] = (definitions, references)
    for table, given in ((IMPORTS, imports), (CHECKS, check)):
        if given:
            table[name] = given
        else:
            table.pop(name, None)


_NODE = "node_type string, name string, start_line int, end_line int, content string, parent_name string, docstring string"
_REF = "name string, ref_type string, line int, parent_symbol string"


def import_lines(text: str, language: str) -> list[str]:
    """Import lines at the head of a source, up to the first line of other code; of Go the paths, also of a block."""
    out: list[str] = []
    block = False
    for raw in text.split("\n"):
        line = raw.strip()
        if language == "go":
            if line.startswith("import ("):
                block = True
            elif block and line == ")":
                break
            elif block or line.startswith("import "):
                path = re.search(r'"([^"]+)"', line)
                out += [path.group(1)] if path else []
            continue
        if language == "python":
            hit, pass_ = line.startswith(("import ", "from ")), not line or line.startswith(("#", '"""', "'''"))
        elif language in ("javascript", "typescript"):
            hit = line.startswith("import ") or line.startswith("const ") and " require(" in line
            pass_ = not line or line.startswith(("export ", "//", "/*")) or "require(" in line
        else:
            return []
        if hit:
            out.append(line)
        elif not pass_:
            break
    return out


def parse_files(files: DataFrame) -> DataFrame:
    """(file_path, language, nodes, refs, imports, error) with nodes and refs as arrays of structs.

    ``files`` has file_path, language and content. Files of other languages, and null contents, have empty arrays; a parser
    that fails, or a Python source that does not parse, leaves its message in ``error`` and empty arrays, and the other files
    are not touched by it.
    """
    chosen = files.select("file_path", F.lower("language").alias("language"), "content")
    parsers, checks, importers = dict(PARSERS), dict(CHECKS), dict(IMPORTS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, ref = ([c.split()[0] for c in s.split(", ")] for s in (_NODE, _REF))
        for batch in batches:
            out = []
            for path, language, text in batch.itertuples(index=False, name=None):
                nodes: list = []
                refs: list = []
                imports: list = []
                error = None
                if language in parsers and isinstance(text, str):
                    try:
                        define, refer = parsers[language]
                        nodes = [dict(zip(node, n, strict=True)) for n in define(text)]
                        refs = [dict(zip(ref, r, strict=True)) for r in refer(text)]
                        imports = importers.get(language, import_lines)(text, language)
                        error = checks[language](text) if language in checks else None
                    except Exception as e:  # one file must not end the job
                        nodes, refs, imports, error = [], [], [], f"{type(e).__name__}: {e}"
                out.append((path, language, nodes, refs, imports, error))
            yield pd.DataFrame(out, columns=["file_path", "language", "nodes", "refs", "imports", "error"])

    return chosen.mapInPandas(run, f"file_path string, language string, nodes array<struct<{_colon(_NODE)}>>, refs array<struct<{_colon(_REF)}>>, imports array<string>, error string")


def _colon(schema: str) -> str:
    return ", ".join(c.replace(" ", ":", 1) for c in schema.split(", "))


def definitions_of(parsed: DataFrame) -> DataFrame:
    return parsed.select("file_path", "language", F.explode("nodes").alias("n")).select("file_path", "language", "n.*")


def references_of(parsed: DataFrame) -> DataFrame:
    return parsed.select("file_path", F.explode("refs").alias("r")).select("file_path", "r.*")
