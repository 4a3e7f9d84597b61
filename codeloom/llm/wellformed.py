"""Source files that do not parse: bundled grammars, generalised LR tables, the first unrecoverable error per file.

Every language of the registry but markdown has a grammar. Each worker builds the tables of a language when it meets the first
file of it (half a second for the largest) and keeps them. Token streams are parsed to the end; ambiguities are followed on a graph-structured stack, so that a text is
broken only if no reading of it is left. The tests hold the Python and JSON grammars against the standard library's parsers.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.grammar import csharp, grammars, kotlin, lexers, lua_r, php, ruby, rust, scala, swift
from codeloom.llm.grammar.tables import Recogniser, build_tables

EITHER = "either"
#: language: (grammar, lexer, whether a missing semicolon may be inserted; EITHER: every line end may be one)
LANGUAGES = {
    "python": (grammars.PYTHON, lexers.python_tokens, False),
    "javascript": (grammars.JAVASCRIPT, lexers.script_tokens, True),
    "typescript": (grammars.TYPESCRIPT, lambda text: lexers.script_tokens(text, typed=True, jsx=False), True),
    "tsx": (grammars.TYPESCRIPT, lambda text: lexers.script_tokens(text, typed=True), True),
    "go": (grammars.GO, lexers.go_tokens, False),
    "java": (grammars.JAVA, lexers.java_tokens, False),
    "c": (grammars.C, lexers.c_tokens, False),
    "cpp": (grammars.CPP, lexers.cpp_tokens, False),
    "json": (grammars.JSON, lexers.json_tokens, False),
    "yaml": (grammars.YAML, lexers.yaml_tokens, False),
    "sql": (grammars.SQL, lexers.sql_tokens, False),
    "shell": (grammars.SHELL, lexers.shell_tokens, False),
    "lua": (lua_r.LUA, lua_r.lua_tokens, False),
    "r": (lua_r.R, lua_r.r_tokens, False),
    "kotlin": (kotlin.KOTLIN, kotlin.kotlin_tokens, EITHER),
    "kts": (kotlin.SCRIPT, kotlin.kotlin_tokens, EITHER),
    "csharp": (csharp.CSHARP, csharp.csharp_tokens, False),
    "scala": (scala.SCALA, scala.scala_tokens, EITHER),
    "swift": (swift.SWIFT, swift.swift_tokens, EITHER),
    "php": (php.PHP, php.php_tokens, False),
    "rust": (rust.RUST, rust.rust_tokens, False),
    "ruby": (ruby.RUBY, ruby.ruby_tokens, EITHER),
}

_PARSERS: dict[str, tuple] = {}


def check_text(language: str, text: str | None) -> tuple[int, str] | None:
    """(line, reason) of the first error that cannot be recovered from, None if the text is well-formed.

    Empty text, markdown and languages that are not in the registry are well-formed; a NUL byte or a replacement character for undecodable
    bytes outside strings and comments is an error in every bundled language.
    """
    if not text or language not in LANGUAGES:
        return None
    if language not in _PARSERS:
        grammar, lexer, inserts = LANGUAGES[language]
        _PARSERS[language] = (lexer, Recogniser(build_tables(grammar), inserts is True, inserts == EITHER))
    lexer, recogniser = _PARSERS[language]
    if "\0" in text:
        return text.count("\n", 0, text.index("\0")) + 1, "NUL byte"
    if not text.strip() and language != "json":
        return None
    try:
        tokens = _tokens(lexer, text)
    except lexers.LexError as error:
        return text.count("\n", 0, error.position) + 1, error.message
    at = recogniser.first_error(tokens)
    if at is not None and language == "cpp":  # a comparison may have been taken for template arguments
        again = lexer(text, names_may_follow=False)
        if again != tokens and recogniser.first_error(again) is None:
            return None
    if at is None:
        return None
    if at >= len(tokens):
        return text.count("\n") + 1, "unexpected end"
    return text.count("\n", 0, tokens[at][1]) + 1, f"unexpected {tokens[at][0]}"


def _tokens(lexer: Callable[[str], list[tuple]], text: str) -> list[tuple]:
    """Tokens of a text nested however deeply: lexers call themselves for what stands inside a string or bracket."""
    try:
        return lexer(text)
    except RecursionError:
        limit = sys.getrecursionlimit()
        sys.setrecursionlimit(limit + 4 * len(text))
        try:
            return lexer(text)
        finally:
            sys.setrecursionlimit(limit)


def _language_of(path: str, languages: dict[str, str]) -> str:
    name = path.rsplit("/", 1)[-1]
    extension = "." + name.rsplit(".", 1)[-1].lower() if "." in name[1:] else ""
    return "tsx" if extension == ".tsx" else languages.get(extension, "unknown")


def check_files(files: DataFrame, languages: dict[str, str]) -> DataFrame:
    """(file_path, repo, language, error_line, reason) of every row of ``files``; line and reason are null where it parses.

    ``files`` has file_path, repo and content; the language is that of the file name extension in ``languages``. Null or empty
    content is well-formed; markdown and unknown extensions are well-formed; null paths are left out; repeated rows are repeated.
    Every text is parsed whole. Extra columns are ignored.
    """
    whole = files.where("file_path is not null").select("file_path", "repo", "content")  # nothing is shuffled

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, repo, text in batch.itertuples(index=False, name=None):
                language = _language_of(path, languages)
                text = text if isinstance(text, str) else ""
                error = check_text("kts" if path.lower().endswith(".kts") and language == "kotlin" else language, text)
                out.append((path, repo, language, *(error or (None, None))))
            result = pd.DataFrame(out, columns=["file_path", "repo", "language", "error_line", "reason"])
            yield result.astype({"error_line": "Int64"})

    return whole.mapInPandas(run, "file_path string, repo string, language string, error_line bigint, reason string")


def error_rates(checked: DataFrame) -> DataFrame:
    """(repo, language, n_files, n_broken, broken_share) per repository and language."""
    broken = F.col("reason").isNotNull()
    return checked.groupBy("repo", "language").agg(F.count_distinct("file_path").alias("n_files"), F.count_distinct(F.when(broken, F.col("file_path"))).alias("n_broken")).withColumn("broken_share", F.round(F.col("n_broken") / F.col("n_files"), 6))
