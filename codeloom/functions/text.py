"""Text, path and token functions as Spark columns; everything here but ``fuzzy_score`` stays in the JVM."""

from __future__ import annotations

import fnmatch
import os
import re

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from codeloom.session import ship_file, shipped

#: Lines longer than this take no part in fuzzy search.
FUZZY_LINE_CHARS = 2000
# Characters after which a word begins.
SEPARATORS = " \t\r\n_-./\\:;,()[]{}<>'\"`|+=*&^%$#@!?"


# ------------------------------------------------------------------ lines and terms


def line_count(text: Column) -> Column:
    """Number of line feeds plus one; null for null."""
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def lines_of(text: Column) -> Column:
    """Lines as reading a file gives them: any of \\r\\n, \\r and \\n ends one, no empty line after the last end."""
    parts = F.split(text, r"\r\n|\r|\n")
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def terms_of(query: Column) -> Column:
    """Terms between runs of white space, empty ones left out."""
    return F.filter(F.split(query, r"\s+"), lambda t: t != "")


def source_slice(text: Column, first: Column, last: Column) -> Column:
    """Lines ``first`` to ``last`` (1-based, both included); empty where the text is null or the range is."""
    parts = F.split(text, "\n")
    start = F.greatest(first, F.lit(1))
    length = F.least(last, F.size(parts)) - start + 1
    return F.when(text.isNotNull() & (length > 0), F.array_join(F.slice(parts, start, length), "\n")).otherwise(F.lit(""))


# ------------------------------------------------------------------ tokens


def char_tokens(text: Column, per_token: int = 4) -> Column:
    """Tokens by length: a quarter of the characters, rounded up."""
    return F.ceil(F.length(text) / per_token).cast("int")


def word_tokens(text: Column) -> Column:
    return F.size(terms_of(text))


def token_counter(name: str = "character"):
    """Column function that counts tokens: ``character`` or ``simple``; ``bpe`` counts with a public vocabulary file."""
    if name == "character":
        return char_tokens
    if name == "simple":
        return word_tokens
    if name == "bpe":
        return bpe_tokens
    raise ValueError(f"unknown tokenizer {name!r}")


_ENCODINGS: dict = {}
BPE_FILE = os.environ.get("CODELOOM_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def _encoding(path: str):
    if path not in _ENCODINGS:
        import base64

        import tiktoken

        with open(shipped(path), "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        _ENCODINGS[path] = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def bpe_tokens(text: Column, path: str = BPE_FILE) -> Column:
    ship_file(SparkSession.getActiveSession(), path)

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        encoding = _encoding(path)
        return texts.map(lambda t: len(encoding.encode_ordinary(t)), na_action="ignore")

    return count(text)


def truncate_lines(text: Column, limit: Column | int, counter=char_tokens) -> Column:
    """The longest prefix of whole lines whose tokens, each later line counted with its line feed, stay within ``limit``."""
    limit = limit if isinstance(limit, Column) else F.lit(limit)
    zero = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("kept"), F.lit(True).alias("open"))

    def add(state, line):
        cost = counter(F.when(F.size(state["kept"]) == 0, line).otherwise(F.concat(F.lit("\n"), line)))
        fits = state["open"] & (state["used"] + cost <= limit)
        return F.when(fits, F.struct((state["used"] + cost).alias("used"), F.concat(state["kept"], F.array(line)).alias("kept"), F.lit(True).alias("open"))).otherwise(F.struct(state["used"], state["kept"], F.lit(False).alias("open")))

    cut = F.aggregate(F.split(text, "\n"), zero, add, lambda s: F.array_join(s["kept"], "\n"))
    return F.when(counter(text) <= limit, text).when(limit <= 0, F.lit("")).otherwise(cut)


def truncate_marked(text: Column, limit: int = 512, reserve: int = 15, counter=char_tokens) -> Column:
    """``text`` if it fits; else whole lines up to ``limit`` less ``reserve`` tokens, followed by a mark."""
    return F.when(counter(text) <= limit, text).otherwise(F.concat(truncate_lines(text, limit - reserve, counter), F.lit(" [truncated]")))


# ------------------------------------------------------------------ paths and globs


def glob_regex(pattern: str) -> str:
    """Java regular expression of a shell glob that matches whole paths: ``*`` and ``?`` also match slashes, case counts."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            end = pattern.find("]", i + (2 if pattern[i : i + 1] == "!" else 1))
            if end < 0:
                out.append("\\[")
                continue
            body, i = pattern[i:end], end + 1
            negated = body.startswith("!")
            body = re.sub(r"([\\\[\]&~|^])", r"\\\1", body[1:] if negated else body)
            out.append(f"[{'^' if negated else ''}{body}]")
        else:
            out.append(re.sub(r"([^\w\s/])", r"\\\1", c))
    return "(?s)^" + "".join(out) + "$"


def is_glob(pattern: str) -> bool:
    return any(c in pattern for c in "*?[")


def matches_glob(path: Column, pattern: str) -> Column:
    """Whole-path glob match; a pattern without wildcards becomes an equality, which a scan can push down."""
    return path.rlike(glob_regex(pattern)) if is_glob(pattern) else path == pattern


def parse_query(query: str) -> tuple[str, str | None, list[str]]:
    """(clean query, path filter, exclusions): ``path:`` or ``file:`` filters (the last counts), ``-path:`` or ``exclude:``
    exclude (all count, empty ones do not); what remains is joined by single blanks."""
    kept, include, exclude = [], None, []
    for token in query.split():
        name, colon, value = token.partition(":")
        if colon and name in ("path", "file"):
            include = value
        elif colon and name in ("-path", "exclude"):
            exclude += [value] if value else []
        else:
            kept.append(token)
    return " ".join(kept), include, exclude


def query_parts(query: Column) -> Column:
    """``parse_query`` over a column: struct (clean, include, excludes)."""
    terms = terms_of(query)
    value = lambda t: F.regexp_extract(t, r"^[^:]*:(.*)$", 1)
    includes = F.filter(terms, lambda t: t.rlike("^(path|file):"))
    excludes = F.filter(F.transform(F.filter(terms, lambda t: t.rlike("^(-path|exclude):")), value), lambda v: v != "")
    clean = F.array_join(F.filter(terms, lambda t: ~t.rlike("^(path|file|-path|exclude):")), " ")
    return F.struct(clean.alias("clean"), F.when(F.size(includes) > 0, value(F.element_at(includes, -1))).alias("include"), excludes.alias("excludes"))


def excluded(path: Column, patterns: list[str]) -> Column:
    """Whether a path holds one of the patterns as text or matches it as a glob anywhere."""
    out = F.lit(False)
    for p in patterns:
        out = out | path.contains(p)
        if is_glob(p):
            out = out | path.rlike(glob_regex(f"*{p}*"))
    return out


def resolve_filter(pattern: str | None, root: str) -> str | None:
    """A relative folder pattern under the indexed root; absolute ones and those that begin with a wildcard stay."""
    if not pattern or pattern.startswith(("/", "*", "?", "[")) or "/" not in pattern:
        return pattern
    return root.rstrip("/") + "/" + pattern


def resolve_path(path: Column, base: str) -> Column:
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), path))


def collection_name(path: Column, prefix: str = "codebase", most: int = 40) -> Column:
    """prefix, the folder's name in lower case with other characters as single underscores, and 8 digits of the path's hash."""
    name = F.regexp_replace(F.lower(F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)), "[^a-z0-9]+", "_")
    name = F.regexp_replace(F.substring(F.regexp_replace(name, "^_+|_+$", ""), 1, most), "_+$", "")
    return F.concat_ws("_", F.lit(prefix), F.when(name != "", name).otherwise(F.lit("root")), F.substring(F.sha2(path, 256), 1, 8))


def module_of(path: Column) -> Column:
    """Dotted module path: no leading ``src/``, no extension, slashes as dots."""
    bare = F.regexp_replace(F.regexp_replace(path, "^src/", ""), r"\.[^.]*$", "")
    return F.translate(bare, "/", ".")


def fqn_of(path: Column, name: Column, parent: Column) -> Column:
    """module, parent and name joined by dots; a null parent is left out."""
    return F.concat_ws(".", module_of(path), parent, name)


def edge_type_of(ref_type: Column) -> Column:
    """Edge type of a reference type; unknown ones are calls."""
    return F.when(ref_type == "import", "import").when(ref_type == "inheritance", "inherits").otherwise("call")


# ------------------------------------------------------------------ documentation


def normalize_doc(doc: Column, language: Column) -> Column:
    """Documentation without the comment marks of its language, at most one blank line in a row, trimmed; null gives ''."""
    block = F.regexp_replace(F.regexp_replace(F.regexp_replace(doc, r"(?m)^\s*/\*\*?", ""), r"(?m)\*/\s*$", ""), r"(?m)^[ \t]*\*[ \t]?", "")
    triple = F.regexp_replace(doc, r"(?m)^\s*///[ \t]?", "")
    double = F.regexp_replace(doc, r"(?m)^\s*//[ \t]?", "")
    quoted = F.regexp_replace(F.regexp_replace(F.trim(doc), r"^(\"\"\"|''')", ""), r"(\"\"\"|''')$", "")
    head = F.ltrim(doc)
    by_look = F.when(head.startswith("/*"), block).when(head.startswith("///"), triple).when(head.startswith("//"), double).when(head.rlike(r"^(\"\"\"|''')"), quoted).otherwise(doc)
    text = (
        F.when(language.isin("javascript", "typescript", "java"), block)
        .when(language.isin("c", "cpp"), F.when(head.startswith("///"), triple).otherwise(block))
        .when(language == "go", double)
        .when(language == "python", quoted)
        .otherwise(by_look)
    )
    clean = F.regexp_replace(F.regexp_replace(text, r"(?m)[ \t]+$", ""), r"\n{3,}", "\n\n")
    return F.coalesce(F.regexp_replace(clean, r"^\s+|\s+$", ""), F.lit(""))


def embed_text(doc: Column, code: Column, language: Column) -> Column:
    """What is embedded for a symbol: its documentation, a rule and its code, or the code alone."""
    plain = normalize_doc(doc, language)
    return F.when(plain != "", F.concat(plain, F.lit("\n---\n"), code)).otherwise(code)


def pretty_doc(doc: Column) -> Column:
    """Lines without trailing blanks, no blank lines at either end; normalising the result changes nothing."""
    return F.coalesce(F.regexp_replace(F.regexp_replace(doc, r"(?m)[ \t]+$", ""), r"^\n+|\n+$", ""), F.lit(""))


def indentation(line: Column) -> Column:
    return F.length(line) - F.length(F.regexp_replace(line, r"^\s+", ""))


# Beginnings of lines before which a text may be split, one pattern each.
STATEMENTS = [
    r"def\s+",
    r"class\s+",
    r"if\s+",
    r"elif\s+",
    r"else\s*:",
    r"for\s+",
    r"while\s+",
    r"try\s*:",
    r"except",
    r"finally\s*:",
    r"with\s+",
    r"return\s",
    r"yield\s",
    r"raise\s",
    r"@",
]
#: One expression for a column test.
STATEMENT_STARTS = r"^\s*(?:" + "|".join(STATEMENTS) + ")"


def starts_statement(line: Column) -> Column:
    return line.rlike(STATEMENT_STARTS)


# ------------------------------------------------------------------ fuzzy match


_CASES = str.maketrans({c: " " for c in SEPARATORS})


def word_starts(line: str) -> list[bool]:
    """For each character whether a word begins there: first of the line, after a separator, a capital after a small letter, a
    letter after a digit."""
    kinds = "".join("s" if c == " " else "u" if c.isupper() else "l" if c.islower() else "d" if c.isdigit() else "a" if c.isalpha() else "o" for c in line.translate(_CASES))
    return [True, *(a == "s" or a + b in ("lu", "du", "dl", "da") for a, b in zip(kinds, kinds[1:], strict=False))] if line else []


def fuzzy_value(pattern: str, text: str, shown: str) -> float:
    """Score in [0, 1] of ``pattern`` as a subsequence of ``text``, taken greedily from the left; ``shown`` has the letter case.

    Every character earns 1, a match at the start and one at the beginning of a word 2 each, later ones at the beginning of a
    word 0.5, adjacent ones 1; a skipped character costs 0.05, each one before the first match 0.01. The sum is divided by the
    most a pattern of that length can earn. One character scores 1 if it occurs.
    """
    n = len(pattern)
    if n < 2:
        return 1.0 if n and pattern in text else 0.0
    total, at, last = float(n), -1, -1
    starts = word_starts(shown)
    for k, c in enumerate(pattern):
        at = text.find(c, last + 1)
        if at < 0:
            return 0.0
        begins = starts[at]
        if k == 0:
            total += 2.0 * (at == 0) + 2.0 * begins - 0.01 * at
        else:
            total += 0.5 * begins + (1.0 if at == last + 1 else -0.05 * (at - last - 1))
        last = at
    return min(1.0, max(0.0, total / (n + 4.0 + 1.5 * (n - 1))))


def fuzzy_score(query: str, line: Column, least: float = 0.6, case_sensitive: bool = False) -> Column:
    """Mean score of the query's terms over a column of lines, weighted by their length; null where a term scores below
    ``least`` and for lines that are null, empty or too long. Arrow batches; each term is tried on each line once."""
    terms = [t if case_sensitive else t.lower() for t in query.split()]

    @F.pandas_udf("double")
    def score(lines: pd.Series) -> pd.Series:
        def one(text):
            if not isinstance(text, str) or not text or len(text) > FUZZY_LINE_CHARS or not terms:
                return None
            seen, total = text if case_sensitive else text.lower(), 0.0
            for t in terms:
                s = fuzzy_value(t, seen, text)
                if s < least:
                    return None
                total += s * len(t)
            return total / sum(map(len, terms))

        return lines.map(one).astype("float64")

    return score(line)


def glob_match(path: str, pattern: str) -> bool:
    """The glob predicate for single paths on the driver."""
    return fnmatch.fnmatchcase(path, pattern)
