"""Line search: substring, regular expression and fuzzy, with lines of context."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import excluded, fuzzy_score, lines_of, matches_glob

MODES = ("substring", "regex", "fuzzy")


def explode_lines(files: DataFrame, path: str = "file_path", content: str = "content") -> DataFrame:
    """(file_path, line, text, digest) with 1-based numbers; ``digest`` tells texts of one path apart. Null content has none."""
    return files.select(F.col(path).alias("file_path"), F.xxhash64(content).alias("digest"), F.posexplode(lines_of(F.col(content))).alias("pos", "text")).select("file_path", (F.col("pos") + 1).alias("line"), "text", "digest")


def _java_flags(case_sensitive: bool) -> str:
    return "" if case_sensitive else "(?iu)"


def line_test(text: Column, query: str, mode: str, case_sensitive: bool, all_terms: bool) -> Column:
    if mode == "regex":
        for pattern in query.split() if all_terms else [query]:
            re.compile(pattern)  # a broken pattern fails here, not in the tasks
        tests = [text.rlike(_java_flags(case_sensitive) + p) for p in (query.split() if all_terms else [query])]
    else:
        fold = (lambda c: c) if case_sensitive else F.lower
        needles = query.split() if all_terms else [query]
        tests = [fold(text).contains(n if case_sensitive else n.lower()) for n in needles]
    out = tests[0] if tests else F.lit(False)
    for t in tests[1:]:
        out = out & t
    return out


def search_lines(files: DataFrame, query: str, mode: str = "substring", limit: int = 20, context_lines: int = 3, case_sensitive: bool = False, file_filter: str | None = None, all_terms: bool = False, fuzzy_min_score: float = 0.6, path: str = "file_path", content: str = "content", exclude: list[str] | None = None) -> DataFrame:
    """(chunk_id, file_path, start_line, end_line, match_line, content, score) of the first or best ``limit`` lines.

    Substring and regular-expression hits score 1 and come in order of file and line; fuzzy hits come by descending score,
    then file and line. A blank query or a limit below 1 finds nothing; an unknown mode is an error. Files whose text is
    null are skipped, equal hits of repeated files count once each. The whole text of every file is searched.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    limit, context_lines = max(0, limit), max(0, context_lines)
    if file_filter:
        files = files.where(matches_glob(F.col(path), file_filter))
    if exclude:
        files = files.where(~excluded(F.col(path), exclude))
    files = files.where(F.col(content).isNotNull())
    if not query.strip() or not limit:
        hits = explode_lines(files.where(F.lit(False)), path, content).withColumn("score", F.lit(1.0))
    elif mode == "fuzzy":
        hits = explode_lines(files, path, content).withColumn("score", fuzzy_score(query, F.col("text"), min(1.0, max(0.0, fuzzy_min_score)), case_sensitive)).where("score is not null")
    else:
        if mode == "substring":  # a line can only hold what its text holds
            files = files.where(line_test(F.col(content), query, mode, case_sensitive, all_terms))
        hits = explode_lines(files, path, content).where(line_test(F.col("text"), query, mode, case_sensitive, all_terms)).withColumn("score", F.lit(1.0))
    order = [*([F.col("score").desc()] if mode == "fuzzy" else []), F.col("file_path"), F.col("line")]
    best = hits.select("file_path", "line", "score", "digest").orderBy(*order, "digest").limit(limit)
    # lines around a hit are cut from the texts of the few files that have one
    texts = files.select(F.col(path).alias("file_path"), F.xxhash64(content).alias("digest"), F.col(content).alias("_text"))
    texts = texts.join(best.select("file_path", "digest").distinct(), ["file_path", "digest"], "left_semi").distinct().withColumn("lines", lines_of(F.col("_text")))
    found = best.join(texts, ["file_path", "digest"])
    first = F.greatest(F.lit(1), F.col("line") - context_lines)
    last = F.least(F.size("lines"), F.col("line") + context_lines)
    kind = {"substring": "grep", "regex": "grep_regex", "fuzzy": "fuzzy"}[mode]
    return found.select(
        F.concat_ws(":", F.lit(kind), "file_path", first, "line").alias("chunk_id"),
        "file_path",
        first.alias("start_line"),
        last.alias("end_line"),
        F.col("line").alias("match_line"),
        F.array_join(F.slice("lines", first, last - first + 1), "\n").alias("content"),
        "score",
    ).orderBy(*order[:-1], F.col("match_line"))
