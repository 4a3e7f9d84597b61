"""Generated, minified, vendored and data files, so that only hand-written source remains.

Every file is read once and fingerprinted by winnowing, twice: its token stream (comments and layout dropped) for copies, and
the same stream with names, numbers and literals folded to classes for repetition.

* Copies: a file most of whose fingerprints occur in several repositories is a copy; so is one too short for fingerprints
  whose whole stream does, and one whose content hash the record of indexed files shows in several repositories.
* Machine-made shape: a file most of whose folded fingerprints recur in itself is made of one pattern. What the pattern is
  decides an exact check of its text: names that count up (generated), long lines of short names (minified), literals
  instead of code (data). A repetitive test by hand has none of these.
* A library of which the collection holds one instance recurs nowhere. It is told by the banner of its leading comments or
  by its folder, a generated file without repetition by its banner. A folder that only may hold libraries counts if the name
  below it is that of a library in several repositories, and of no ordinary folder.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.wellformed import check_files
from codeloom.operators.incremental import normal_hash
from codeloom.operators.skew import join_split_hot
from codeloom.session import cut_lineage

#: Tokens hashed together, hashes per window, and what makes a copy: repositories that share a fingerprint, share of a
#: file's fingerprints that so recur. A stream under GRAM tokens is too little to recognise.
GRAM, WINDOW = 20, 16
COPY_REPOS, COPY_SHARE = 3, 0.8
#: The same for the folded stream, and what makes a pattern: occurrences in the file, share of the fingerprints.
FOLD_GRAM, FOLD_WINDOW = 8, 4
PATTERN_TIMES, PATTERN_SHARE = 3, 0.8
#: A literal counts as one folded token per so many characters.
LITERAL_CHARS = 8
#: Least evidence: names that count up, literals of a data file, names of a minified one.
LEAST_COUNTED, LEAST_LITERALS, LEAST_NAMES = 4, 8, 30
#: Repositories in which the folder of a library must occur.
LIBRARY_REPOS = 2

# Extensions of languages whose files are data or prose by nature, so that their shape tells nothing.
PLAIN = frozenset([".json", ".yaml", ".yml", ".md", ".markdown"])

_COMMENT_LINE = re.compile(r"^\s*(?://+|#+!?(?!\s*(?:include|define|ifn?def|endif|pragma|if|else|undef))|/\*+!?|\*+(?!/)|--|;+|<!--)\s?(.*?)\s*(?:\*/|-->)?\s*$")
_GENERATED = re.compile(
    r"^\W*@generated\b|^\W*(?:this\s+(?:file|code|source|module)\s+(?:was|is|has\s+been)\s+)?(?:(?:auto(?:matically)?[- ]?)?(?:generated|produced|emitted|created)\s+(?:by|from|with|using)\b|auto[- ]?generated\b)"
    r"|^\W*(?:code\s+)?generated\s+by\b.*\bdo\s+not\s+(?:edit|modify)|^\W*generated\s*:\s*\S+|machine[- ](?:written|generated)|(?:do\s+not|don't)\s+(?:edit|modify)(?:\s+(?:by\s+hand|manually|this\s+file))|edits?\s+will\s+be\s+(?:lost|overwritten)"
    r"|changes\s+(?:to\s+this\s+file\s+)?will\s+be\s+overwritten|^\W*automatisch\s+(?:erzeugt|generiert)|^\W*(?:fichier\s+)?généré\s+(?:automatiquement|par)|^\W*(?:archivo\s+)?generado\s+(?:automáticamente|por)|\bnicht\s+bearbeiten\b|\bne\s+pas\s+(?:modifier|éditer)\b|\bno\s+(?:editar|modificar)\b",
    re.I,
)
_VENDORED = re.compile(
    r"^\W*vendored\s+(?:copy|from)\b|^\W*copied\s+(?:verbatim\s+)?from\s+\S+\s+v?\d+\.\d|^\W*origin:\s*\S+-\d[\w.]*\.(?:tar|tgz|zip)|^\W*this\s+file\s+is\s+part\s+of\s+the\s+\S+\s+(?:library|project|package|distribution)|^\W*\S+\s+v?\d+\.\d[\w.]*\s+\(c\)|\bupstream\s+licen[cs]e\s+applies|\breport\s+bugs\s+upstream|local\s+changes:\s*none",
    re.I,
)
# Folders that hold other people's code, and folders that may.
_LIBRARIES = re.compile(r"(?:^|/)(?:node_modules|site-packages|bower_components|third_party|third-party|thirdparty|_vendor|_vendored)/([^/]+)(?=/)|(?:^|/)deps/([^/]+-\d[\d.]*)/")
_PERHAPS = re.compile(r"(?:^|/)(?:vendor|vendored|external|extern|deps)/([^/]+)/")
_VERSION = re.compile(r"-v?\d[\d.]*$")

_STRING = re.compile(r'"""[\s\S]*?(?:"""|\Z)|\'\'\'[\s\S]*?(?:\'\'\'|\Z)|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|`(?:\\.|[^`\\])*`')
_COMMENT = re.compile(r"/\*[\s\S]*?(?:\*/|\Z)|(?<![:\w])//[^\n]*|(?m:^[ \t]*#(?!\s*(?:include|define|ifn?def|endif|pragma|if|else|undef))[^\n]*)")
_EITHER = re.compile(_STRING.pattern + "|(?P<comment>" + _COMMENT.pattern + ")")
_LEXEME = re.compile("(?P<string>" + _STRING.pattern + ")|(?P<comment>" + _COMMENT.pattern + r")|(?P<name>[^\W\d]\w*)|(?P<number>\d\w*)|\S")
_IDENT = re.compile(r"[^\W\d]\w*")
_MAKES = re.compile(r"\b(?:def|func|function|return|for|while|if|struct|interface|void)\b|=>")
_NUMBERED = re.compile(r"[^\W\d]\w*?(\d+)(?!\w)")


def without_comments(text: str) -> str:
    """Comments as single blanks; what looks like one inside a string stays."""
    return _EITHER.sub(lambda m: " " if m.group("comment") else m.group(), text)


def banner_of(text: str) -> str:
    """generated or vendored where the leading comment lines, however many, say so, else an empty string."""
    for line in text.split("\n"):
        if not line.strip():
            continue
        comment = _COMMENT_LINE.match(line)
        first_bang = re.match(r"\s*/\*!([^*]*)\*/", line)
        if first_bang:
            said = first_bang.group(1)
        elif comment:
            said = comment.group(1)
        else:
            break
        if _VENDORED.search(said):
            return "vendored"
        if _GENERATED.search(said) and not re.search(r"\bhand[- ](?:maintained|written)\b|\blazily\b|\bat\s+(?:start-?up|run-?time|build\s+time)\b", said, re.I):
            return "generated"
    return ""


def library_of(path: str) -> tuple[str | None, bool]:
    """(name of the library folder the path lies in, whether the folder around it holds nothing but libraries)."""
    inside = "/" + (path.split("/", 1)[-1] if "/" in path else path)
    sure, perhaps = _LIBRARIES.search(inside), _PERHAPS.search(inside)
    if sure:
        return _VERSION.sub("", sure.group(1) or sure.group(2)), True
    return (_VERSION.sub("", perhaps.group(1)), False) if perhaps else (None, False)


def folder_of(path: str) -> bool:
    """Whether a path lies in a folder that holds, or may hold, libraries."""
    return library_of(path)[0] is not None


def ordinary_folders(path: str) -> list[str]:
    """Folders of a path below its repository that are neither a library's nor below one."""
    inside = "/" + (path.split("/", 1)[-1] if "/" in path else path)
    ends = [m.start() for m in (_LIBRARIES.search(inside), _PERHAPS.search(inside)) if m]
    return [f for f in inside[: min(ends)].split("/") if f] if ends else [f for f in inside.split("/")[1:-1] if f]


def shape_of(text: str) -> str:
    """generated, minified or data by what a text of one pattern is made of, else an empty string."""
    bare = without_comments(text)
    solid = max(1, len(re.sub(r"\s+", "", bare)))
    code = _STRING.sub('""', bare)
    idents = _IDENT.findall(re.sub(r"\b0[xX][0-9a-fA-F]+\b|\b\d\w*", "0", code))
    spaces = sum(c.isspace() for c in code) / max(1, len(code))
    long_ = sum(len(x) for x in code.split("\n") if len(x) > 160) / max(1, len(code))
    short = sum(map(len, idents)) / max(1, len(idents))
    if long_ > 0.5 and spaces < 0.1 and short < 4.5 and len(idents) > LEAST_NAMES:
        return "minified"
    named, makes = sum(map(len, idents)) / solid, len(_MAKES.findall(code))
    literals = len(re.findall(r"\b\d\w*", code)) + sum(1 + len(m.group()) // LITERAL_CHARS for m in _STRING.finditer(bare))
    if literals >= LEAST_LITERALS and (named < 0.2 and makes == 0 or named < 0.06 and makes <= 4):
        return "data"
    # names that count up from one line of a pattern to the next
    lines, counted, last = [x for x in code.split("\n") if x.strip()], 0, {}
    for line in lines:
        numbers = [int(n) for n in _NUMBERED.findall(line)]
        if not numbers:
            continue
        pattern = re.sub(r"(?:a_)+a?", "a", re.sub(r"[^\W\d_]+", "a", re.sub(r"\d+", "9", re.sub(r"\b0[xX][0-9a-fA-F]+", "9", line.strip()))))
        counted += any(n == b + 1 for n, b in zip(numbers, last.get(pattern, ()), strict=False))
        last[pattern] = numbers
    return "generated" if counted >= max(LEAST_COUNTED, 0.45 * len(lines)) else ""


def winnow(hashes: np.ndarray, gram: int, window: int) -> np.ndarray:
    """Positions whose hash is the least (the last of several) of some ``window`` neighbouring ``gram``-token hashes."""
    if len(hashes) < gram:
        return np.zeros(0, np.uint64)
    grams = np.zeros(len(hashes) - gram + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(gram):
            grams = grams * np.uint64(0x100000001B3) + hashes[i : i + len(grams)]
        grams ^= grams >> np.uint64(29)
        grams *= np.uint64(0x9E3779B97F4A7C15)
    if len(grams) <= window:
        return grams[[int(grams.argmin())]]
    view = np.lib.stride_tricks.sliding_window_view(grams[::-1], window)
    chosen = np.unique(np.arange(len(view)) + view.argmin(axis=1))
    return grams[::-1][chosen]


def marks_of(text: str) -> tuple[list[int], float]:
    """(fingerprints of the token stream, share of the folded stream's fingerprints that recur in the text).

    A stream of fewer fingerprints than a window has tokens is represented by the hash of the whole stream.
    """
    known: dict[str, int] = {}
    exact: list[int] = []
    folded: list[int] = []
    for m in _LEXEME.finditer(text):
        kind, token = m.lastgroup, m.group()
        if kind == "comment":
            continue
        exact.append(known.get(token) or known.setdefault(token, _hash(token)))
        if kind == "string":
            folded.extend([3] * (1 + len(token) // LITERAL_CHARS))
        else:
            folded.append(1 if kind == "name" else 2 if kind == "number" else 16 + ord(token))
    if len(exact) < GRAM:
        prints: list[int] = []
    else:
        found = np.unique(winnow(np.array(exact, np.uint64), GRAM, WINDOW)).astype(np.int64)
        prints = found.tolist() if len(found) >= GRAM // 2 else [_hash(" ".join(map(str, exact))) - (1 << 63)]
    times = Counter(winnow(np.array(folded, np.uint64) * np.uint64(0x9E3779B97F4A7C15), FOLD_GRAM, FOLD_WINDOW).tolist()) if folded else Counter()
    total = sum(times.values())
    return prints, sum(n for n in times.values() if n >= PATTERN_TIMES) / total if total else 0.0


def _hash(token: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(token)


def _extension(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return "." + name.rsplit(".", 1)[-1].lower() if "." in name else ""


def _evidence(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for path, text in zip(batch["file_path"], batch["content"], strict=True):
            text = text if isinstance(text, str) else ""
            prints, pattern = marks_of(text)
            library, sure = library_of(path)
            shape = shape_of(text) if pattern >= PATTERN_SHARE and _extension(path) not in PLAIN else ""
            out.append((path, banner_of(text), library, sure, ordinary_folders(path), round(pattern, 6), shape, prints))
        columns = list(zip(*out, strict=True)) if out else [[]] * 8
        names = ("file_path", "banner", "library", "sure", "folders", "pattern_share", "shape", "prints")
        yield pd.DataFrame({"repo": batch["repo"].tolist(), "f1": batch["f1"].tolist(), "f2": batch["f2"].tolist(), "digest": batch["digest"].tolist()} | dict(zip(names, columns, strict=True)))


_SEEN = "file_path string, repo string, f1 bigint, f2 bigint, digest string, banner string, library string, sure boolean, folders array<string>, pattern_share double, shape string, prints array<bigint>"


def not_hand_written(files: DataFrame, languages: dict[str, str], index: DataFrame | None = None) -> DataFrame:
    """(file_path, kind) of the files that are not hand-written, without those that do not parse (broken files are no cases).

    Only the flagged files are parsed; everything else is as in ``classify_files``.
    """
    flagged = classify_files(files, index).where("kind != 'hand-written'").select("file_path", "kind").distinct()
    suspects = files.select("file_path", "repo", "content").join(flagged.select("file_path").distinct(), "file_path", "left_semi")
    broken = check_files(suspects, languages).where("reason is not null").select("file_path").distinct()
    return flagged.join(broken, "file_path", "left_anti")


def _libraries(seen: DataFrame) -> DataFrame:
    """(library, is_library) of the names below folders that may hold libraries.

    A name is a library's if it lies in library folders of ``LIBRARY_REPOS`` repositories and is nowhere an ordinary folder.
    """
    below = seen.where("library is not null")
    spread = below.select("library", "repo").distinct().groupBy("library").agg(F.count(F.lit(1)).alias("n"))
    wanted = below.where("not sure").select("library").distinct().join(spread.where(F.col("n") >= LIBRARY_REPOS), "library")
    ordinary = seen.select(F.explode("folders").alias("library")).distinct()
    return wanted.join(ordinary, "library", "left_anti").select("library", F.lit(True).alias("is_library"))


def classify_files(files: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """(file_path, repo, kind, evidence, copy_share, pattern_share): kind is generated, minified, vendored, data or hand-written.

    ``files`` has file_path, repo and content; ``index``, if given, has repo and content_hash of files indexed before. Null
    content is an empty text, which is hand-written; null paths are left out; repeated rows count once; a null repo is a
    repository of its own. A path with several contents gets a row per content. ``evidence`` is what decided: fingerprints
    (copies, or a pattern), content hash, banner or folder.
    """
    whole = files.where("file_path is not null").select("file_path", F.coalesce("repo", F.lit("")).alias("repo"), "content")
    # texts are not shuffled, and per fingerprint numbers only: two 64-bit hashes stand for the row, one for the repository;
    # equal rows share their hashes and fold where fingerprints are counted
    whole = whole.withColumns({f"f{i}": F.xxhash64(F.lit(i), "file_path", "repo", "content") for i in (1, 2)} | {"digest": F.sha2("content", 256)})
    seen = cut_lineage(whole.mapInPandas(_evidence, _SEEN))
    marks = seen.select("f1", "f2", F.xxhash64("repo").alias("r"), F.explode("prints").alias("mark"))
    spread = marks.select("mark", "r").distinct().groupBy("mark").agg(F.count(F.lit(1)).alias("n_repos")).where(F.col("n_repos") >= COPY_REPOS).select("mark")
    hits = join_split_hot(marks.select("f1", "f2", "mark"), spread, "mark", "left_semi").distinct().groupBy("f1", "f2").agg(F.count(F.lit(1)).alias("n_copied"))
    judged = seen.drop("folders").join(hits, ["f1", "f2"], "left")
    places = seen.where(F.size("prints") > 0).select("digest", "repo")
    if index is not None:
        places = places.unionByName(index.select(normal_hash(F.col("content_hash")).alias("digest"), F.coalesce("repo", F.lit("")).alias("repo")))
    shared = places.where("digest is not null").distinct().groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COPY_REPOS).select("digest", F.lit(True).alias("elsewhere"))
    judged = join_split_hot(judged, shared, "digest", "left")
    doubtful = F.col("library").isNotNull() & ~F.col("sure")
    sided = judged.where(doubtful).join(_libraries(seen), "library", "left").unionByName(judged.where(~doubtful).withColumn("is_library", F.col("sure")))
    share = F.when(F.size("prints") > 0, F.coalesce("n_copied", F.lit(0)) / F.size("prints")).otherwise(F.lit(0.0))
    copied = (F.size("prints") > 0) & (share >= COPY_SHARE)
    same = F.coalesce("elsewhere", F.lit(False)) & (F.size("prints") > 0)
    folder = F.coalesce("is_library", F.lit(False))
    verdict = (
        F.when(F.col("banner") == "vendored", F.struct(F.lit("vendored").alias("kind"), F.lit("banner").alias("evidence")))
        .when(F.col("shape") != "", F.struct(F.when((F.col("banner") == "generated"), F.lit("generated")).otherwise(F.col("shape")).alias("kind"), F.lit("fingerprints: pattern").alias("evidence")))
        .when(F.col("banner") == "generated", F.struct(F.lit("generated").alias("kind"), F.lit("banner").alias("evidence")))
        .when(copied, F.struct(F.lit("vendored").alias("kind"), F.lit("fingerprints: copies").alias("evidence")))
        .when(same, F.struct(F.lit("vendored").alias("kind"), F.lit("content hash").alias("evidence")))
        .when(folder, F.struct(F.lit("vendored").alias("kind"), F.lit("folder").alias("evidence")))
        .otherwise(F.struct(F.lit("hand-written").alias("kind"), F.lit("").alias("evidence")))
    )
    return sided.withColumn("v", verdict).select("file_path", "repo", "v.kind", "v.evidence", F.round(share, 6).alias("copy_share"), "pattern_share").distinct()
