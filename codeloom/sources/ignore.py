"""Ignore rules and denied names of a source tree, compiled on the driver and applied to path columns."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom.functions.text import glob_regex

# Names never read, whatever the rules say.
DENIED = """
.ssh .gnupg id_rsa id_rsa.pub id_ed25519 id_ed25519.pub id_ecdsa id_ecdsa.pub id_dsa id_dsa.pub
*.pem *.key *.p12 *.pfx *.crt *.keystore .env .env.* .env.local .env.production .env.development .netrc .npmrc .pypirc
""".split()
# Rules that hold before those of the tree.
DEFAULT_RULES = ".* $* __pycache__ *.pyc *.egg-info .venv venv .tox .pytest_cache .uv_cache .ruff_cache .hypothesis node_modules dist build".split()
# Folders of an operating system that are not indexed.
SYSTEM_ROOTS = "/bin /boot /dev /etc /lib /lib64 /proc /root /sbin /sys /usr /var".split()


@dataclass(frozen=True)
class Rule:
    """One ignore rule: a Java regular expression on root-relative paths, whether it re-includes, whether it needs a folder."""

    raw: str
    regex: str
    negated: bool
    folder: bool


def _segment_regex(glob: str) -> str:
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        i += 1
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[":
            end = glob.find("]", i + 1)
            body = glob[i:end]
            out.append("[" + ("^" + body[1:] if body.startswith(("!", "^")) else body).replace("\\", "\\\\") + "]")
            i = end + 1
        elif c == "\\" and i < len(glob):
            out.append(re.sub(r"([^\w\s/])", r"\\\1", glob[i]))
            i += 1
        else:
            out.append(re.sub(r"([^\w\s/])", r"\\\1", c))
    return "".join(out)


def parse_rule(line: str, folder: str = "") -> Rule | None:
    """The rule of one line in the ignore file of ``folder`` (relative to the root); None for blanks, comments, broken lines.

    ``!`` re-includes, a trailing slash wants a folder, a leading one ties the pattern to the file's own folder; a pattern
    with a slash inside is relative to it, one without matches at any depth below it; ``**`` spans folders.
    """
    text = line.rstrip("\n").rstrip()
    if not text or text.startswith("#") or text.endswith("\\") or text.count("[") != text.count("]"):
        return None
    negated = text.startswith("!")
    body = text[1:] if negated else text
    wants_folder = body.endswith("/")
    body = body.rstrip("/")
    tied = body.startswith("/")
    body = body.lstrip("/")
    if not body:
        return None
    base = _segment_regex(folder.strip("/")) + "/" if folder.strip("/") else ""
    parts = []
    segments = body.split("/")
    for k, segment in enumerate(segments):
        last = k == len(segments) - 1
        if segment == "**":
            parts.append(".*" if last else "(?:.*/)?")
        else:
            parts.append(_segment_regex(segment) + ("" if last else "/"))
    inner = "".join(parts)
    depth = "" if tied or "/" in body else "(?:.*/)?"
    return Rule(text, f"^{base}{depth}{inner}", negated, wants_folder)


def rules_of(files: dict[str, str], defaults: bool = True) -> list[Rule]:
    """Rules in order: the defaults, then each ignore file (folder: text), shallow folders first. The last match wins."""
    out = [parse_rule(r) for r in DEFAULT_RULES] if defaults else []
    for folder in sorted(files, key=lambda f: (f.strip("/").count("/") + bool(f.strip("/")), f)):
        out += [parse_rule(line, folder) for line in files[folder].split("\n")]
    return [r for r in out if r]


def rule_counts(files: dict[str, str], defaults: bool = True) -> dict[str, int]:
    """Number of rules that count, by the folder of their ignore file (the defaults under their own name)."""
    own = {folder or ".": len(rules_of({folder: text}, False)) for folder, text in files.items()}
    return {"defaults": len(rules_of({}, True)), **own} if defaults else own


def is_ignored(path: Column, rules: list[Rule]) -> Column:
    """Whether the last rule that matches the path, or one of the folders above it, ignores it.

    As in a walk of the tree, a folder that is ignored takes everything below it along, even what a later rule re-includes.
    """
    parts = F.split(path, "/")
    ways = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, 1, n), "/").alias("p"), (n < F.size(parts)).alias("d")))

    def verdict(way: Column) -> Column:
        out = F.lit(False)
        for rule in rules:
            hit = way["p"].rlike(rule.regex + "$")
            out = F.when(hit & way["d"] if rule.folder else hit, F.lit(not rule.negated)).otherwise(out)
        return out

    return F.exists(ways, verdict)


def is_denied(path: Column, names: list[str] = DENIED) -> Column:
    """Whether a component of the path has a denied name."""
    exact = [n for n in names if "*" not in n]
    globs = [glob_regex(n) for n in names if "*" in n]

    def verdict(part: Column) -> Column:
        out = part.isin(exact)
        for g in globs:
            out = out | part.rlike(g)
        return out

    return F.exists(F.split(path, "/"), verdict)


def is_system_folder(path: str) -> bool:
    clean = "/" + path.strip("/")
    return clean == "/" or any(clean == r or clean.startswith(r + "/") for r in SYSTEM_ROOTS)
