"""Paths as one machine names them, on another: mapped prefixes, for POSIX and Windows paths alike."""

from __future__ import annotations

import os
from dataclasses import dataclass
from pathlib import PurePath, PurePosixPath, PureWindowsPath


@dataclass(frozen=True)
class PathMapping:
    """Paths below ``source`` (as the other machine names it) lie below ``target`` here."""

    source: PurePath
    target: PurePosixPath


def pure_path(text: str) -> PurePath:
    """A Windows path (its parts compare without letter case) if it has a drive or names a share, else a POSIX path."""
    windows = PureWindowsPath(text)
    return windows if windows.drive else PurePosixPath(text.replace("\\", "/"))


def read_mappings(text: str | None) -> list[PathMapping]:
    """``source=target`` pairs separated by semicolons; blank text gives none, a pair without both sides is an error."""
    out = []
    for pair in filter(None, (p.strip() for p in (text or "").split(";"))):
        source, equals, target = (x.strip() for x in pair.partition("="))
        if not (equals and source and target):
            raise ValueError(f"no source=target pair: {pair!r}")
        out.append(PathMapping(pure_path(source), PurePosixPath(target)))
    return out


def map_path(text: str, mappings: list[PathMapping]) -> str | None:
    """The path under the first mapping whose source holds it; None if none does."""
    path = pure_path(text.strip())
    for m in mappings:
        if type(path) is type(m.source) and path.is_relative_to(m.source):
            return str(m.target.joinpath(*path.relative_to(m.source).parts))
    return None


def resolve_runtime_path(text: str, workspace: str | None = None, mappings: list[PathMapping] | None = None) -> str:
    """The path to open here: a relative one below ``workspace``, an absolute one mapped, or as it is if it can be.

    A blank path, and a Windows path that no mapping holds, are errors.
    """
    if not text.strip():
        raise ValueError("an empty path")
    path = pure_path(text.strip())
    if not path.is_absolute():
        return os.path.realpath(os.path.join(workspace or os.getcwd(), str(path)))
    mapped = map_path(text, mappings or [])
    if mapped is None and isinstance(path, PureWindowsPath):
        raise ValueError(f"{text!r} names a place on another machine; give a mapping for it")
    return mapped or str(path)
