"""Source trees as DataFrames.

Folders are walked, and files read, on the workers: Spark's own file listing hides names that begin with ``_`` or ``.``, so
that ``__init__.py`` would be lost, and it follows symbolic links wherever they lead.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.languages import EXTENSIONS, detect_language, extension_of
from codeloom.functions.text import line_count
from codeloom.sources.ignore import is_denied, is_ignored, is_system_folder, rules_of

#: Larger files are skipped.
MAX_BYTES = 10 * 1024 * 1024
#: Bytes of sources that one reading task takes.
TASK_BYTES = 64 * 1024 * 1024
#: Folders that the default rules ignore and that are not even entered where those rules hold.
UNENTERED = ("node_modules", "venv", ".venv", "__pycache__", ".git")

_LISTED = "file_path string, size_bytes bigint, modified_time double"


def link_target(path: str, top: str) -> str | None:
    """Real path of a symbolic link whose target exists and lies inside ``top`` (a real path); None for any other link."""
    target = os.path.realpath(path)
    return target if os.path.exists(target) and target.startswith(top + os.sep) else None


def walk_folder(root: str, start: str = "", skipped: tuple[str, ...] = ()) -> Iterator[tuple[str, int, float]]:
    """(path relative to ``root``, bytes, modification time) of the regular files below ``root``/``start``, in order of path.

    A link is followed only if its target exists, lies inside the root and is none of the folders that lead to it, so that
    nothing outside is read and every cycle ends. Unreadable folders are passed over.
    """
    top = os.path.realpath(root)
    waiting = [(start, (top, os.path.realpath(os.path.join(root, start))))]
    while waiting:
        folder, above = waiting.pop()
        try:
            entries = sorted(os.scandir(os.path.join(root, folder)), key=lambda e: e.name)
        except OSError:
            continue
        inner = []
        for entry in entries:
            path = os.path.join(folder, entry.name)
            real = link_target(entry.path, top) if entry.is_symlink() else os.path.realpath(entry.path)
            if real is None:
                continue
            if os.path.isdir(real):
                if real not in above and entry.name not in skipped:
                    inner.append((path, (*above, real)))
            elif os.path.isfile(real):
                stat = os.stat(real)
                yield path, stat.st_size, round(stat.st_mtime, 3)
        waiting += reversed(inner)


def _remote(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root)


def list_tree(spark: SparkSession, root: str, skipped: tuple[str, ...] = UNENTERED) -> DataFrame:
    """(file_path, size_bytes, modified_time) of every file under ``root``: a mounted folder or the URI of an object store or HDFS that Arrow can open.

    The folders right below the root are shared out and walked by the workers; only their names pass through the driver.
    """
    if "://" in root:
        from pyarrow import fs

        source, base = _remote(root)
        first = source.get_file_info(fs.FileSelector(base))
        rows = [(os.path.relpath(i.path, base), i.is_file) for i in first if i.base_name not in skipped or i.is_file]
    else:
        top = os.path.realpath(root)
        rows = [(e.name, not e.is_dir()) for e in os.scandir(root) if e.name not in skipped and (not e.is_symlink() or link_target(e.path, top))]
    if not rows:
        return spark.createDataFrame([], _LISTED)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["file_path", "size_bytes", "modified_time"]
        for batch in batches:
            for name, is_file in batch.itertuples(index=False, name=None):
                if "://" in root:
                    source, base = _remote(root)
                    where = f"{base}/{name}"
                    infos = [source.get_file_info(where)] if is_file else source.get_file_info(fs.FileSelector(where, recursive=True))
                    found = ((os.path.relpath(i.path, base), i.size, round(i.mtime.timestamp(), 3)) for i in infos if i.is_file and not set(os.path.relpath(i.path, base).split("/")[:-1]) & set(skipped))
                elif is_file:
                    stat = os.stat(os.path.join(root, name))
                    found = [(name, stat.st_size, round(stat.st_mtime, 3))]
                else:
                    found = walk_folder(root, name, skipped)
                part = []
                for row in found:
                    part.append(row)
                    if len(part) == 10_000:
                        yield pd.DataFrame(part, columns=columns)
                        part = []
                if part:
                    yield pd.DataFrame(part, columns=columns)

    names = spark.createDataFrame(sorted(rows), "name string, is_file boolean")
    return names.repartition(min(len(rows), 200)).mapInPandas(walk, _LISTED)


def _read(root: str):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source, base = _remote(root) if "://" in root else (None, root)
        for batch in batches:
            contents: list[bytes | None] = []
            used = first = 0
            for at, path in enumerate(batch["file_path"]):
                try:
                    with source.open_input_stream(f"{base}/{path}") if source else open(os.path.join(base, path), "rb") as file:
                        contents.append(file.read())
                except OSError:  # gone since it was listed
                    contents.append(None)
                used += len(contents[-1] or b"")
                if used > MAX_BYTES:
                    yield batch.iloc[first : at + 1].assign(data=contents)
                    contents, used, first = [], 0, at + 1
            if contents:
                yield batch.iloc[first:].assign(data=contents)

    return read


def ignore_files(listing: DataFrame, root: str) -> dict[str, str]:
    """Texts of the ignore files of a listing by folder; as many as the tree has, each a few lines."""
    own = listing.where((F.col("file_path") == ".gitignore") | F.col("file_path").endswith("/.gitignore"))
    return {os.path.dirname(r["file_path"]): bytes(r["data"] or b"").decode("utf-8", "replace") for r in own.mapInPandas(_read(root), _LISTED + ", data binary").collect()}


def scan_tree(spark: SparkSession, root: str, extensions: list[str] | None = None, ignore: dict[str, str] | None = None, defaults: bool = True) -> DataFrame:
    """(file_path, content, language, size_bytes, modified_time, content_hash, line_count), paths relative to ``root``.

    Skipped are denied names, ignored paths, other extensions than wanted, files beyond ``MAX_BYTES``, contents that hold a NUL
    in their first 8 KiB or are no UTF-8, and what links reach outside the root. The listing is filtered by path and size
    before a file is opened, and spread so that a task reads about ``TASK_BYTES``.
    """
    if is_system_folder(root.removeprefix("file://")):
        raise ValueError(f"{root} is a system folder")
    root = root.removeprefix("file://").rstrip("/")
    listing = list_tree(spark, root, UNENTERED if defaults else ())
    if ignore is None:
        ignore = ignore_files(listing, root)
    wanted = [e.lower() for e in (extensions or EXTENSIONS)]
    listed = listing.where((F.col("size_bytes") <= MAX_BYTES) & extension_of(F.col("file_path")).isin(wanted))
    listed = listed.where(~is_denied(F.col("file_path")) & ~is_ignored(F.col("file_path"), rules_of(ignore, defaults)))
    total = listed.agg(F.coalesce(F.sum("size_bytes"), F.lit(0))).first()[0]
    parts = max(spark.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    raw = listed.repartition(parts, F.xxhash64("file_path")).mapInPandas(_read(root), _LISTED + ", data binary").where("data is not null")
    text = raw.where(~F.contains(F.substring("data", 1, 8192), F.lit(b"\x00")) & F.is_valid_utf8(F.col("data").cast("string")))
    return text.select(
        "file_path",
        F.col("data").cast("string").alias("content"),
        detect_language(F.col("file_path")).alias("language"),
        "size_bytes",
        "modified_time",
        F.sha2("data", 256).alias("content_hash"),
    ).withColumn("line_count", line_count(F.col("content")))
