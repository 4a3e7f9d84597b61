"""Tables kept in a folder: replace-by-key, deletes, counts, ages; the metadata of an index and its registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def latest_by(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the last in ``order``. Combined on the map side (a maximum of structs), never a sorted group."""
    stamp = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], *[F.col(c) for c in rows.columns])
    return rows.groupBy(*keys).agg(F.max(stamp).alias("_last")).select("_last.*").select(*rows.columns)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of equal key; of several new rows with one key the last counts."""
    fresh = latest_by(new, keys, order or [F.monotonically_increasing_id()]) if order else new.dropDuplicates(keys)
    return old.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh, allowMissingColumns=True)


def upsert_repositories(old: DataFrame, new: DataFrame) -> DataFrame:
    """Replace by index_id, but keep created_at, and the collection where the new one is null."""
    was = old.select("index_id", F.col("created_at").alias("_c"), F.col("collection_name").alias("_n"))
    merged = new.join(was, "index_id", "left").withColumns({"created_at": F.coalesce("_c", "created_at"), "collection_name": F.coalesce("collection_name", "_n")}).drop("_c", "_n")
    return upsert(old, merged, ["index_id"])


def delete_keys(table: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return table.join(keys.select(*on).distinct(), on, "left_anti")


def diff_files(scan: DataFrame, stored: DataFrame) -> DataFrame:
    """(file_path, state): new, modified, deleted or same, by one full join of scan and stored hashes."""
    a = scan.select("file_path", F.col("content_hash").alias("_now"), F.lit(True).alias("_in"))
    b = stored.select("file_path", F.col("content_hash").alias("_was"), F.lit(True).alias("_had"))
    state = F.when(F.col("_had").isNull(), "new").when(F.col("_in").isNull(), "deleted").when(F.col("_now").eqNullSafe(F.col("_was")), "same").otherwise("modified")
    return a.join(b, "file_path", "full").select("file_path", state.alias("state"))


def file_stats(files: DataFrame) -> DataFrame:
    """One row: n_files, n_chunks, n_lines; sums of nothing are 0."""
    return files.agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("n_chunks"), F.coalesce(F.sum("line_count"), F.lit(0)).alias("n_lines"))


def combined_stats(files: DataFrame) -> DataFrame:
    """One row: the counts of ``file_stats`` and a map of files per language."""
    languages = language_counts(files).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("language", "n_files")))).alias("languages"))
    return file_stats(files).crossJoin(F.broadcast(languages))


def language_counts(files: DataFrame) -> DataFrame:
    return files.groupBy(F.lower(F.coalesce("language", F.lit("unknown"))).alias("language")).agg(F.count(F.lit(1)).alias("n_files"))


def stale_files(files: DataFrame, limit: int | None = None) -> DataFrame:
    """(file_path, stale_seconds) of files changed after they were indexed, most stale first, ties by path."""
    age = F.col("modified_time") - F.unix_micros(F.col("indexed_at").cast("timestamp")) / F.lit(1e6)
    out = files.select("file_path", F.round(age, 3).alias("stale_seconds")).where("stale_seconds > 0").orderBy(F.col("stale_seconds").desc(), "file_path")
    return out.limit(limit) if limit else out


def staleness_summary(files: DataFrame, top: int = 5) -> DataFrame:
    """One row: number of stale files and the ``top`` most stale with their hours (2 digits)."""
    stale = stale_files(files)
    worst = stale.limit(top).select(F.concat_ws("=", "file_path", F.round(F.col("stale_seconds") / 3600, 2)).alias("entry"), "stale_seconds")
    listed = worst.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("stale_seconds")).alias("s"), "entry"))), lambda e: e["entry"]), "; ").alias("most_stale"))
    return stale.agg(F.count(F.lit(1)).alias("n_stale")).crossJoin(listed)


def older_than(files: DataFrame, cutoff: Column) -> DataFrame:
    return files.where(F.col("indexed_at") < cutoff)


def under_root(files: DataFrame, root: str) -> DataFrame:
    """Rows whose path lies under ``root`` (a prefix, no wildcards)."""
    return files.where(F.col("file_path").startswith(root.rstrip("/") + "/"))


def nearest_root(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """(file_path, root_path): the longest root that is the path or a folder above it; paths without one drop out.

    An equi-join on the path's own ancestors (one row per folder), not a prefix comparison with every root.
    """
    parts = F.split("file_path", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    up = paths.select("file_path").distinct().select("file_path", F.explode(ancestors).alias("root_path"))
    return up.join(roots.select("root_path").distinct(), "root_path").groupBy("file_path").agg(F.max_by("root_path", F.length("root_path")).alias("root_path"))


def rows_of(table: DataFrame, column: str, values: list) -> DataFrame:
    """Point look-up: the rows whose ``column`` is one of a few values; the scan takes the equality."""
    return table.where(F.col(column).isin(values)) if len(values) != 1 else table.where(F.col(column) == values[0])


def symbols_in_file(symbols: DataFrame, edges: DataFrame, path: str) -> DataFrame:
    """Symbols of one file in order of line, each with the references to it as an array of (file_path, line)."""
    own = rows_of(symbols, "file_path", [path]).select("fqn", "start_line", "end_line", "symbol_type").distinct()
    seen = edges.select(F.trim("target_id").alias("fqn"), F.struct("file_path", "line").alias("_r")).join(own.select("fqn").distinct(), "fqn", "left_semi")
    refs = seen.groupBy("fqn").agg(F.array_sort(F.collect_set("_r")).alias("references"))
    none = F.array().cast("array<struct<file_path:string,line:int>>")
    return own.join(refs, "fqn", "left").withColumn("references", F.coalesce("references", none)).orderBy("start_line", "fqn")


def merge_pending(first: DataFrame, second: DataFrame, path: str = "file_path") -> DataFrame:
    """Paths of either of two waiting batches, each once: what a later update has to look at."""
    return first.select(path).unionByName(second.select(path)).where(F.col(path).isNotNull()).distinct()


def symbols_by_name(symbols: DataFrame, name: str) -> DataFrame:
    """Symbols whose fqn is the name or ends in ``.name``; letter case and underscores are literal."""
    return symbols.where((F.col("fqn") == name) | F.col("fqn").endswith("." + name))


class FolderStore:
    """Named Parquet tables under one folder, each in independent parts (such as one per collection).

    A write makes a new numbered version of one part; a version counts once Spark has written its ``_SUCCESS`` file, so that
    readers see the old rows or the new ones, never a mixture or a gap, and a failed write changes nothing. The version before
    the newest is kept until the next write, for readers that hold a plan over it. One writer at a time per part.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return sorted(x.getPath().getName() for x in fs.listStatus(p) if x.isDirectory()) if fs.exists(p) else []

    def _current(self, name: str, part: str) -> str | None:
        folder = f"{self.root}/{name}/{part}"
        for version in reversed(self._names(folder)):
            fs, done = self._fs(f"{folder}/{version}/_SUCCESS")
            if fs.exists(done):
                return version
        return None

    def parts(self, name: str) -> list[str]:
        return [p for p in self._names(f"{self.root}/{name}") if self._current(name, p)]

    def exists(self, name: str, part: str | None = None) -> bool:
        return self._current(name, part) is not None if part else bool(self.parts(name))

    def read(self, name: str, part: str | None = None) -> DataFrame:
        """All parts, or one; columns that a part lacks are null there."""
        chosen = [part] if part else self.parts(name)
        paths = [f"{self.root}/{name}/{p}/{v}" for p in chosen if (v := self._current(name, p))]
        if not paths:
            raise FileNotFoundError(f"{self.root}/{name}" + (f"/{part}" if part else ""))
        return self.spark.read.option("mergeSchema", len(paths) > 1).parquet(*paths)

    def write(self, name: str, rows: DataFrame, part: str = "all") -> None:
        folder = f"{self.root}/{name}/{part}"
        versions, current = self._names(folder), self._current(name, part)
        number = max((int(v[1:]) for v in versions), default=0) + 1
        rows.write.parquet(f"{folder}/v{number:012d}")
        for old in versions:
            if old != current:
                fs, p = self._fs(f"{folder}/{old}")
                fs.delete(p, True)

    def upsert(self, name: str, rows: DataFrame, keys: list[str], part: str = "all") -> None:
        self.write(name, upsert(self.read(name, part), rows, keys) if self.exists(name, part) else rows.dropDuplicates(keys), part)

    def drop(self, name: str, part: str | None = None) -> None:
        fs, p = self._fs(f"{self.root}/{name}" + (f"/{part}" if part else ""))
        fs.delete(p, True)

    # markers of batches that have begun: one part of the table ``pending`` each

    def begin(self, batch: str, rows: DataFrame) -> None:
        """Leave a marker that names the files (and, where given, the chunks) of ``rows`` until ``finish`` removes it."""
        chunk = F.col("chunk_id") if "chunk_id" in rows.columns else F.lit(None).cast("string")
        self.write("pending", rows.select(F.lit(batch).alias("batch_id"), "file_path", chunk.alias("chunk_id"), F.current_timestamp().alias("created_at")), batch)

    def finish(self, batch: str) -> None:
        self.drop("pending", batch)

    def unfinished(self) -> DataFrame:
        """(batch_id, file_path, chunk_id, created_at) of all markers; empty without any."""
        if self.exists("pending"):
            return self.read("pending")
        return self.spark.createDataFrame([], "batch_id string, file_path string, chunk_id string, created_at timestamp")


def pending_batches(markers: DataFrame) -> DataFrame:
    """Markers oldest first, their JSON lists as arrays."""
    lists = {c: F.from_json(c, "array<string>") for c in ("file_paths", "chunk_ids")}
    return markers.withColumns(lists).orderBy("created_at", "batch_id")


def roll_back(files: DataFrame, markers: DataFrame) -> DataFrame:
    """File metadata without the files that unfinished batches name, so that the next run takes them up again."""
    named = markers.select(F.explode(F.from_json("file_paths", "array<string>")).alias("file_path"))
    return delete_keys(files, named, ["file_path"])


def rank_rows(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Rows of a bounded result numbered from 1."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
