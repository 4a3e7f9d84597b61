"""Processing only new or changed records: manifest, anti-join, idempotent batches.

A *manifest* holds one row per time a record was processed. The work list of a run is the listing minus the records the
manifest settles. A batch writes its output under its identifier (a repeated attempt replaces its own output and nothing
else) and appends to the manifest last, so a run that dies in between leaves records unsettled, never half-settled.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.session import cut_lineage


def normal_hash(column: Column) -> Column:
    """Digest in lower case without blanks and a leading ``sha256:``; null stays null and an empty digest becomes null."""
    bare = F.regexp_replace(F.lower(F.trim(column)), "^sha256:", "")
    return F.when(bare != "", bare)


def latest_per_key(manifest: DataFrame, key: str, at: str, value: Column) -> DataFrame:
    """One row (key, seen_at, seen) per key: the value at the greatest ``at``; of rows tied there, the greatest value.

    Partial aggregation on the map side, so a key with any number of rows costs one row per task in the shuffle.
    """
    return (
        manifest.where(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("key"))
        .agg(F.max(F.struct(F.col(at).alias("seen_at"), value.alias("seen"))).alias("last"))
        .select("key", "last.seen_at", "last.seen")
    )


def marker_times(markers: DataFrame, paths: str = "file_paths", at: str = "created_at") -> DataFrame:
    """(key, marked_at): the latest time an unfinished run named each key; broken or empty JSON names none."""
    listed = markers.select(F.explode(F.from_json(F.col(paths), "array<string>")).alias("key"), F.col(at).alias("marked_at"))
    return listed.where(F.col("key").isNotNull()).groupBy("key").agg(F.max("marked_at").alias("marked_at"))


def work_list(listing: DataFrame, manifest: DataFrame, markers: DataFrame | None = None, key: str = "file_path", digest: str = "content_hash", manifest_at: str = "indexed_at", size: str | None = None) -> DataFrame:
    """Distinct (key, digest) of ``listing`` that the next run must take up.

    A record is settled when the newest manifest row of its key has the same digest (and, with ``size``, the same size, where
    both sides know it) and no later marker names the key. Null digests settle nothing; null keys are no records; repeated
    rows count once; extra columns are ignored. An empty manifest settles nothing, an empty listing gives an empty result.
    """
    value = F.struct(normal_hash(F.col(digest)).alias("digest"), (F.col(size) if size else F.lit(None)).cast("bigint").alias("size"))
    latest = latest_per_key(manifest, key, manifest_at, value)
    if markers is not None:
        latest = latest.join(marker_times(markers), "key", "left").where(F.col("marked_at").isNull() | (F.col("marked_at") <= F.col("seen_at")))
    settled = latest.where("seen.digest is not null").select("key", F.col("seen.digest").alias("digest"), F.col("seen.size").alias("_was"))
    present = listing.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), normal_hash(F.col(digest)).alias("digest"), (F.col(size) if size else F.lit(None)).cast("bigint").alias("_is")).distinct()
    same = [present["key"] == settled["key"], present["digest"] == settled["digest"]]
    if size:
        same.append(F.coalesce(present["_is"] == settled["_was"], F.lit(True)))
    return present.join(settled, same, "left_anti").select(F.col("key").alias(key), F.col("digest").alias(digest)).distinct()


class IncrementalRun:
    """Exactly-once batches over a folder.

    ``data/batch_id=…`` holds output, ``manifest/batch_id=…`` what is settled, ``pending/batch_id=…`` the marker of a batch that
    has begun. A run first rolls back what unfinished runs left, then freezes its work list (rows and all) in the shared
    checkpoint folder, so that what is processed, what is settled and the batch identifier come from the same rows whatever
    happens to the listing meanwhile. It writes the marker, the output, and the manifest last; the marker then goes. The batch
    identifier is a function of the work list, so a repeated attempt at the same work replaces the earlier attempt's files.
    Readers trust the manifest only. One run at a time may write to a folder.
    """

    def __init__(self, spark: SparkSession, root: str, key: str = "file_path", digest: str = "content_hash", size: str = "size_bytes"):
        self.spark, self.root, self.key, self.digest, self.size = spark, root.rstrip("/"), key, digest, size

    def _fs(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def _batches(self, kind: str) -> list[str]:
        """Names of the complete folders of a kind (those whose ``_SUCCESS`` file exists)."""
        fs, folder = self._fs(f"{self.root}/{kind}")
        if not fs.exists(folder):
            return []
        names = sorted(x.getPath().getName() for x in fs.listStatus(folder))
        return [n for n in names if fs.exists(self._fs(f"{self.root}/{kind}/{n}/_SUCCESS")[1])]

    def _drop(self, kind: str, name: str) -> None:
        fs, path = self._fs(f"{self.root}/{kind}/{name}")
        fs.delete(path, True)

    def manifest(self, listing: DataFrame) -> DataFrame:
        """Rows of committed batches only; empty, with the right schema, before the first."""
        schema = f"{self.key} {dict(listing.dtypes)[self.key]}, {self.digest} string, {self.size} bigint, indexed_at timestamp, batch_id string"
        done = [f"{self.root}/manifest/{n}" for n in self._batches("manifest")]
        return self.spark.read.schema(schema).parquet(*done) if done else self.spark.createDataFrame([], schema)

    def markers(self) -> list[str]:
        """Identifiers of batches that began and were not finished."""
        return [n.removeprefix("batch_id=") for n in self._batches("pending")]

    def roll_back(self) -> list[str]:
        """Remove the output of unfinished batches, and every left marker; returns the identifiers that were undone.

        A batch whose manifest is complete is finished, and only its marker goes.
        """
        committed, undone = set(self._batches("manifest")), []
        fs, folder = self._fs(f"{self.root}/pending")
        for name in sorted(x.getPath().getName() for x in fs.listStatus(folder)) if fs.exists(folder) else []:
            if name not in committed:
                self._drop("data", name)
                self._drop("manifest", name)
                undone.append(name.removeprefix("batch_id="))
            self._drop("pending", name)
        return undone

    def pending(self, listing: DataFrame) -> DataFrame:
        """Rows of ``listing`` still to be processed, by key, digest and size against the committed manifest."""
        size = self.size if self.size in listing.columns else None
        todo = work_list(listing, self.manifest(listing), key=self.key, digest=self.digest, size=size).select(self.key)
        return listing.join(todo.distinct(), self.key, "left_semi")

    def batch_id_of(self, rows: DataFrame) -> str:
        """Order-free identifier of a set of (key, digest); equal work gives an equal identifier."""
        mark = F.xxhash64(F.col(self.key).cast("string"), normal_hash(F.col(self.digest)))
        one = rows.select(mark.alias("h")).distinct().agg(F.count("h").alias("n"), F.bit_xor("h").alias("x"), F.sum(F.col("h").cast("decimal(38,0)") % 1_000_003).alias("s")).first()
        return hashlib.sha256(f"{one['n']}:{one['x']}:{one['s']}".encode()).hexdigest()[:16]

    def run(self, listing: DataFrame, process) -> str | None:
        """Process what is pending with ``process(rows) -> DataFrame``; returns the batch identifier, None if nothing was."""
        self.roll_back()
        rows = cut_lineage(self.pending(listing))
        if rows.isEmpty():
            return None
        batch = self.batch_id_of(rows)
        name = f"batch_id={batch}"
        begun = self.spark.range(1).select(F.lit(batch).alias("batch"), F.current_timestamp().alias("created_at"))
        begun.write.mode("overwrite").parquet(f"{self.root}/pending/{name}")
        process(rows).write.mode("overwrite").parquet(f"{self.root}/data/{name}")
        size = F.col(self.size).cast("bigint") if self.size in rows.columns else F.lit(None).cast("bigint")
        settled = rows.select(self.key, normal_hash(F.col(self.digest)).alias(self.digest), size.alias(self.size), F.current_timestamp().alias("indexed_at"), F.lit(batch).alias("batch_id")).distinct()
        settled.write.mode("overwrite").parquet(f"{self.root}/manifest/{name}")
        self._drop("pending", name)
        return batch

    def output(self) -> DataFrame | None:
        """Output of committed batches only; what an interrupted run wrote is not seen."""
        done = self._batches("manifest")
        return self.spark.read.parquet(*[f"{self.root}/data/{name}" for name in done]) if done else None
