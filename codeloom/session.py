"""Session, table and lineage helpers shared by every operator."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor, wait
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "codeloom", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("CODELOOM_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder of ``spark.checkpoint.dir`` and forget how it was made.

    The cluster names that folder; a private temporary one is set only where nothing is set (tests, local runs).
    The files outlive a lost executor, unlike those of a local checkpoint.
    """
    spark = df.sparkSession
    with _SETTING:
        _set_checkpoint_folder(spark)
    return df.checkpoint(eager=True)


_SETTING = threading.Lock()


def _set_checkpoint_folder(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="codeloom-checkpoint-")
        context.setCheckpointDir(named)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the jobs run inside; the ones before are restored."""
    before = {name: spark.conf.get(name, None) for name in values}
    try:
        for name, value in values.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def within_time(spark: SparkSession, tasks: dict[str, Callable[[], DataFrame]], seconds: float | None = None) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """(results, left out by reason) of small result lists, made and materialised at once in one thread each.

    A task that raises is left out with its error; one that is not done after ``seconds`` is left out and its jobs are
    cancelled. Results are cut from their lineage, so a later read cannot fail on what a task did.
    """
    context, run = spark.sparkContext, uuid.uuid4().hex
    pool = ThreadPoolExecutor(max(1, len(tasks)))

    def work(name: str) -> DataFrame:
        context.setJobGroup(f"{run}-{name}", name, interruptOnCancel=True)
        return cut_lineage(tasks[name]())

    futures = {name: pool.submit(work, name) for name in tasks}
    wait(futures.values(), timeout=seconds)
    done, left_out = {}, {}
    for name, future in futures.items():
        if not future.done():
            context.cancelJobGroup(f"{run}-{name}")
            left_out[name] = "out of time"
        elif future.exception() is not None:
            left_out[name] = f"{type(future.exception()).__name__}: {future.exception()}"
        else:
            done[name] = future.result()
    pool.shutdown(wait=False, cancel_futures=True)
    return done, left_out


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the session's Python workers, wherever they run; once per session.

    The sources travel as one small archive through Spark's own file distribution, so executors need no copy of the
    repository and no common path.
    """
    context = spark.sparkContext
    if getattr(context, "_codeloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="codeloom-package-")
    archive = os.path.join(folder, "codeloom.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, os.path.join("codeloom", path.relative_to(root)))
    context.addPyFile(archive)
    context._codeloom_shipped = True


def ship_file(spark: SparkSession, path: str) -> None:
    """Send a small file of the driver (a vocabulary) to all workers, once; see ``shipped``."""
    context = spark.sparkContext
    sent = getattr(context, "_codeloom_files", set())
    if path not in sent and os.path.isfile(path):
        context.addFile(path)
        context._codeloom_files = sent | {path}


def shipped(path: str) -> str:
    """Where a worker finds that file: its own copy, else the path itself (a folder that all machines mount)."""
    from pyspark import SparkFiles

    own = SparkFiles.get(os.path.basename(path))
    return own if os.path.isfile(own) else path
