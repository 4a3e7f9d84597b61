"""Watching a tree: a poller writes events, a stream debounces them, a handler updates the index.

The poller compares the tree with what it saw last and writes one small JSON file of events per difference, then its new
picture; a poller that dies in between writes the same events again, which an update that compares hashes bears. The stream
reads that folder, so events outlive the process, and the query's own checkpoint tells which were handled.
"""

from __future__ import annotations

import json
import os
import threading
import time
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codeloom.sources.files import UNENTERED, walk_folder
from codeloom.streaming.debounce import EVENT, debounced_stream, watch


class TreePoller:
    """Events of one local tree, for trees of a size that a machine watches (a picture of it is held in memory)."""

    def __init__(self, root: str, folder: str):
        self.root, self.events, self.picture = os.path.abspath(root), os.path.join(folder, "events"), os.path.join(folder, "picture.json")
        os.makedirs(self.events, exist_ok=True)

    def _seen(self) -> dict[str, list]:
        if not os.path.exists(self.picture):
            return {}
        with open(self.picture, encoding="utf-8") as file:
            return json.load(file)

    def poll(self) -> int:
        """Write the events since the last poll; their number. A file that went while an equal one came has moved."""
        was, now = self._seen(), {path: [size, at] for path, size, at in walk_folder(self.root, "", UNENTERED)}
        gone, fresh = set(was) - set(now), set(now) - set(was)
        ts = datetime.now(UTC).isoformat()
        row = lambda kind, path, old=None: {"event_type": kind, "file_path": path, "old_path": old, "ts": ts, "root": self.root}
        rows, by_stat = [], {}
        for path in sorted(gone):
            by_stat.setdefault(tuple(was[path]), []).append(path)
        for path in sorted(fresh):
            same = by_stat.get(tuple(now[path]), [])
            rows.append(row("moved", path, same.pop(0)) if same else row("created", path))
        rows += [row("deleted", path) for paths in by_stat.values() for path in paths]
        rows += [row("modified", path) for path in sorted(set(was) & set(now)) if was[path] != now[path]]
        self._write(rows)
        if rows or not os.path.exists(self.picture):
            _replace(self.picture, json.dumps(now))
        return len(rows)


    def _write(self, rows: list[dict]) -> None:
        if rows:
            _replace(os.path.join(self.events, f"{time.time_ns():020d}.json"), "\n".join(map(json.dumps, rows)) + "\n")

    def tick(self) -> None:
        """An event on no file: it moves the stream's time on, so that a session before it can end."""
        self._write([{"event_type": "tick", "file_path": "", "old_path": None, "ts": datetime.now(UTC).isoformat(), "root": self.root}])


def _replace(path: str, text: str) -> None:
    """Write a file so that others see it whole or not at all; hidden names are passed over by file streams."""
    hidden = os.path.join(os.path.dirname(path), "." + os.path.basename(path))
    with open(hidden, "w", encoding="utf-8") as file:
        file.write(text)
    os.replace(hidden, path)


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Streaming events of a folder of JSON files."""
    return spark.readStream.schema(EVENT).json(folder)


class WatchService:
    """Polls a tree and calls ``update()`` after every quiet session; errors are counted and watching goes on.

    Batches are handled one after the other: what happens during an update waits for the next. ``update`` looks at the tree
    itself, so a batch only says that there is something to do.
    """

    def __init__(self, spark: SparkSession, root: str, folder: str, update: Callable[[], object], gap: float = 2.0, poll_seconds: float = 1.0):
        if not os.path.isdir(root):
            raise ValueError(f"{root} is no folder")
        self.spark, self.folder, self.update, self.gap, self.poll_seconds = spark, folder, update, gap, poll_seconds
        self.poller, self.query, self.thread, self.stopping = TreePoller(root, folder), None, None, threading.Event()
        self.counts, self.waiting, self.last_event = {"events": 0, "updates": 0, "errors": 0}, 0, None
        self.last_error: str | None = None

    def _handle(self, batch: DataFrame, number: int) -> None:
        if batch.where(F.size("changes") > 0).isEmpty():
            return
        self._update()

    def _update(self) -> None:
        self.waiting = 0
        try:
            self.update()
            self.counts["updates"] += 1
        except Exception as error:  # the next session tries again
            self.counts["errors"] += 1
            self.last_error = f"{type(error).__name__}: {error}"

    def _look(self) -> None:
        found = self.poller.poll()
        if found:
            self.counts["events"] += found
            self.waiting += found
            self.last_event = time.monotonic()

    def _poll(self) -> None:
        while not self.stopping.wait(self.poll_seconds):
            try:
                self._look()
                if self.last_event is not None and time.monotonic() - self.last_event > self.gap:
                    self.last_event = None
                    self.poller.tick()
            except OSError as error:
                self.counts["errors"] += 1
                self.last_error = f"{type(error).__name__}: {error}"

    def start(self) -> StreamingQuery:
        """Take the tree as it is for the picture to compare with, and begin watching."""
        if self.query is not None:
            raise RuntimeError("already watching")
        if not os.path.exists(self.poller.picture):
            _replace(self.poller.picture, json.dumps({p: [s, t] for p, s, t in walk_folder(self.poller.root, "", UNENTERED)}))
        self.stopping.clear()
        stream = debounced_stream(event_stream(self.spark, self.poller.events), f"{int(1000 * self.gap)} milliseconds", "0 seconds")
        self.query = watch(stream, self._handle, os.path.join(self.folder, "checkpoint"))
        self.thread = threading.Thread(target=self._poll, daemon=True)
        self.thread.start()
        return self.query

    def stop(self) -> None:
        """End polling, let a running update end, and handle what is left: a session still open counts as ended."""
        if self.query is None:
            return
        self.stopping.set()
        self.thread.join()
        self._look()
        self.query.processAllAvailable()
        self.query.stop()
        self.query = None
        if self.waiting:
            self._update()

    def stats(self) -> dict:
        """Counts of events, updates and errors, the events no update has followed yet, the last error."""
        return {**self.counts, "pending": self.waiting, "last_error": self.last_error, "running": self.query is not None}
