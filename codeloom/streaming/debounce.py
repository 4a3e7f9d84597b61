"""File events: filtering, debouncing into sessions, merging per path, and handing batches on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENT = "event_type string, file_path string, old_path string, ts timestamp, root string"
TYPES = ("created", "modified", "deleted", "moved")


def accept_events(events: DataFrame, extensions: list[str], ignored: Callable[[Column], Column] | None = None) -> DataFrame:
    """Events on files with a wanted extension that are not ignored; of a move, the side that passes (both, if both do).

    A move whose new path does not pass becomes the deletion of the old one; one whose old path does not, a creation.
    """
    good = lambda c: F.lower(F.regexp_extract(c, r"[^/](\.[^./]+)$", 1)).isin(extensions) & (~ignored(c) if ignored else F.lit(True))
    now, was = F.coalesce(good(F.col("file_path")), F.lit(False)), F.coalesce(good(F.col("old_path")), F.lit(False))
    moved = F.col("event_type") == "moved"
    kept = events.where(F.col("event_type").isin(*TYPES) & (now | (moved & was)))
    return kept.withColumns(
        {
            "event_type": F.when(moved & ~was, "created").when(moved & ~now, "deleted").otherwise(F.col("event_type")),
            "file_path": F.when(moved & ~now, F.col("old_path")).otherwise(F.col("file_path")),
            "old_path": F.when(moved & now & was, F.col("old_path")),
        }
    )


def split_moves(events: DataFrame) -> DataFrame:
    """(…, file_path, event, step): a move as the deletion of its old path, if it has one, and the creation of its new one."""
    one = lambda path, event, step: F.struct(path.alias("path"), F.lit(event).alias("event"), F.lit(step).alias("step"))
    moves = F.when(F.col("old_path").isNotNull(), F.array(one(F.col("old_path"), "deleted", 0), one(F.col("file_path"), "created", 1))).otherwise(F.array(one(F.col("file_path"), "created", 1)))
    plain = F.array(F.struct(F.col("file_path").alias("path"), F.col("event_type").alias("event"), F.lit(0).alias("step")))
    parts = F.explode(F.when(F.col("event_type") == "moved", moves).otherwise(plain)).alias("_e")
    return events.select("*", parts).withColumns({"file_path": F.col("_e.path"), "event": F.col("_e.event"), "step": F.col("_e.step")}).drop("_e", "old_path", "event_type")


def merged_state(ordered: Column) -> Column:
    """Final state of one path from its events in order: created, modified, deleted, or null if nothing is left to do.

    A creation after a deletion is a modification, after nothing a creation, else it changes nothing; a modification keeps a
    creation and is otherwise a modification; a deletion undoes a creation and is otherwise a deletion.
    """

    def step(state: Column, e: Column) -> Column:
        return (
            F.when(e == "created", F.when(state == "deleted", F.lit("modified")).when(state == "", F.lit("created")).otherwise(state))
            .when(e == "modified", F.when(state == "created", state).otherwise(F.lit("modified")))
            .when(e == "deleted", F.when(state == "created", F.lit("")).otherwise(F.lit("deleted")))
            .otherwise(state)
        )

    return F.aggregate(ordered, F.lit(""), step, lambda s: F.when(s != "", s))


def sessions(events: DataFrame, gap: str = "2 seconds") -> DataFrame:
    """``events`` of a batch with session_start and session_end: a session ends when a watch root is quiet for ``gap``."""
    quiet = events.groupBy("root", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n_events"))
    return quiet.select("root", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events")


def merge_events(events: DataFrame, group: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """(group…, file_path, state) of the paths that need work, from events with ts and, as tie-break, ``order`` columns.

    Only the events of one path in one batch are gathered, which a debounced batch bounds.
    """
    keys = [*(group or []), "file_path"]
    parts = split_moves(events)
    stamp = F.struct(F.col("ts"), *[F.col(c) for c in (order or [])], F.col("step"), F.col("event"))
    merged = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(stamp)).alias("_l"))
    return merged.select(*keys, merged_state(F.transform("_l", lambda e: e["event"])).alias("state")).where("state is not null")


def debounced_stream(events: DataFrame, gap: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """Streaming sessions with the merged state of every path: one row (root, session_start, session_end, changes) a session.

    Per root and session the events form one list; a session ends by a quiet gap, and its list is what one update handles.
    """
    parts = split_moves(events.withWatermark("ts", late))
    item = F.struct("ts", "step", "file_path", "event")
    batch = parts.groupBy("root", F.session_window("ts", gap).alias("w")).agg(F.array_sort(F.collect_list(item)).alias("l"))
    paths = F.array_distinct(F.transform("l", lambda e: e["file_path"]))
    change = lambda p: F.struct(p.alias("file_path"), merged_state(F.transform(F.filter("l", lambda e: e["file_path"] == p), lambda e: e["event"])).alias("state"))
    changes = F.filter(F.transform(paths, change), lambda c: c["state"].isNotNull())
    return batch.select("root", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), changes.alias("changes"))


def watch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Start handing batches of the stream to ``handle``, one after the other; ``once`` takes what is there and ends.

    A batch that fails is counted in the log table of the query's exception and stops the query, which a restart takes up at
    that batch, so handlers must be idempotent by batch number (see ``IncrementalRun``).
    """
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()
