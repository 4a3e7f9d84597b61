"""Retrieval quality and run metrics."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def recall_at(results: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (5, 10, 20), query: str = "query_id", item: str = "item_id") -> DataFrame:
    """(query, recall_at_K for each K): share of a query's relevant items among its first K; queries without any drop out."""
    truth = relevant.select(query, item).distinct()
    sizes = truth.groupBy(query).agg(F.count(F.lit(1)).alias("_all"))
    best = results.groupBy(query, item).agg(F.min("rank").alias("_rank")).join(truth, [query, item])
    counts = best.groupBy(query).agg(*[F.count_if(F.col("_rank") <= k).alias(f"_{k}") for k in ks])
    return sizes.join(counts, query, "left").select(query, *[F.round(F.coalesce(F.col(f"_{k}"), F.lit(0)) / F.col("_all"), 6).alias(f"recall_at_{k}") for k in ks])


def reciprocal_ranks(results: DataFrame, relevant: DataFrame, query: str = "query_id", item: str = "item_id") -> DataFrame:
    """(query, rr): one over the rank of the first relevant item, 0 without one."""
    truth = relevant.select(query, item).distinct()
    first = results.join(truth, [query, item], "left_semi").groupBy(query).agg(F.min("rank").alias("_rank"))
    return truth.select(query).distinct().join(first, query, "left").select(query, F.round(F.coalesce(1 / F.col("_rank"), F.lit(0.0)), 6).alias("rr"))


def latency_summary(samples: DataFrame, value: str, kind: str | None = None) -> DataFrame:
    """count, mean, p50 and p95 (linear between neighbours), per ``kind`` if given; nothing gives zeros only without a kind."""
    p = lambda q: F.round(F.coalesce(F.percentile(F.col(value), F.lit(q)), F.lit(0.0)), 6)
    wanted = [F.count(value).alias("n"), F.round(F.coalesce(F.avg(value), F.lit(0.0)), 6).alias("mean"), p(0.5).alias("p50"), p(0.95).alias("p95")]
    return samples.groupBy(kind).agg(*wanted) if kind else samples.agg(*wanted)


def last_samples(samples: DataFrame, at: str, keep: int = 1000, key: str | None = None) -> DataFrame:
    """The ``keep`` newest samples in all, ties by ``key``."""
    return samples.orderBy(F.col(at).desc(), *([F.col(key)] if key else [])).limit(keep)


def count_by(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def failures(results: DataFrame, shown: int = 10) -> DataFrame:
    """One row: number of files, of failed ones, the first ``shown`` failed paths and how many more there are."""
    failed = results.where(F.col("error").isNotNull()).select("file_path").distinct()
    first = failed.orderBy("file_path").limit(shown).agg(F.array_join(F.array_sort(F.collect_list("file_path")), ", ").alias("first_failed"))
    totals = results.agg(F.count_distinct("file_path").alias("n_files"), F.count_distinct(F.when(F.col("error").isNotNull(), F.col("file_path"))).alias("n_failed"))
    return totals.crossJoin(first).withColumn("n_more", F.greatest(F.lit(0), F.col("n_failed") - shown))


def rank_within(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """Rank from 1 inside each result list (lists of a search are short by their limit)."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)))


class Samples:
    """A run's measurements: appended one by one, written as rows (kind, value, at); what is asked of them is a query."""

    def __init__(self):
        self._rows: list[tuple] = []

    def record(self, kind: str, value: float) -> None:
        self._rows.append((kind, float(value), datetime.now(UTC).replace(tzinfo=None)))

    @contextmanager
    def timed(self, kind: str) -> Iterator[None]:
        """Record the milliseconds that the body takes, whether it ends well or not."""
        began = time.perf_counter()
        try:
            yield
        finally:
            self.record(kind, 1000 * (time.perf_counter() - began))

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self._rows, "kind string, value double, at timestamp")

    def reset(self) -> None:
        self._rows.clear()
