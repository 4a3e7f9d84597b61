"""Equi-joins that survive a hot key on the left side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hot_keys(df: DataFrame, key: str, share: float = 0.01, least: int = 10_000) -> list:
    """Keys that hold more than ``share`` of the rows (and more than ``least`` rows).

    The count is combined on the map side; at most ``1 / share`` keys can qualify, so the driver receives a
    list of bounded length whatever the input. Null keys never qualify (they match nothing in an equi-join).
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    top = counts.crossJoin(F.broadcast(total)).where((F.col("n") > share * F.col("total")) & (F.col("n") > least))
    return [row[0] for row in top.select(key).collect()]


def join_split_hot(left: DataFrame, right: DataFrame, key: str | list[str], how: str = "left", share: float = 0.01, least: int = 10_000) -> DataFrame:
    """``left.join(right, key, how)`` for how in left, inner, left_semi, left_anti, with ``right`` unique in ``key``.

    Rows with a hot key meet a broadcast of at most ``1 / share`` right rows and are not shuffled; all other rows take the
    ordinary shuffle join. Ties, null keys and repeated left rows behave as in the plain join. Several key columns are told
    apart by their hash. A key of at most ``least`` rows is never hot: one task joins that many without strain.
    """
    mark = (lambda: F.xxhash64(*key)) if isinstance(key, list) else (lambda: F.col(key))
    hot = hot_keys(left.select(mark().alias("key")), "key", share, least)
    if not hot:
        return left.join(right, key, how)
    is_hot = F.coalesce(mark().isin(hot), F.lit(False))
    few = right.where(mark().isin(hot))
    return left.where(is_hot).join(F.broadcast(few), key, how).unionByName(left.where(~is_hot).join(right, key, how))
