"""One ranking from several differently scaled scores: weighted Borda count.

Ranks are made without gathering a group: rows are first reduced to distinct (group, criterion, score) with their number,
range-partitioned in that order and ranked inside each partition; what lies in earlier partitions is added as an offset of
at most one row per group and partition. A group of any size, and any number of ties, thus spreads over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.operators.skew import join_split_hot
from codeloom.session import cut_lineage


def running_total(df: DataFrame, group: list[str], order: list[Column], amount: str, name: str) -> DataFrame:
    """``df`` with the sum of ``amount`` over the rows of the same group that come before, in distributed order.

    ``order`` must tell rows of a group apart. No task holds more than a range partition.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut_lineage(df.repartitionByRange(parts, *group, *order).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("_part", *group).agg(F.sum(amount).alias("_sum")).withColumn("_off", F.coalesce(F.sum("_sum").over(across), F.lit(0))).drop("_sum")
    local = placed.withColumn("_in", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    return local.join(sums, ["_part", *group]).withColumn(name, F.col("_in") + F.col("_off")).drop("_part", "_in", "_off")


def borda(scores: DataFrame, weights: dict[str, float] | None = None, group: str = "query_id", item: str = "chunk_id", criterion: str = "criterion", score: str = "score") -> DataFrame:
    """(group, item, n_scores, points, final_rank) for every item of every group.

    Per criterion, items are ranked by descending score; ties share the average of their ranks; ranks are stretched so that
    they span the group's n items, and an item without a score (null or NaN) lies at the middle rank (n + 1) / 2. A rank r
    earns n - r points times the criterion's weight (1 unless given); final_rank orders the sum, ties by ascending item.
    Of repeated scores the greatest counts. Rows with a null group or item are left out; unknown criteria get weight 1.
    """
    rows = scores.where(F.col(group).isNotNull() & F.col(item).isNotNull()).groupBy(group, item, criterion).agg(F.max(F.when(~F.isnan(F.col(score).cast("double")), F.col(score).cast("double"))).alias("_s"))
    rows = cut_lineage(rows)
    sizes = rows.select(group, item).distinct().groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    present = rows.where("_s is not null").withColumn("_key", F.concat_ws("\x00", F.col(group).cast("string"), F.col(criterion).cast("string"), F.col("_s").cast("string")))
    values = present.groupBy(group, criterion, "_s", "_key").agg(F.count(F.lit(1)).alias("_ties"))
    ranked = running_total(values, [group, criterion], [F.col("_s").desc()], "_ties", "_before")
    held = values.groupBy(group, criterion).agg(F.sum("_ties").alias("_m"))
    ranked = join_split_hot(join_split_hot(ranked, held, [group, criterion], "inner"), sizes, group, "inner")
    rank = F.col("_before") + (F.col("_ties") + 1) / 2
    weight = F.lit(1.0)
    for name, w in (weights or {}).items():
        weight = F.when(F.col(criterion) == name, F.lit(float(w))).otherwise(weight)
    # relative to the middle rank, so that a missing score adds nothing
    gain = ranked.select("_key", (weight * F.col("_n") * (F.lit(0.5) - (rank - 0.5) / F.col("_m"))).alias("_gain"))
    total_weight = rows.select(criterion).distinct().agg(F.sum(weight).alias("_w"))
    sums = join_split_hot(present.select(group, item, "_key"), gain, "_key", "inner").groupBy(group, item).agg(F.sum("_gain").alias("_g"), F.count(F.lit(1)).alias("n_scores"))
    every = join_split_hot(rows.select(group, item).distinct().join(sums, [group, item], "left"), sizes, group, "inner").crossJoin(F.broadcast(total_weight))
    points = F.round(F.coalesce("_g", F.lit(0.0)) + F.col("_w") * (F.col("_n") - 1) / 2, 6)
    every = every.select(group, item, F.coalesce("n_scores", F.lit(0)).alias("n_scores"), points.alias("points"), F.lit(1).alias("_one"))
    return running_total(every, [group], [F.col("points").desc(), F.col(item).asc()], "_one", "_before").select(group, item, "n_scores", "points", (F.col("_before") + 1).alias("final_rank"))


def ndcg(ranking: DataFrame, labels: DataFrame, k: int = 10, group: str = "query_id", item: str = "symbol_id") -> DataFrame:
    """(group, ndcg) at ``k`` against graded labels; unlabelled items count as grade 0; groups without a positive grade drop out."""
    gain = lambda g, r: (F.pow(F.lit(2.0), g) - 1) / F.log2(r + 1)
    grades = labels.groupBy(group, item).agg(F.max("grade").alias("grade"))
    got = ranking.where(F.col("final_rank") <= k).join(grades, [group, item]).groupBy(group).agg(F.sum(gain(F.col("grade"), F.col("final_rank"))).alias("dcg"))
    one = running_total(grades.withColumn("_one", F.lit(1)), [group], [F.col("grade").desc(), F.col(item)], "_one", "_before")
    best = one.where(F.col("_before") < k).groupBy(group).agg(F.sum(gain(F.col("grade"), F.col("_before") + 1)).alias("ideal")).where("ideal > 0")
    return best.join(got, group, "left").select(group, F.round(F.coalesce(F.col("dcg"), F.lit(0.0)) / F.col("ideal"), 6).alias("ndcg"))
