"""The N best items of every group, with a consistent tie rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquetry.operators.lineage import materialise


def top_n(df: DataFrame, group: str, item: str, score: Column, n: int) -> DataFrame:
    """(``group``, ``item``, score, rank) of the ``n`` items with the highest score in each group; equal scores go to the smaller item.

    An item counts once per group, with its best score. Rows with a null or NaN score, a null group or a null item do not count; a group
    with fewer usable items gives them all; ``n`` below 1 and empty tables give nothing.

    A rank filter over distinct (score, item) pairs comes first: Spark's group limit applies it within each input partition before
    the shuffle and again after it, so a group of any size moves at most ``n`` distinct pairs per partition. Items that repeat with
    other scores can use up ranks; the groups where that leaves fewer than ``n`` items though more exist are redone from all their rows,
    reduced to one row per item by a hash aggregation first.
    """
    usable = df.select(F.col(group).alias("g"), F.col(item).alias("i"), score.cast("double").alias("s")).where(F.col("g").isNotNull() & F.col("i").isNotNull() & F.col("s").isNotNull() & ~F.isnan("s"))
    best_first = Window.partitionBy("g").orderBy(F.desc("s"), "i")
    pairs = usable.withColumn("r", F.dense_rank().over(best_first)).where(F.col("r") <= n)
    kept = materialise(pairs.distinct(), "top-pairs")
    short = kept.groupBy("g").agg(F.countDistinct("i").alias("items"), F.max("r").alias("pairs")).where((F.col("items") < n) & (F.col("pairs") >= n)).select("g")
    best = kept
    if not short.isEmpty():
        again = usable.join(short, "g", "left_semi")
        best = kept.select("g", "i", "s").join(short, "g", "left_anti").unionByName(again)
    items = best.groupBy("g", "i").agg(F.max("s").alias("s"))
    ranked = items.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= n)
    return ranked.select(F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias("score"), "rank")
