"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_lineage_short


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _digest(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def component_roots(links: DataFrame) -> DataFrame:
    """(u, v) links between longs -> (u, root) for every u that has a smaller one in its component.

    Each round is checkpointed, so a lost executor costs one round at most; the number of
    rounds grows with the logarithm of a component's size. An empty table gives no rows.
    """
    now = keep_lineage_short(links.where("u <> v").select("u", "v").distinct())
    seen = _digest(now)
    while seen[0]:
        now = keep_lineage_short(_small_star(_large_star(now)))
        was, seen = seen, _digest(now)
        if was == seen:
            break
    return now.select("u", F.col("v").alias("root"))
