"""Ranking: channels, fusion, evaluation, percentiles and stratified samples."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60
SAMPLE_SEED = 20260912


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))


def best_per_query(df: DataFrame, query: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each query, with rank; Spark keeps k rows a task and query before the shuffle."""
    return ranked(df, [query], order).where(F.col("rank") <= k)


def fuse(channels: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of (query_id, channel, item_id, rank).

    An item that a channel lists twice counts by its first rank, and the ranks of others stay.
    """
    first = channels.groupBy("query_id", "channel", "item_id").agg(F.min("rank").alias("rank"))
    return first.groupBy("query_id", "item_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("rrf"), F.count("*").alias("n_channels"))


def evaluate_ranks(expected: DataFrame, hits: DataFrame, depths: tuple[int, ...] = (5, 10)) -> DataFrame:
    """Recall at depths and mean reciprocal rank within the deepest.

    expected: query_id, item_id; hits: query_id, item_id, rank. A query counts by its first hit.
    """
    found = expected.join(hits, ["query_id", "item_id"], "left").groupBy("query_id").agg(F.min("rank").alias("rank"))
    return found.agg(F.count("*").alias("n_queries"), *_measures(depths))


def _measures(depths: tuple[int, ...]) -> list[Column]:
    recalls = [F.avg(F.when(F.col("rank") <= d, 1.0).otherwise(0.0)).alias(f"recall_at_{d}") for d in depths]
    return [*recalls, F.avg(F.when(F.col("rank") <= max(depths), 1.0 / F.col("rank")).otherwise(0.0)).alias("mrr")]


def evaluate_subsets(expected: DataFrame, hits: DataFrame, subsets: DataFrame, depths: tuple[int, ...] = (5, 10)) -> DataFrame:
    """evaluate_ranks for each subset of queries; subsets: query_id, subset, a row for each that a query is in."""
    first = expected.join(hits, ["query_id", "item_id"], "left").groupBy("query_id").agg(F.min("rank").alias("rank"))
    return first.join(subsets, "query_id").groupBy("subset").agg(F.count("*").alias("n_queries"), *_measures(depths))


#: Groups of more rows are narrowed to the values about a percentile before these are ordered.
NARROW_ROWS = 200_000
#: Relative accuracy of the sketch that narrows, and how far about a percentile values are kept.
SKETCH, AROUND = 100_000, 1e-4


def nearest_rank(df: DataFrame, group: list[str], value: str, percentiles: tuple[int, ...], narrow: int = NARROW_ROWS) -> DataFrame:
    """Percentiles by nearest rank, round-half-even of p/100 * (n - 1), in three decimals; nulls count for none.

    Exact in two passes: a sketch gives values surely below and above each percentile, and only
    those between are counted and ordered, one window a group and percentile, with the number of
    rows below them. A sketch's error is a tenth of what is kept on either side.
    """
    rows = df.where(F.col(value).isNotNull()).select(*group, F.col(value).alias("v"))
    ends = [min(max(p / 100.0 + d, 0.0), 1.0) for p in percentiles for d in (-AROUND, AROUND)]
    about = rows.groupBy(*group).agg(F.count("*").alias("n_values"), F.percentile_approx("v", ends, SKETCH).alias("ends"))
    bounds = F.array(*[F.struct(F.lit(p).alias("p"), F.col("ends")[2 * i].alias("low"), F.col("ends")[2 * i + 1].alias("high")) for i, p in enumerate(percentiles)])
    ends_of = [F.when(F.col("n_values") > narrow, F.col(f"b.{c}")).alias(c) for c in ("low", "high")]
    asked = about.select(*group, "n_values", F.explode(bounds).alias("b")).select(*[F.col(g).alias(f"_{g}") for g in group], "n_values", "b.p", *ends_of)
    same = [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in group]
    met = rows.join(asked, reduce(lambda a, b: a & b, same, F.lit(True))).select(*group, "n_values", "p", "low", "high", "v")
    keys = [*group, "p"]
    under = F.coalesce(F.col("v") < F.col("low"), F.lit(False))
    inside = F.coalesce(F.col("v") <= F.col("high"), F.lit(True))
    # values below are one row of a group and percentile, with the rows that they stand for
    counted = met.where(under | inside).groupBy(*keys, "n_values", F.when(~under, F.col("v")).alias("v")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy(F.asc_nulls_first("v")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    place = F.bround(F.col("p") / 100.0 * (F.col("n_values") - 1), 0)
    found = counted.withColumn("stop", upto).where((place >= F.col("stop") - F.col("n")) & (place < F.col("stop")))
    return found.groupBy(*group, "n_values").agg(*[F.bround(F.max(F.when(F.col("p") == p, F.col("v"))), 3).alias(f"p{p}") for p in percentiles])


def allocate(sizes: dict[str, int], target: int) -> dict[str, int]:
    """Rows to take of each group: one each, then shares by the root of sizes, then one at a time to the fullest."""
    target = min(target, sum(sizes.values()))
    taken = {g: 1 for g in sorted(sizes)[:target]}
    left = target - len(taken)
    if left:
        weights = {g: math.sqrt(n) for g, n in sizes.items()}
        total = sum(weights.values())
        for g in sorted(sizes):
            taken[g] = taken.get(g, 0) + min(sizes[g] - taken.get(g, 0), int(left * weights[g] / total))
        while sum(taken.values()) < target:
            open_ = [g for g in sorted(sizes) if taken[g] < sizes[g]]
            fullest = min(open_, key=lambda g: (taken[g] - sizes[g], g))
            taken[fullest] += 1
    return taken


def stratified_sample(rows: DataFrame, identity: Column, group: Column, row: Column, target: int, seed: int = SAMPLE_SEED) -> DataFrame:
    """A reproducible sample of distinct identities, with every group in it.

    Groups are few (themes), so their sizes go to the driver; the rows do not. Of equal
    identities, the one of smallest row stays.
    """
    keyed = rows.select("*", identity.alias("_identity"), group.alias("_group"), row.alias("_row")).where("_identity is not null")
    rest = [c for c in keyed.columns if c != "_identity"]
    once = keyed.groupBy("_identity").agg(F.min_by(F.struct(*rest), "_row").alias("r")).select("_identity", "r.*")
    key = F.sha2(F.concat_ws("|", F.lit(str(seed)), "_identity", F.col("_row").cast("string")), 256)
    once = once.withColumn("_key", key)
    sizes = {r["_group"]: r["count"] for r in once.groupBy("_group").count().collect()}
    quota = rows.sparkSession.createDataFrame(list(allocate(sizes, target).items()) or [("", 0)], "_group string, _quota int")
    # no group gives more than the target, so each task keeps no more of it
    placed = ranked(once, ["_group"], [F.col("_key")], "_place").where(F.col("_place") <= target).join(F.broadcast(quota), "_group")
    return placed.where("_place <= _quota").drop("_place", "_quota", "_row")
