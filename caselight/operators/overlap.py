"""Joins of arrays by what they share, through lists of their rarest elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlap_join(left: DataFrame, right: DataFrame, left_id: str, right_id: str, elements: str, least: int = 1) -> DataFrame:
    """(left_id, right_id, n_shared) of rows whose arrays (column `elements`) share `least` distinct elements or more.

    Elements are ordered from rare to common by the number of rows on both sides that have them.
    Of two arrays that share `least` elements, one lies among the first n - least + 1 of each, so
    only those meet, common elements hardly ever, and the whole arrays are compared once a pair.
    Where one shared element is enough, every meeting is of a pair wanted, so they are counted as they are.
    Null and empty arrays, null elements and null ids meet nothing; the ids are taken to be unique.
    """
    sides = [_side(left, left_id, elements).select(F.lit(0).alias("side"), "id", "own"), _side(right, right_id, elements).select(F.lit(1).alias("side"), "id", "own")]
    both = sides[0].unionByName(sides[1]).where(F.size("own") >= least)
    flat = both.select("side", "id", F.size("own").alias("n"), F.explode("own").alias("element"))
    if least == 1:
        ids = lambda side, name: sides[side].select(F.col("id").alias(name), F.explode("own").alias("element"))
        pairs = ids(0, left_id).join(ids(1, right_id), "element").groupBy(left_id, right_id)
        return pairs.agg(F.count("*").cast("int").alias("n_shared"))
    common = flat.groupBy("element").agg(F.count("*").alias("rows"), F.count_if(F.col("side") == 0).alias("lefts"))
    # an element of one side alone joins nothing, but keeps its place in the order
    placed = flat.join(common, "element").withColumn("place", F.row_number().over(Window.partitionBy("side", "id").orderBy("rows", "element")))
    keys = placed.where((F.col("place") <= F.col("n") - least + 1) & (F.col("lefts") > 0) & (F.col("lefts") < F.col("rows"))).select("side", "id", "element")
    met = keys.where("side = 0").select("element", F.col("id").alias("l")).join(keys.where("side = 1").select("element", F.col("id").alias("r")), "element").select("l", "r").distinct()
    pairs = met.join(sides[0].select(F.col("id").alias("l"), F.col("own").alias("x")), "l").join(sides[1].select(F.col("id").alias("r"), F.col("own").alias("y")), "r")
    shared = pairs.withColumn("n_shared", F.size(F.array_intersect("x", "y"))).where(F.col("n_shared") >= least)
    return shared.select(F.col("l").alias(left_id), F.col("r").alias(right_id), "n_shared")


def _side(rows: DataFrame, row_id: str, elements: str) -> DataFrame:
    own: Column = F.array_distinct(F.array_compact(elements))
    return rows.where(F.col(row_id).isNotNull() & F.col(elements).isNotNull()).select(F.col(row_id).alias("id"), own.alias("own"))
