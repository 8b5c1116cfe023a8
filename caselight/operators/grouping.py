"""Counting and picking: frequency tables, windows of time, first and latest rows."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LONGEST_WINDOW = timedelta(days=366)


def check_window(start: datetime, stop: datetime) -> tuple[datetime, datetime]:
    """The bounds of a half-open window, if they make one of at most 366 days."""
    if start >= stop:
        raise ValueError("a window has to end after it starts")
    if stop - start > LONGEST_WINDOW:
        raise ValueError("a window has 366 days at most")
    return start, stop


def clamp(limit: int, most: int) -> int:
    return max(1, min(int(limit), most))


def within(column: str, start: datetime | str, stop: datetime | str) -> Column:
    return (F.col(column) >= F.lit(start).cast("timestamp_ntz")) & (F.col(column) < F.lit(stop).cast("timestamp_ntz"))


def frequency(df: DataFrame, column: Column, name: str = "key", missing: str = "UNSPECIFIED") -> DataFrame:
    """name and n, null and empty keys counted as `missing`."""
    key = F.coalesce(F.nullif(column.cast("string"), F.lit("")), F.lit(missing))
    return df.groupBy(key.alias(name)).agg(F.count("*").alias("n"))


def day_counts(df: DataFrame, ts: str, counters: dict[str, Column]) -> DataFrame:
    """day (text), total, and one count for each condition."""
    day = F.date_format(F.to_date(ts), "yyyy-MM-dd").alias("day")
    return df.groupBy(day).agg(F.count("*").alias("total"), *[F.count_if(c).alias(n) for n, c in counters.items()])


def latest(df: DataFrame, keys: list[str], by: Column, columns: list[str]) -> DataFrame:
    """One row per key: that of the greatest `by`. Map-side combine, no sort of a key's rows."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*columns), by).alias("row")).select(*keys, "row.*")


def earliest(df: DataFrame, keys: list[str], by: Column, columns: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.min_by(F.struct(*columns), by).alias("row")).select(*keys, "row.*")


def repeated_questions(df: DataFrame, key: Column, text: str, decision: str, order: Column, least: int = 2) -> DataFrame:
    """question_key, n, the latest wording, and the decisions as `name=count` in order of name.

    Two levels of grouping: decisions first, so a question asked very often is small before
    its decisions meet.
    """
    rows = df.select(key.alias("question_key"), F.col(text).alias("text"), F.col(decision).alias("decision"), order.alias("order"))
    rows = rows.where("question_key is not null and question_key <> ''")
    by_decision = rows.groupBy("question_key", "decision").agg(F.count("*").alias("n"), F.max_by("text", "order").alias("text"), F.max("order").alias("order"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("decision", "n"))), lambda x: F.concat(x["decision"], F.lit("="), x["n"].cast("string"))), ",")
    total = by_decision.groupBy("question_key").agg(F.sum("n").alias("n"), F.max_by("text", "order").alias("sample"), listed.alias("decisions"))
    return total.where(F.col("n") >= least)


#: Width of the ranges of the order in which a running sum is worked out.
RANGE_WIDTH = 1 << 16


def running_sum(df: DataFrame, keys: list[str], order: str, value: Column, name: str, before: bool = False, width: int = RANGE_WIDTH) -> DataFrame:
    """Adds the sum of value up to each row of a key (or before it), in order of a whole number.

    A key's rows are dealt by ranges of the order, so a key with very many rows is no one
    task's work: sums of ranges are added up first, then rows within a range.
    """
    rows = df.withColumn("_range", F.floor(F.col(order) / width)).withColumn("_value", value.cast("long"))
    sums = rows.groupBy(*keys, "_range").agg(F.sum("_value").alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, "_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    within = Window.partitionBy(*keys, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1 if before else Window.currentRow)
    total = F.col("_offset") + F.coalesce(F.sum("_value").over(within), F.lit(0))
    return rows.join(offsets, [*keys, "_range"]).withColumn(name, total).drop("_range", "_value", "_offset")


def islands(df: DataFrame, keys: list[str], order: str, resets: Column) -> DataFrame:
    """Adds island: how many resets a key has seen before and at each row."""
    return running_sum(df, keys, order, resets.cast("int"), "island")
