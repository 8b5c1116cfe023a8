"""One shared element is enough: no order of elements is made, and arrays are not joined again."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselight.operators import overlap


def test_one_shared_element_needs_three_shuffles(spark, capsys):
    left = spark.range(2000).select(F.col("id").alias("a"), F.array("id", F.col("id") % 7, F.lit(None).cast("long")).alias("ids"))
    right = spark.range(2000).select(F.col("id").alias("b"), F.array(F.col("id") + 1000, F.col("id") + 1000).alias("ids"))
    found = overlap.overlap_join(left.hint("merge"), right, "a", "b", "ids")
    found.explain()
    plan = capsys.readouterr().out
    assert "Window" not in plan and plan.count("Exchange hashpartitioning") <= 3
    assert {tuple(r) for r in found.collect()} == {(i, i - 1000, 1) for i in range(1000, 2000)}
