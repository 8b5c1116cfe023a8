"""Plans that the driver holds stay small, as its memory is bounded."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselight.llm import line_dedup, pii


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_surrogates_hold_the_signs_once(spark):
    names = spark.createDataFrame([("email", "jo@mail.com"), ("card", "4111111111111111"), ("iban", "gb82west12345698765432")], "kind string, canonical string")
    tried = pii.with_surrogates(names, 0, "k")
    assert _plan(tried).count("zip_with(") <= 3  # hex, upper hex and signs, once for all kinds
    found = {r["kind"]: r["surrogate"] for r in tried.collect()}
    assert found["email"].endswith((".example.com", ".example.net", ".example.org"))
    assert found["card"][0] == "4" and len(found["card"]) == 16
    assert sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(found["card"]))) % 10 == 0
    assert found["iban"][:2] == "gb" and int("".join(str(int(c, 36)) for c in found["iban"][4:] + found["iban"][:4])) % 97 == 1


def test_runs_of_each_depth_are_planned_apart(spark):
    docs = spark.range(20).select(F.col("id").alias("doc_id"), F.concat(F.col("id").cast("string"), F.lit("\na b c\nd e f\ng h i\n"), F.col("id").cast("string")).alias("text"))
    spans = line_dedup.spans_to_delete(line_dedup._keyed(docs), 3, 3)
    assert "Join" not in _plan(spans)
    assert {(r["doc"], *map(tuple, r["spans"])) for r in spans.collect()} == {(i, (1, 4, 3)) for i in range(1, 20)}
