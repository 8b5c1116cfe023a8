"""Postings meet by document, so many documents a partition, whatever the input."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from caselight.operators import evidence, retrieval


def test_documents_meet_in_partitions_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "MEET_DOCS", 100)
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("alpha beta "), F.col("id").cast("string")).alias("text"))
    terms = spark.createDataFrame([("alpha",), ("beta",)], "term string")
    found = retrieval.postings(docs, "doc_id", "text", terms)
    assert found.count() == 4000
    parts = found.groupBy(F.spark_partition_id().alias("p")).agg(F.count_distinct("doc_id").alias("n")).collect()
    assert max(r["n"] for r in parts) < 200 and sum(r["n"] for r in parts) == 2000  # a document is in one partition


def test_past_records_meet_queries_where_their_texts_are(spark, capsys, monkeypatch):
    monkeypatch.setattr(evidence, "MEET_PAIRS", 100)
    asked = spark.createDataFrame([(1, "create a new document on the portal"), (2, "delete the old document")], "query_id long, text string")
    lines = spark.range(400).select(F.col("id").alias("item_id"), F.col("id").alias("order"), F.concat(F.lit("document number "), F.col("id").cast("string"), F.lit(" on the portal")).alias("text"))
    found = evidence.history_matches(asked, lines)
    found.explain()
    assert "hashpartitioning(query_id" not in re.sub(r"hashpartitioning\(query_id#\d+L, \d+\)", "", capsys.readouterr().out)  # no pairs are shuffled
    assert sorted((r["query_id"], r["rank"]) for r in found.collect()) == [(q, k) for q in (1, 2) for k in (1, 2, 3)]
