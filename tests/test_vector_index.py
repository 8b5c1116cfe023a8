"""Cells against the exact scan: all cells give equal rows, clustered vectors need few."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from caselight.operators import retrieval, vector_index


@pytest.fixture(scope="module")
def vectors(spark):
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(20, 16)) * 5
    rows = [(i, [float(x) for x in centres[i % 20] + draw.normal(size=16)]) for i in range(1500)]
    odd = [(5000, None), (5001, []), (5002, [0.0] * 16), (None, [1.0] * 16), (5003, [1.0] * 15 + [None])]
    return spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")


def test_cells(spark, vectors):
    asked = vectors.where("vec_id % 30 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    index = vector_index.build(vectors, buckets=4)
    assert index.cells.count() == 1500 and len(index.centres) == 39
    exact = retrieval.dense_topk(asked, vectors.where("vec_id < 1500"), 10)
    every = vector_index.search(index, asked, 10, 1.0)
    assert sorted(map(tuple, every.collect())) == sorted(map(tuple, exact.collect()))
    share = vector_index.share_for(index, asked, 10)
    assert share < 0.4
    assert vector_index.recall(exact, vector_index.search(index, asked, 10, share)).first()["recall"] >= 0.9


def test_no_vectors(spark, vectors):
    index = vector_index.build(vectors.where("vec_id > 4000"), buckets=2)
    asked = vectors.where("vec_id = 1").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    assert index.cells.count() == 0 and vector_index.search(index, asked.where("false"), 10, 1.0).count() == 0


def test_queries_are_sent_once(spark, vectors, monkeypatch):
    """However many cells it looks into, a query's vector is in one row; lots and pieces do not show in the result."""
    asked = vectors.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    index = vector_index.build(vectors, buckets=4)
    sent, broadcast = [], F.broadcast
    monkeypatch.setattr(F, "broadcast", lambda df: sent.append(df) or broadcast(df))
    wanted = sorted(map(tuple, vector_index.search(index, asked, 10, 0.8).collect()))
    assert [df.agg(F.sum(F.size("q"))).first()[0] for df in sent if "q" in df.columns] == [150 * 16]
    monkeypatch.setattr(vector_index, "QUERIES", 7)
    monkeypatch.setattr(vector_index, "BLOCK", 5)
    for limit in (0, vector_index.BROADCAST_BYTES):
        monkeypatch.setattr(vector_index, "BROADCAST_BYTES", limit)
        assert sorted(map(tuple, vector_index.search(index, asked, 10, 0.8).collect())) == wanted


def test_queries_of_a_block_are_ordered_in_pieces(spark, vectors, monkeypatch):
    """A task holds similarities of QUERY_ROWS queries at once, and their number does not show in the result."""
    asked = vectors.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    found = lambda: sorted(map(tuple, retrieval.dense_topk(asked, vectors, 10, block=500).collect()))
    wanted = found()
    monkeypatch.setattr(retrieval, "QUERY_ROWS", 7)
    assert len(wanted) == 1500 and found() == wanted
