"""A vector index in cells: every vector lies in the cell of its nearest centre, and a query looks into its nearest cells.

Centres are fitted on a bounded sample (SAMPLE vectors, those of the least hash of their ids); all
vectors are indexed. The table is bucketed by cell, so that a search reads its queries into the
buckets and shuffles no vector. The exact scan (retrieval.dense_topk) remains the exact way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.written import bucketed
from .ranking import best_per_query
from .retrieval import BROADCAST_BYTES, dense_topk

#: Vectors that centres are fitted on, at most; and centres, at most.
SAMPLE, MOST_CELLS = 50_000, 4_096
#: Recall that a share of probed cells is chosen for, and queries that it is measured on, at most.
TARGET, MEASURED = 0.92, 500
#: Rounds of the fit.
ROUNDS, SEED = 10, 42
#: Vectors of a cell that one task multiplies at once.
BLOCK = 4_096
#: Queries of a lot.
QUERIES = 1_024


@dataclass(frozen=True)
class VectorIndex:
    """cells: cell, vec_id, vector (unit length), in buckets by cell; centres: one row for each cell."""

    cells: DataFrame
    centres: np.ndarray


def _sound(vectors: DataFrame) -> DataFrame:
    """vec_id and unit vector; vectors that are null, empty, zero or hold a null or no number are left out."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x))")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x))
    return rows.withColumn("norm", norm).where("norm > 0 and norm < double('infinity')").select("vec_id", F.transform("v", lambda x: x / F.col("norm")).alias("vector"))


def _matrix(arrays: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(a, np.float64) for a in arrays])


def build(vectors: DataFrame, buckets: int = 16, cells: int | None = None) -> VectorIndex:
    """Indexes vectors (vec_id, embedding) of one length; by default the root of their number of cells."""
    rows = _sound(vectors)
    n = rows.count()
    k = max(1, min(MOST_CELLS, cells or round(n**0.5), n))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select(array_to_vector("vector").alias("features"))
    fitted = KMeans(k=k, maxIter=ROUNDS, seed=SEED).fit(sample).clusterCenters() if n else [np.zeros(1)]
    centres = np.stack(fitted)
    centres = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                batch["cell"] = np.argmax(_matrix(batch["vector"]) @ centres.T, axis=1)
                yield batch

    dealt = rows.mapInPandas(placed, "vec_id long, vector array<double>, cell long")
    return VectorIndex(bucketed(dealt, "vector_cells", "cell", buckets, ["vec_id"]), centres)


def search(index: VectorIndex, queries: DataFrame, k: int, probed: float, digits: int = 5) -> DataFrame:
    """(query_id, vec_id, similarity, rank): the k most similar other vectors in the probed share of cells.

    queries: query_id, query. Each query is sent once, with a bit for each cell that it looks into,
    in lots of about QUERIES; a cell's vectors meet them in pieces of BLOCK vectors, and of each
    piece a task keeps the k best of a query.
    """
    centres = index.centres
    probes = max(1, round(probed * len(centres)))
    n = queries.count()
    deals = max(1, -(-n // QUERIES))

    def cells_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), QUERIES):
                some = batch.iloc[at : at + QUERIES]
                near = np.argsort(-(_matrix(some["vector"]) @ centres.T), axis=1, kind="stable")[:, :probes]
                marks = np.zeros((len(some), len(centres)), bool)
                np.put_along_axis(marks, near, True, axis=1)
                yield pd.DataFrame({"query_id": some["vec_id"], "vector": some["vector"], "cells": [m.tobytes() for m in np.packbits(marks, axis=1)]})

    asked = _sound(queries.select(F.col("query_id").alias("vec_id"), F.col("query").alias("embedding"))).mapInPandas(cells_of, "query_id long, vector array<double>, cells binary")
    dealt = asked.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(deals)).alias("deal"))
    dealt = dealt.agg(F.collect_list("query_id").alias("q_ids"), F.flatten(F.collect_list("vector")).alias("q"), F.collect_list("cells").alias("q_cells")).drop("deal")
    dealt = F.broadcast(dealt) if n * (8 * centres.shape[1] + len(centres) // 8) <= BROADCAST_BYTES else dealt
    piece = F.floor((F.row_number().over(Window.partitionBy("cell").orderBy("vec_id")) - 1) / BLOCK)
    blocks = index.cells.withColumn("piece", piece).groupBy("cell", "piece").agg(F.collect_list("vec_id").alias("v_ids"), F.flatten(F.collect_list("vector")).alias("v"))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for cell, q_ids, q, q_cells, v_ids, v in zip(*(batch[c] for c in ("cell", "q_ids", "q", "q_cells", "v_ids", "v")), strict=True):
                looks = np.array([m[cell // 8] >> 7 - cell % 8 & 1 for m in q_cells], bool)
                if not looks.any():
                    continue
                q_ids, v_ids = np.asarray(q_ids, np.int64)[looks], np.asarray(v_ids, np.int64)
                close = np.round(np.asarray(q).reshape(len(looks), -1)[looks] @ np.asarray(v).reshape(len(v_ids), -1).T, digits)
                close[q_ids[:, None] == v_ids[None, :]] = -np.inf
                order = np.lexsort((np.broadcast_to(v_ids, close.shape), -close), axis=1)[:, :k]
                rows = pd.DataFrame({"query_id": np.repeat(q_ids, order.shape[1]), "vec_id": v_ids[order].ravel(), "similarity": np.take_along_axis(close, order, axis=1).ravel()})
                yield rows[np.isfinite(rows["similarity"])]

    found = blocks.crossJoin(dealt).mapInPandas(best, "query_id long, vec_id long, similarity double")
    return best_per_query(found, "query_id", [F.desc("similarity"), F.col("vec_id")], k)


def share_for(index: VectorIndex, queries: DataFrame, k: int, target: float = TARGET) -> float:
    """The least share of cells, in steps of a cell, in which a sample of the queries finds its target share of the exact k.

    The sample has MEASURED queries at most, those of the least hash of their ids; each of their
    exact neighbours counts by the place of its cell in the query's order of cells.
    """
    centres = index.centres
    vectors = index.cells.select("vec_id", F.col("vector").alias("embedding"))
    asked = _sound(queries.select(F.col("query_id").alias("vec_id"), F.col("query").alias("embedding"))).orderBy(F.xxhash64("vec_id"), "vec_id").limit(MEASURED)
    asked = asked.select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query"))

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                close = _matrix(batch["query"]) @ centres.T
                own = np.take_along_axis(close, batch["cell"].to_numpy()[:, None], axis=1)
                yield pd.DataFrame({"place": (close > own).sum(axis=1) + 1})

    exact = dense_topk(asked, vectors, k).select("query_id", "vec_id").join(asked, "query_id").join(index.cells.select("vec_id", "cell"), "vec_id")
    counts = exact.select("query", "cell").mapInPandas(places, "place long").groupBy("place").count().collect()  # a row a cell at most
    total, seen = sum(r["count"] for r in counts), 0
    for r in sorted(counts):
        seen += r["count"]
        if seen >= target * total:
            return r["place"] / len(centres)
    return 1.0


def recall(exact: DataFrame, found: DataFrame) -> DataFrame:
    """n_queries and recall: the share of the exact rows (query_id, vec_id) that were found, each query counting alike."""
    hit = exact.join(found.select("query_id", "vec_id", F.lit(1.0).alias("hit")), ["query_id", "vec_id"], "left")
    per_query = hit.groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("share"))
    return per_query.agg(F.count("*").alias("n_queries"), F.avg("share").alias("recall"))
