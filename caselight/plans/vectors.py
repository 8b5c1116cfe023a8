"""Vectors: a search in cells with its recall, and the star of snapshot members in front of a dense search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import retrieval, vector_index
from ..sources.tables import table
from .registered import query


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All vectors, and those whose id is divisible by 20 as queries."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vectors, vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


@query()
def dense_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten neighbours of each query in the cells that a recall of 0.92 asks for."""
    vectors, asked = _vectors(spark, sf_dir)
    index = vector_index.build(vectors)
    found = vector_index.search(index, asked, 10, vector_index.share_for(index, asked, 10))
    return found.select("query_id", "vec_id", "similarity", "rank")


@query("SELECT count(*) AS n_queries, TRUE AS recall_reached FROM embeddings WHERE vec_id % 20 = 0")
def dense_index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the search in cells finds nine tenths of what the exact scan finds."""
    vectors, asked = _vectors(spark, sf_dir)
    found = vector_index.recall(retrieval.dense_topk(asked, vectors, 10), dense_index_topk(spark, sf_dir))
    return found.select("n_queries", (F.col("recall") >= 0.9).alias("recall_reached"))


@query("""
WITH members AS (
  SELECT d.doc_id, d.lang, d.source, coalesce(l.quality, 0) AS quality, e.embedding
  FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE d.lang IN ('en', 'fr') AND trim(d.text) <> ''),
scored AS (
  SELECT q.vec_id AS query_id, m.doc_id, m.source, m.quality, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(m.embedding AS DOUBLE[])), 5) AS similarity
  FROM embeddings q JOIN members m ON m.doc_id <> q.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, doc_id, source, quality, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, doc_id) AS rank FROM scored) WHERE rank <= 5
""")
def star_dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of a snapshot (documents of two languages with a text) with their vectors and labels, five to a query; the members alone are scored."""
    vectors, asked = _vectors(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").where("lang in ('en', 'fr') and trim(text) <> ''").select("doc_id", "source")
    members = docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left").join(vectors.withColumnRenamed("vec_id", "doc_id"), "doc_id")
    top = retrieval.dense_topk(asked, members.select(F.col("doc_id").alias("vec_id"), "embedding"), 5).withColumnRenamed("vec_id", "doc_id")
    return top.join(members.drop("embedding"), "doc_id").select("query_id", "doc_id", "source", F.coalesce("quality", F.lit(0)).alias("quality"), "similarity", "rank")
