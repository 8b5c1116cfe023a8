"""Retrieval: exact codes, shared tokens, 3-grams and vectors.

Queries are few beside documents and are given as a table of their own. Tokens meet through a
postings table by equi-join; only the candidates that share something are scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .ranking import best_per_query

TRIGRAM_LEAST = 0.40
#: A side is broadcast up to so many rows of query tokens, and shuffled beyond.
BROADCAST_ROWS = 100_000
#: Documents of one partition in which all that is asked of a document meets.
MEET_DOCS = 2_000
#: Query heads that are looked for by a list in the plan, at most.
FEW_HEADS = 500


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The table with a broadcast hint if its size, which is counted, allows it."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def meeting_places(n_docs: int) -> int:
    """Partitions in which the rows of so many documents meet by document; a task's share does not grow with them."""
    return max(1, -(-n_docs // MEET_DOCS))


def exact_score(text: Column, codes: list[str]) -> Column:
    """How many of the codes a text contains, in whatever case."""
    hits = [F.when(F.lower(text).contains(c.lower()), 1.0).otherwise(0.0) for c in dict.fromkeys(codes) if c]
    return reduce(lambda a, b: a + b, hits, F.lit(0.0))


def any_channel(channels: list[Column]) -> Column:
    """The rows that some channel finds; without channels none."""
    return reduce(lambda a, b: a | b, channels, F.lit(False))


def postings(docs: DataFrame, doc_id: str, text: str, terms: DataFrame) -> DataFrame:
    """term, doc_id and tf of some terms (column term); words that are not asked for leave before anything is shuffled.

    They meet by document alone, MEET_DOCS documents a partition, so that what follows by document needs no other
    shuffle and no task holds more than the groups of so many. For many searches over one corpus, term_index writes
    the postings of all terms once.
    """
    words = docs.select(F.col(doc_id).alias("doc_id"), F.explode(T.tokens(F.col(text))).alias("term"))
    asked = words.join(small(terms.select("term").distinct()), "term", "left_semi")
    return asked.repartition(meeting_places(docs.count()), "doc_id").groupBy("term", "doc_id").agg(F.count("*").alias("tf"))


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, n_terms and term of each distinct token of queries (query_id, text)."""
    terms = queries.select("query_id", F.array_distinct(T.tokens(F.col("text"))).alias("terms"))
    return terms.select("query_id", F.size("terms").alias("n_terms"), F.explode("terms").alias("term"))


def token_scores(queries: DataFrame, index: DataFrame) -> DataFrame:
    """query_id, doc_id, n_shared (terms of the query that a document has), tf (their uses), coverage.

    The full-text substitute: coverage first, then frequency. queries: query_id, text.
    """
    hits = index.join(small(query_terms(queries)), "term").groupBy("query_id", "doc_id", "n_terms").agg(F.count("*").alias("n_shared"), F.sum("tf").alias("tf"))
    return hits.withColumn("coverage", F.col("n_shared") / F.col("n_terms"))


def exact_hits(queries: DataFrame, docs: DataFrame, doc_id: str, text: str, words: int = 6) -> DataFrame:
    """(query_id, doc_id) of documents that contain a query's text, whatever the case and spaces.

    A document that contains a query has all its words but the first and the last as words of its
    own, so it meets the query by a hash of the first of those, and no pair is formed in vain. A
    query of one or two words, such as a code, can stand inside words; all texts are searched for it.
    """
    folded = lambda c: F.lower(T.fold_spaces(c))
    q = queries.select("query_id", folded(F.col("text")).alias("q_text")).withColumn("q_words", F.split("q_text", " "))
    q = q.withColumn("inner", F.least(F.lit(words), F.size("q_words") - 2))
    asked = q.where("inner > 0").select("query_id", "q_text", F.col("inner"), F.xxhash64(F.slice("q_words", F.lit(2), F.greatest("inner", F.lit(0)))).alias("head"))
    d = docs.select(F.col(doc_id).alias("doc_id"), folded(F.col(text)).alias("d_text"))
    sizes = sorted(r["inner"] for r in asked.select("inner").distinct().collect())  # `words` numbers at most
    spans = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size("d_words") - n + 1, F.lit(1))), lambda i: F.xxhash64(F.slice("d_words", i, n)))
    heads = F.concat(F.array().cast("array<long>"), *[spans(n) for n in sizes])
    known = asked.select("head").distinct().limit(FEW_HEADS + 1).collect()
    if len(known) <= FEW_HEADS:  # few queries: other heads leave inside the scan
        heads = F.filter(heads, lambda h: h.isin([r["head"] for r in known]))
    flat = d.withColumn("d_words", F.split("d_text", " ")).select("doc_id", "d_text", F.explode(F.array_distinct(heads)).alias("head"))
    met = flat.join(small(asked.select("query_id", "q_text", "head")), "head").where(F.col("d_text").contains(F.col("q_text")))
    short = d.join(small(q.where("inner < 1").select("query_id", "q_text")), F.col("d_text").contains(F.col("q_text")))
    return met.select("query_id", "doc_id").union(short.select("query_id", "doc_id")).distinct()


#: Vectors of one block; a pair of blocks is one multiplication in a task.
BLOCK_VECTORS = 2_000
#: Queries of a block that are multiplied and ordered at once.
QUERY_ROWS = 256
#: Queries are broadcast up to so many bytes of vectors; beyond, each task reads them block by block.
BROADCAST_BYTES = 64 << 20


def _blocks(vectors: DataFrame, ids: str, values: str, out_ids: str, out_values: str, n: int) -> DataFrame:
    """Vectors packed into n rows and more by a hash of their ids, those of one length together."""
    whole = vectors.where(F.col(ids).isNotNull() & F.col(values).isNotNull() & (F.size(values) > 0) & ~F.exists(values, lambda x: x.isNull()))
    packed = whole.groupBy(F.pmod(F.xxhash64(ids), F.lit(n)).alias("_b"), F.size(values).alias("_d"))
    return packed.agg(F.collect_list(ids).alias(out_ids), F.flatten(F.collect_list(values)).alias(out_values)).drop("_b", "_d")


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int, digits: int = 5, block: int = BLOCK_VECTORS) -> DataFrame:
    """(query_id, vec_id, similarity, rank): the k most similar other vectors of each query, exactly.

    queries: query_id, query; vectors: vec_id, embedding. Vectors that are null, empty or hold a
    null match nothing, and only those of one length match each other; a vector of zeros has a
    similarity of zero. Each vector is shuffled once, into its block, and blocks stay where they
    are: those of the queries come to them, by broadcast where their counted size allows it. Of
    a pair of blocks a task keeps the k best of each query.
    """
    sizes = queries.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("query")), F.lit(0)).alias("values")).first()

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for q_ids, q, v_ids, v in zip(batch["q_ids"], batch["q"], batch["v_ids"], batch["v"], strict=True):
                q_ids, v_ids = np.asarray(q_ids, np.int64), np.asarray(v_ids, np.int64)
                q, v = np.asarray(q, np.float64).reshape(len(q_ids), -1), np.asarray(v, np.float64).reshape(len(v_ids), -1)
                if q.shape[1] != v.shape[1]:
                    continue
                lengths = np.sqrt((v * v).sum(axis=1))
                for at in range(0, len(q_ids), QUERY_ROWS):
                    ids, some = q_ids[at : at + QUERY_ROWS], q[at : at + QUERY_ROWS]
                    norms = np.sqrt((some * some).sum(axis=1))[:, None] * lengths[None, :]
                    close = np.round(np.divide(some @ v.T, norms, out=np.zeros_like(norms), where=norms > 0), digits)
                    close[ids[:, None] == v_ids[None, :]] = -np.inf
                    order = np.lexsort((np.broadcast_to(v_ids, close.shape), -close), axis=1)[:, :k]
                    rows = pd.DataFrame({"query_id": np.repeat(ids, order.shape[1]), "vec_id": v_ids[order].ravel(), "similarity": np.take_along_axis(close, order, axis=1).ravel()})
                    yield rows[np.isfinite(rows["similarity"])]

    asked = _blocks(queries, "query_id", "query", "q_ids", "q", max(1, -(-sizes["n"] // block)))
    asked = F.broadcast(asked) if 8 * sizes["values"] <= BROADCAST_BYTES else asked
    pairs = _blocks(vectors, "vec_id", "embedding", "v_ids", "v", max(1, -(-vectors.count() // block))).crossJoin(asked)  # of blocks
    found = pairs.mapInPandas(best, "query_id long, vec_id long, similarity double")
    return best_per_query(found, "query_id", [F.desc("similarity"), F.col("vec_id")], k)
