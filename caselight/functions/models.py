"""Pluggable model calls with deterministic stand-ins, in Arrow batches.

Each takes a function over a batch of texts, so a client of a real model can take the place of
the stand-in; retries are left to Spark's tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Embed = Callable[[list[str]], list[list[float]]]
Score = Callable[[list[str], list[str]], list[float]]
Draft = Callable[[list[str], list[str]], list[str]]


def hashed_embedding(texts: list[str], dimension: int = 64) -> list[list[float]]:
    """Unit vectors from signed hashes of words; equal texts have equal vectors."""
    out = []
    for text in texts:
        vector = np.zeros(dimension)
        for word in text.lower().split():
            digest = hashlib.sha256(word.encode()).digest()
            vector[int.from_bytes(digest[:4], "little") % dimension] += 1 if digest[4] & 1 else -1
        norm = np.linalg.norm(vector)
        out.append((vector / norm if norm else vector).tolist())
    return out


def shared_words(queries: list[str], texts: list[str]) -> list[float]:
    """Share of a query's words that a text has."""
    pairs = [(set(q.lower().split()), set(t.lower().split())) for q, t in zip(queries, texts, strict=True)]
    return [len(q & t) / len(q) if q else 0.0 for q, t in pairs]


def extract(questions: list[str], sources: list[str]) -> list[str]:
    """The source's sentence that shares most words with the question; the first of equals."""
    out = []
    for question, source in zip(questions, sources, strict=True):
        sentences = [s.strip() for s in source.replace("\n", ". ").split(". ") if s.strip()]
        wanted = set(question.lower().split())
        out.append(max(sentences, key=lambda s: len(wanted & set(s.lower().split())), default=""))
    return out


def embedding(text: Column, embed: Embed = hashed_embedding) -> Column:
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(embed(texts.fillna("").tolist()))

    return F.pandas_udf(run, "array<double>")(text)


def rerank_score(query: Column, text: Column, score: Score = shared_words) -> Column:
    """One finite score for each pair."""

    def run(queries: pd.Series, texts: pd.Series) -> pd.Series:
        found = pd.Series(score(queries.fillna("").tolist(), texts.fillna("").tolist()), dtype=float)
        if len(found) != len(queries) or not np.isfinite(found).all():
            raise ValueError("a reranker has to give one finite score for each candidate")
        return found

    return F.pandas_udf(run, "double")(query, text)


def draft(question: Column, source: Column, write: Draft = extract) -> Column:
    def run(questions: pd.Series, sources: pd.Series) -> pd.Series:
        return pd.Series(write(questions.fillna("").tolist(), sources.fillna("").tolist()))

    return F.pandas_udf(run, "string")(question, source)


def backfill(fragments: DataFrame, stored: DataFrame, revision: str, embed: Embed = hashed_embedding) -> DataFrame:
    """Vectors for the fragments (fragment_id, text) that have none of this revision yet."""
    done = stored.where(F.col("model_revision") == revision).select("fragment_id")
    missing = fragments.join(done, "fragment_id", "left_anti")
    return missing.select("fragment_id", embedding(F.col("text"), embed).alias("embedding"), F.lit(revision).alias("model_revision"))
