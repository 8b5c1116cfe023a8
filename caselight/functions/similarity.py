"""Similarities. Set and vector measures are expressions; those over alignments run in Arrow batches."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def jaccard(a: Column, b: Column) -> Column:
    return overlap(a, b) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def containment(a: Column, b: Column) -> Column:
    """Share of the smaller set that the other has."""
    return overlap(a, b) / F.greatest(F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b))), F.lit(1))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def is_unit(vector: Column, tolerance: float = 0.02) -> Column:
    """Finite numbers with a norm of one, within a tolerance."""
    finite = F.forall(vector, lambda x: ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return finite & (F.abs(F.sqrt(dot(vector, vector)) - 1) <= tolerance)


@lru_cache(maxsize=16_384)
def _grams(text: str) -> tuple[str, ...]:
    out = []
    for word in "".join(c if c.isalnum() else " " for c in text.lower()).split():
        padded = f"  {word} "
        out += [padded[i : i + 3] for i in range(len(padded) - 2)]
    return tuple(out)


@lru_cache(maxsize=4096)
def _distinct_grams(text: str) -> frozenset[str]:
    return frozenset(_grams(text))


def word_similarity_of(query: str, text: str) -> float:
    """Greatest share of the query's 3-grams against a run of the text's 3-grams.

    A run counts for |query and run| / |query or run|; runs begin and end at shared grams.
    """
    wanted = _distinct_grams(query)
    grams = _grams(text)
    spots = [i for i, g in enumerate(grams) if g in wanted]
    best = 0.0
    for k, start in enumerate(spots):
        seen: set[str] = set()
        hits, at = 0, start
        for stop in spots[k:]:
            for gram in grams[at : stop + 1]:
                if gram not in seen:
                    seen.add(gram)
                    hits += gram in wanted
            at = stop + 1
            best = max(best, hits / (len(wanted) + len(seen) - hits))
            if len(seen) > 3 * len(wanted):
                break  # longer runs only add grams that are not wanted
    return best


def _word_similarities(queries: pd.Series, texts: pd.Series) -> pd.Series:
    return pd.Series([word_similarity_of(q or "", t or "") for q, t in zip(queries, texts, strict=True)], dtype=float)


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype=float)


def word_similarity(query: Column, text: Column) -> Column:
    return F.pandas_udf(_word_similarities, "double")(query, text)


def sequence_ratio(a: Column, b: Column) -> Column:
    """Share of two texts in matching blocks."""
    return F.pandas_udf(_ratios, "double")(a, b)
