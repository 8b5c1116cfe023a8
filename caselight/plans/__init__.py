"""Registered queries and their SQL counterparts."""

from . import evidence, layout, lexical, operations, quality, retrieval, streams, structure, texts, vectors
from .registered import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "evidence", "layout", "lexical", "operations", "quality", "retrieval", "streams", "structure", "texts", "vectors"]
