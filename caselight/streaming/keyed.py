"""Keyed streams: idempotent intake, monotonic status, and windows of event time."""

from __future__ import annotations

from collections.abc import Iterator
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

INTAKE = "key string, event_id long, status string"
STATUS = "case_id long, revision long, stage double, specialist string, applied boolean"


def _in_order(batches: Iterator[pd.DataFrame], columns: list[str]) -> list[tuple]:
    """A key's rows of one micro-batch by the first column: Arrow cuts a key's rows anywhere, so one batch does not tell their order."""
    return sorted((row for b in batches for row in zip(*(b[c].tolist() for c in columns), strict=True)), key=itemgetter(0))


def intake(facts: DataFrame) -> DataFrame:
    """status of every fact (key, event_id, content): NEW, IDEMPOTENT or CONFLICT with the first of its key."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, first, out = state.get[0] if state.exists else None, not state.exists, []
        for event_id, content in _in_order(batches, ["event_id", "content"]):
            if first:
                out.append((key[0], event_id, "NEW"))
                known, first = content, False
            else:
                out.append((key[0], event_id, "IDEMPOTENT" if content is not None and content == known else "CONFLICT"))
        if out:
            state.update((known,))
        yield pd.DataFrame(out, columns=["key", "event_id", "status"])

    return facts.groupBy("key").applyInPandasWithState(step, INTAKE, "content string", "append", GroupStateTimeout.NoTimeout)


def status_ingest(updates: DataFrame) -> DataFrame:
    """Applies status updates (case_id, revision, stage, specialist) with rising revisions only.

    Fields that an update leaves out keep their last value.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        revision, stage, specialist = state.get if state.exists else (-1, None, None)
        out = []
        for r, s, p in _in_order(batches, ["revision", "stage", "specialist"]):
            applied = r > revision
            if applied:
                revision = r
                stage = s if pd.notna(s) else stage
                specialist = p if p is not None and pd.notna(p) else specialist
            out.append((key[0], r, stage, specialist, applied))
        state.update((int(revision), stage, specialist))
        yield pd.DataFrame(out, columns=["case_id", "revision", "stage", "specialist", "applied"])

    return updates.groupBy("case_id").applyInPandasWithState(step, STATUS, "revision long, stage double, specialist string", "append", GroupStateTimeout.NoTimeout)


def spikes(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Events of each kind in windows of event time; what comes too late is left out."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
