"""Work queues: delivery at least once, evaluation of what is pending, notices with a cursor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import quality


def pending(outbox: DataFrame, batch: int) -> DataFrame:
    """The oldest undelivered messages (schema OUTBOX), one batch of them."""
    return outbox.where("delivered_at is null").orderBy("id").limit(batch)


def after_attempts(outbox: DataFrame, results: DataFrame, max_attempts: int | None = None) -> DataFrame:
    """The outbox after a delivery: results has id, at and error (null: delivered).

    A failed message stays pending and counts its attempts; beyond max_attempts, where that is
    set, it is closed with its error.
    """
    joined = outbox.join(results.select("id", F.col("at").alias("_at"), F.col("error").alias("_error")), "id", "left")
    tried, failed = F.col("_at").isNotNull(), F.col("_error").isNotNull()
    attempts = F.col("attempt_count") + tried.cast("int")
    spent = failed & (attempts >= max_attempts) if max_attempts else F.lit(False)
    delivered = F.when(tried & (~failed | spent), F.col("_at")).otherwise(F.col("delivered_at"))
    return joined.select("id", "message_type", "payload_json", "created_at", delivered.alias("delivered_at"), attempts.alias("attempt_count"), F.coalesce("_error", "last_error").alias("last_error"))


def evaluation_tick(turns: DataFrame, evaluations: DataFrame, batch: int) -> DataFrame:
    """Scores of the oldest turns without an evaluation; without any, nothing is to be rebuilt."""
    waiting = turns.join(evaluations.select("turn_id", "revision"), ["turn_id", "revision"], "left_anti")
    return quality.evaluate_turns(waiting.orderBy("occurred_at", "turn_id", "revision").limit(batch))


def unread(notices: DataFrame, acks: DataFrame, owner: str, after: int = 0) -> DataFrame:
    """An owner's notices behind a cursor that no acknowledgement (a row of its own) names."""
    own = notices.where((F.col("owner") == owner) & (F.col("id") > after))
    return own.join(acks.select("id", "owner"), ["id", "owner"], "left_anti").orderBy("id")
