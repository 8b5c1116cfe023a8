from __future__ import annotations

from datetime import datetime

from caselight import schemas
from caselight.streaming import delivery

from .test_operators import turns

NOW = datetime(2024, 1, 1)


def test_failed_messages_stay_until_attempts_are_spent(spark):
    rows = [(i, "t", "{}", NOW, None, n, None) for i, n in ((1, 0), (2, 0), (3, 2))] + [(4, "t", "{}", NOW, NOW, 1, None)]
    outbox = spark.createDataFrame(rows, schemas.OUTBOX)
    assert [r["id"] for r in delivery.pending(outbox, 2).collect()] == [1, 2]
    results = spark.createDataFrame([(1, NOW, None), (2, NOW, "timeout"), (3, NOW, "timeout")], "id long, at timestamp, error string")
    after = {r["id"]: (r["delivered_at"] is not None, r["attempt_count"], r["last_error"]) for r in delivery.after_attempts(outbox, results, 3).collect()}
    assert after == {1: (True, 1, None), 2: (False, 1, "timeout"), 3: (True, 3, "timeout"), 4: (True, 1, None)}
    kept = {r["id"] for r in delivery.pending(delivery.after_attempts(outbox, results), 9).collect()}
    assert kept == {2, 3}


def test_tick_evaluates_the_oldest_that_wait(spark):
    rows = turns(spark, [{"turn_id": t, "revision": 1, "answer_markdown": "x", "occurred_at": datetime(2024, 1, d)} for t, d in (("a", 3), ("b", 1), ("c", 2))])
    done = spark.createDataFrame([("b", 1)], "turn_id string, revision int")
    assert [r["turn_id"] for r in delivery.evaluation_tick(rows, done, 1).collect()] == ["c"]


def test_unread_notices(spark):
    notices = spark.createDataFrame([(1, "o"), (2, "o"), (3, "p"), (4, "o")], "id long, owner string")
    acks = spark.createDataFrame([(2, "o"), (4, "p")], "id long, owner string")
    assert [r["id"] for r in delivery.unread(notices, acks, "o").collect()] == [1, 4]
    assert [r["id"] for r in delivery.unread(notices, acks, "o", 1).collect()] == [4]
