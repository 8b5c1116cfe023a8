"""The state machine of cases against a fold in plain Python, over files that come one by one."""

from __future__ import annotations

import random
from datetime import UTC, datetime, timedelta

from pyspark.sql import functions as F

from caselight.streaming import machine
from caselight.streaming.runs import run_once

BEGIN = datetime(2024, 1, 1, tzinfo=UTC)
SCHEMA = "case_id long, event_id long, at timestamp, command string, target long"


def folded(rows, ttl_ms, now):
    """Outcomes of (ms, event_id, case, command, target) up to a time."""
    out, cases = [], {}

    def expire(case, at):
        s = cases[case]
        if s["open"] and s["opened"] + ttl_ms <= at:
            s["open"] = False
            out.append((case, s["turn"], s["revision"], "STALE"))

    for ms, event_id, case, command, target in sorted(r for r in rows if r[0] < now):
        s = cases.setdefault(case, {"revision": 0, "open": False, "closed": False, "opened": 0, "turn": 0})
        expire(case, ms)
        outcome = "IGNORED"
        if command == "START" and s["closed"]:
            outcome = "REJECTED"
        elif command == "START":
            if s["open"]:
                out.append((case, s["turn"], s["revision"], "SUPERSEDED"))
            s.update(revision=s["revision"] + 1, open=True, opened=ms, turn=event_id)
            outcome = "STARTED"
        elif command == "COMPLETE":
            outcome = "IGNORED" if s["closed"] else "COMPLETED"
            s["closed"] = True
        elif s["open"] and target == s["revision"]:
            s["open"], outcome = False, {"PUBLISH": "PUBLISHED", "FAIL": "FAILED"}[command]
        out.append((case, event_id, s["revision"], outcome))
    for case in cases:
        expire(case, now - 1)
    return sorted(out)


def run(spark, tmp_path, files, ttl_minutes):
    for k, rows in enumerate(files):
        table = spark.createDataFrame([(c, e, BEGIN + timedelta(milliseconds=ms), cmd, t) for ms, e, c, cmd, t in rows], SCHEMA)
        table.coalesce(1).write.mode("append").parquet(str(tmp_path / f"part{k:02}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/part*")
    found = run_once(machine.case_machine(stream, ttl_minutes, "1 hour"), state_store=machine.ROCKS)
    return sorted((r["case_id"], r["event_id"], r["revision"], r["outcome"]) for r in found.select(F.col("*")).collect())


def drawn(n, cases, step_ms, seed):
    draw = random.Random(seed)
    kinds = ["START"] * 4 + ["PUBLISH"] * 4 + ["FAIL"] * 2
    rows, revisions = [], [0] * cases
    for e in range(n):
        case, command = draw.randrange(cases), draw.choice(kinds)
        revisions[case] += command == "START"
        rows.append((e * step_ms + draw.randrange(step_ms), e, case, "COMPLETE" if draw.random() < 1 / n else command, max(0, revisions[case] - (draw.random() < 0.3))))
    return rows


def test_out_of_order_files(spark, tmp_path):
    """Rows of a file come shuffled, and some in the next file; the watermark waits for them."""
    rows = drawn(600, 5, 60_000, 3)
    draw = random.Random(4)
    files = [[], [], []]
    for k, row in enumerate(rows):
        files[min(2, k // 200 + (k % 200 > 180 and draw.random() < 0.5))].append(row)
    for part in files:
        draw.shuffle(part)
    got = run(spark, tmp_path, files, 5)
    assert got == folded(rows, 300_000, max(r[0] for r in rows) - 3_600_000)
    assert {o for *_, o in got} >= {"STARTED", "PUBLISHED", "FAILED", "SUPERSEDED", "STALE", "IGNORED"}


def test_one_case_with_more_rows_than_an_arrow_batch(spark, tmp_path):
    rows = drawn(50_000, 1, 1_000, 5)
    shuffled = list(rows)
    random.Random(6).shuffle(shuffled)
    assert run(spark, tmp_path, [shuffled], 1) == folded(rows, 60_000, max(r[0] for r in rows) - 3_600_000)
