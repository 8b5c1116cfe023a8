"""Overlapping arrays by all pairs, drafts by their reasons, and baselines of windows."""

from __future__ import annotations

import json
import random
from datetime import UTC, datetime, timedelta

import pytest

from caselight.operators import drafts, overlap
from caselight.streaming import machine
from caselight.streaming.runs import run_once


@pytest.mark.parametrize("least", [1, 2, 4])
def test_overlap_by_all_pairs(spark, least):
    draw = random.Random(least)
    side = lambda first: [(first + i, [draw.choice([0, 0, *range(60)]) for _ in range(draw.randrange(9))] + [None] * (i % 5 == 0)) for i in range(120)]
    left, right = side(0), side(1000)
    frame = lambda rows, name: spark.createDataFrame([*rows, (None, [1, 2, 3, 4]), (-1, None)], f"{name} long, ids array<int>")
    found = overlap.overlap_join(frame(left, "a"), frame(right, "b"), "a", "b", "ids", least)
    held = lambda xs: set(xs) - {None}
    want = {(i, j, n) for i, x in left for j, y in right if (n := len(held(x) & held(y))) >= least}
    assert {tuple(r) for r in found.collect()} == want and want


CLAIM = {"claim_id": "c1", "text": "a text", "fragment_ids": ["f1"]}
DRAFTS = [
    (None, "EMPTY", None),
    (" \n", "EMPTY", None),
    ("{", "INVALID_JSON", None),
    ('{"a": 1, "a": 2}', "INVALID_JSON", None),
    ("[1, 2]", "NOT_AN_OBJECT", None),
    ("null", "NOT_AN_OBJECT", None),
    (json.dumps({"claims": [CLAIM, {**CLAIM, "claim_id": "c2", "evidence_quote": {"x": [[{"Reason_Codes": 1}]]}}]}), "FORBIDDEN_FIELD", None),
    (json.dumps({"other": 1}), "SCHEMA", None),
    (json.dumps({"claims": [{k: v for k, v in CLAIM.items() if k != "text"}]}), "SCHEMA", None),
    (json.dumps({"claims": [{**CLAIM, "fragment_ids": []}]}), "SCHEMA", None),
    (json.dumps({"claims": [CLAIM, {**CLAIM, "claim_id": ""}]}), "SCHEMA", None),
    (json.dumps({"claims": [{**CLAIM, "fragment_ids": ["f1", 2]}]}), "SCHEMA", None),
    (json.dumps({"claims": [{**CLAIM, "claim_id": "c" * 129}]}), "SCHEMA", None),
    (json.dumps({"draft_markdown": None}), "SCHEMA", None),
    (json.dumps({"status_indicator": "CLARIFY"}), "BUSINESS_DECISION", None),
    (json.dumps({"claims": [CLAIM, CLAIM]}), "CLAIM_IDS_NOT_UNIQUE", None),
    (json.dumps({"claims": [CLAIM, {**CLAIM, "claim_id": "c2", "evidence_quote": None, "applies_if": []}]}), None, 2),
    ("```JSON\n" + json.dumps({"claims": [CLAIM], "evidence_status": "partial"}) + "\n``` ", None, 1),
    ("{}", None, 0),
]


def test_drafts(spark):
    raw = spark.createDataFrame([(i, text) for i, (text, _, _) in enumerate(DRAFTS)], "id long, raw string")
    got = {r["id"]: (r["reason"], r["n_claims"]) for r in drafts.checked_drafts(raw, "id", "raw").collect()}
    assert got == {i: (reason, n) for i, (_, reason, n) in enumerate(DRAFTS)}
    assert drafts.checked_drafts(raw.where("false"), "id", "raw").count() == 0


def test_spikes_over_files(spark, tmp_path):
    """A quiet kind with one loud hour; empty hours count as zeros, across batches."""
    begin, draw = datetime(2024, 1, 1, tzinfo=UTC), random.Random(2)
    counts = {h: 0 if h % 7 == 3 else draw.randrange(1, 4) for h in range(60)}
    counts[40] = 30
    for part in range(3):
        rows = [("error", begin + timedelta(hours=h, minutes=m)) for h in range(20 * part, 20 * part + 20) for m in range(counts[h])]
        spark.createDataFrame([*rows, (None, rows[0][1])], "kind string, at timestamp").coalesce(1).write.parquet(str(tmp_path / f"part{part}"))
    stream = spark.readStream.schema("kind string, at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/part*")
    found = run_once(machine.spikes(stream), state_store=machine.ROCKS)
    got = {(r["start_ms"] - int(begin.timestamp() * 1000)) // 3_600_000: r for r in found.collect()}
    assert {h: r["n"] for h, r in got.items()} == {h: n for h, n in counts.items() if n and h < max(got) + 1} and max(got) >= 56
    for h, r in got.items():
        past = [counts[k] for k in range(max(0, h - 24), h)]
        if past:
            mean = sum(past) / len(past)
            deviation = (sum(c * c for c in past) / len(past) - mean**2) ** 0.5
            assert abs(r["mean"] - mean) < 1e-9 and abs(r["deviation"] - deviation) < 1e-6
            assert r["spike"] == (len(past) >= 6 and r["n"] > mean + 2 * deviation)
    assert got[40]["spike"]
