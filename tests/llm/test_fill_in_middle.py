"""Cuts through checkpoints against plain lists of units, round trips, and the edges."""

from __future__ import annotations

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from caselight.llm import fill_in_middle as fim

from .test_edges import SCHEMA, TEXTS, docs

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
PIECES = st.lists(st.sampled_from(["a", "bc", " ", "\n", "\x0b", "é", "😀", " ", "<", "word", "<P", ">"]), max_size=400).map("".join)


@settings(max_examples=150, deadline=None)
@given(PIECES)
def test_checkpoints_are_the_ends_of_units(text):
    units = UNITS.findall(text)
    points = fim.Checkpoints(text)
    assert points.units == len(units)
    for n in range(len(units) + 1):
        before = "".join(units[:n])
        assert points.after_units(n) == (len(before), len(before.encode()))
        assert points.units_before(len(before)) == n


def by_hand(doc_id, text):
    units = UNITS.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    one, two, drawn, order = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or drawn % 100 >= 50:
        return len(units), "plain", None, None, text
    a, b = sorted((one % (len(units) + 1), two % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if order % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("extra", [False, True])
def test_forms_and_round_trip(spark, extra):
    rows = TEXTS + [(20 + k, f" a<P text{k}  of é😀 words\n<S and < more \n") for k in range(30)] + [(60 + k, f"has a <M> {k}") for k in range(4)] + [(70, "w " * 200_000)]
    found = fim.fill_in_middle(docs(spark, rows, extra))
    back = found.select("*", fim.restored(found["output"], found["form"]).alias("back")).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[-1])
    got = sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["back"]) for r in back), key=key)
    want = sorted(((i, *by_hand(i, t or ""), t or "") for i, t in rows), key=key)
    assert got == want
    assert {"plain", "psm", "spm"} <= {r[2] for r in got}


def test_no_rows(spark):
    assert fim.cut_digests(spark.createDataFrame([], SCHEMA)).count() == 0
