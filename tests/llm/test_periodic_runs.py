"""Runs found by refinement against a search of every period, and the query against the contract written out."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from caselight.llm import periodic_runs as pr
from caselight.llm import registry
from caselight.llm.common import table

from .test_edges import SCHEMA, TEXTS, docs


def every_period(words, least=12):
    """All maximal runs, by trying each period in turn; a multiple of a smaller period of the same stretch is none."""
    found, seen = [], set()
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= 2 * q and not any((s <= i and i + length <= s + n) and q % p == 0 for s, n, p in seen):
                seen.add((i, length, q))
                if length >= least:
                    found.append((i, length, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


REPEATS = st.tuples(st.lists(st.sampled_from("abc"), min_size=1, max_size=6), st.integers(1, 8)).map(lambda x: x[0] * x[1])
WORDS = st.lists(REPEATS, max_size=8).map(lambda parts: sum(parts, []))


@settings(max_examples=200, deadline=None)
@given(st.lists(WORDS, min_size=1, max_size=5), st.sampled_from([2, 12]))
def test_runs_by_brute_force(texts, least):
    found = pr.search([" ".join(w) for w in texts], least)
    for words, *got, text in zip(texts, found["starts"], found["lengths"], found["periods"], found["collapsed"], strict=True):
        runs = [tuple(map(int, r)) for r in zip(*got, strict=True)]
        assert runs == every_period(words, least)
        assert text == collapsed(words, runs)


def contract(doc_id, text):
    words = (text or "").encode().split()
    words = [w.decode() for w in words]
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = every_period(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha(listed), sha(collapsed(words, runs)))


def in_order(rows):
    return sorted(map(tuple, rows), key=str)


def test_query_by_the_contract(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").select("doc_id", "text").collect()
    got = in_order(r for r in registry.QUERIES["op11_periodic_runs"](spark, sf_dir).collect())
    short = [r for r in texts if len((r["text"] or "").split()) <= 1500]
    ids = {r["doc_id"] for r in short}
    assert len(got) == len(texts) and len(short) > 0.8 * len(texts)
    assert [r for r in got if r[0] in ids] == in_order(contract(r["doc_id"], r["text"]) for r in short)
    assert sum(r[1] > 0 for r in got) > len(got) // 20


@pytest.mark.parametrize("extra", [False, True])
def test_edges(spark, extra):
    rows = [(i, t) for i, t in TEXTS if len(t or "") < 150_000 and not (t or "").startswith("word word")]
    rows += [(i, "one two three " * 9) for i in (5, 5, None, -4)] + [(i, f"w{i} " + "x y " * 20) for i in range(100, 140)]
    assert in_order(pr.run_digests(docs(spark, rows, extra)).collect()) == in_order(contract(i, t) for i, t in rows)
    assert pr.run_digests(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_texts(spark):
    """A word thirty thousand times, and a period of a third of a hundred thousand words."""
    words = [str(i) for i in range(33_000)]
    text = "start " + " ".join(words * 3) + " end"
    once, thirds = pr.find_runs(docs(spark, [(1, "word " * 30_000), (2, text)])).orderBy("doc_id").collect()
    assert [tuple(r) for r in once["runs"]] == [(0, 30_000, 1)] and once["collapsed"] == "word"
    assert [tuple(r) for r in thirds["runs"]] == [(1, 99_000, 33_000)] and thirds["collapsed"] == "start " + " ".join(words) + " end"
