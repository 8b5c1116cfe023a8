"""Components by the join against all pairs of sets, and the edges."""

from __future__ import annotations

import random
import re
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from caselight.llm import jaccard_join as jj
from caselight.llm import registry
from caselight.llm.common import table

from .test_edges import SCHEMA, TEXTS, docs

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_hand(rows):
    """Sets of shingles as texts, all pairs of different sets, and a union by links."""
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
        sets.append(frozenset(" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))) if words else frozenset())
    distinct = sorted(set(sets) - {frozenset()}, key=len)
    root = {s: s for s in distinct}

    def top(s):
        while root[s] is not s:
            s = root[s]
        return s

    holders = {}
    for s in distinct:
        for x in s:
            holders.setdefault(x, []).append(s)
    pairs = {frozenset((id(a), id(b))): (a, b) for held in holders.values() for a, b in combinations(held, 2)} if len(distinct) > 400 else {k: p for k, p in enumerate(combinations(distinct, 2))}
    for a, b in pairs.values():
        if 100 * len(a & b) >= 85 * len(a | b):
            root[top(a)] = top(b)
    least = {}
    for (i, _), s in zip(rows, sets, strict=True):
        if s and i is not None:
            least[top(s)] = min(i, least.get(top(s), i))
    return [(i, len(s), least.get(top(s)) if s else i) for (i, _), s in zip(rows, sets, strict=True)]


def in_order(rows):
    return sorted(map(tuple, rows), key=str)


def test_query_by_all_pairs(spark, sf_dir):
    rows = [tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    got = registry.QUERIES["op13_ngram_jaccard_join"](spark, sf_dir)
    assert in_order(got.select("doc_id", "n_shingles", "component_id").collect()) == in_order(by_hand(rows))


def near_copies(seed, groups=12, copies=9):
    """Groups of texts from a small vocabulary, with one to a few words changed, in chains and stars."""
    draw = random.Random(seed)
    rows = []
    for g in range(groups):
        size = draw.choice([4, 9, 10, 12, 30, 80, 200])
        words = [draw.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(draw.randrange(12)) for _ in range(size)]
        for _ in range(copies):
            own = list(words)
            for _ in range(draw.randrange(0, 1 + size // 25 + 1)):
                own[draw.randrange(size)] = f"w{draw.randrange(40)}"
            if draw.random() < 0.5:
                words = own  # a chain: far ends may be no link
            rows.append((len(rows) * 7 % 1009, " ".join(own).upper() if draw.random() < 0.3 else "  ".join(own)))
    return rows


@pytest.mark.parametrize(("seed", "large", "part"), [(1, None, None), (2, 1, None), (3, 10**9, None), (4, 15, None), (5, 15, 3)])
def test_near_copies(spark, monkeypatch, seed, large, part):
    """Whatever the boundary, and however small the parts of a bucket."""
    if large:
        monkeypatch.setattr(jj, "boundary", lambda sets: min(large, 120))
    if part:
        monkeypatch.setattr(jj.members, "__defaults__", (part,))
    rows = near_copies(seed)
    found = in_order(jj.jaccard_components(docs(spark, rows)).collect())
    want = in_order(by_hand(rows))
    assert found == want
    assert len({r[2] for r in want}) < len(want)


@pytest.mark.parametrize("extra", [False, True])
def test_edges(spark, extra):
    rows = TEXTS + [(40, "Same WORDS here in this text"), (41, "same words HERE in this text"), (None, "no id one two three"), (None, "no id one two three"), (42, "one two"), (43, "ONE  two"), (44, "one")]
    assert in_order(jj.jaccard_components(docs(spark, rows, extra)).collect()) == in_order(by_hand(rows))
    assert jj.jaccard_components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_boundary_weighs_costs(spark):
    """Long lists push small sets to subsets; short lists leave all sets in lists."""
    sets = spark.range(100).select(F.col("id"), (F.col("id") % 3 * 20 + 10).alias("n"))
    assert jj.boundary(sets.withColumn("list_cost", F.lit(1.0))) == 1
    assert jj.boundary(sets.withColumn("list_cost", F.lit(1e9))) == 51
    # up to 10 shingles three pairs are listed, up to 30 fifteen: a cost between them parts the sizes
    assert jj.boundary(sets.withColumn("list_cost", F.lit(4.0))) == 11
