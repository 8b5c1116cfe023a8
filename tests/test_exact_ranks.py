"""Past records, percentiles and vectors against plain versions over all pairs."""

from __future__ import annotations

import random
import re
from collections import defaultdict
from decimal import ROUND_HALF_EVEN, Decimal
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from caselight import plans
from caselight.operators import evidence, ranking, retrieval
from caselight.sources.tables import table
from caselight.streaming import runs

ASK = "Подтема запроса: Как подписать УПД на портале поставщиков?"
RECORDS = [
    "Чтобы подписать УПД на портале поставщиков, откройте личный кабинет и нажмите кнопку подписания",
    "Чтобы подписать УПД на портале поставщиков, откройте личный кабинет и нажмите кнопку подписания",
    "УПД подписать портал",
    "упд",
    "Подписать нельзя",
    "",
    None,
    "погода сегодня хорошая",
]


def plain_terms(text: str) -> list[str]:
    return [t[:6] if not t.isascii() and len(t) >= 6 else t for t in plain_form(text).split() if len(t) >= 2 and t not in evidence.T.HISTORY_STOP_WORDS]


def plain_form(text: str) -> str:
    out = re.sub(r"(?i)^\s*подтема\s+запроса\s*:\s*", "", (text or "").replace("ё", "е").replace("Ё", "е").lower())
    for name, latin in evidence.T.HISTORY_NAMES:
        out = out.replace(name, latin)
    return " ".join(re.findall("[a-zа-яё0-9]+", out))


def plain_best(query: str, records: list[tuple], best: int = 3) -> list[tuple]:
    found = []
    for order, text in records:
        q, s = set(plain_terms(query)), set(plain_terms(text))
        if not q & s:
            continue
        contained, alike = len(q & s) / min(len(q), len(s)), len(q & s) / len(q | s)
        sequence = SequenceMatcher(None, plain_form(query), plain_form(text)).ratio()
        score = Decimal(repr(0.5 * contained + 0.25 * alike + 0.25 * sequence)).quantize(Decimal("0.000001"), ROUND_HALF_EVEN)
        found.append((-float(score), order))
    return [(order, -score) for score, order in sorted(found)[:best]]


def history(spark, queries, records):
    asked = spark.createDataFrame(queries, "query_id long, text string")
    held = spark.createDataFrame(records, "item_id long, text string").withColumn("order", F.col("item_id"))
    out = defaultdict(list)
    for r in evidence.history_matches(asked, held).orderBy("query_id", "rank").collect():
        out[r["query_id"]].append(r)
    return out


def test_history_matches_fixture(spark):
    got = history(spark, [(1, ASK), (2, ""), (3, None)], list(enumerate(RECORDS)))
    assert set(got) == {1}
    assert [(r["item_id"], r["score"]) for r in got[1]] == plain_best(ASK, list(enumerate(RECORDS)))
    strong = {r["item_id"]: r["strong"] for r in got[1]}
    assert strong == {0: True, 1: True, 2: False}  # the third says too little to be a solution


def test_history_of_denied_or_foreign_matter_is_not_strong(spark):
    text = "Можно подписать УПД на портале поставщиков и отправить документ"
    denied = "Нельзя подписать УПД на портале поставщиков и отправить документ"
    foreign = "большая красная машина стоит возле старого дома"
    got = history(spark, [(1, text), (2, foreign)], [(1, denied), (2, text), (3, foreign)])
    assert {r["item_id"]: r["strong"] for r in got[1]} == {1: False, 2: True}
    assert [(r["score"], r["strong"]) for r in got[2]] == [(1.0, False)]


def test_history_matches_all_pairs(spark):
    rng = random.Random(3)
    words = ["портал", "подписать", "контракт", "загрузка", "a1", "оферта", "статус", "карта", "дом", "xml"]
    said = lambda: " ".join(rng.choices(words, weights=range(1, 11), k=rng.choice([1, 2, 3, 5, 8, 40])))
    records = [(i, said()) for i in range(300)] + [(300 + i, "xml дом") for i in range(50)]
    queries = [(i, said()) for i in range(12)]
    got = history(spark, queries, records)
    for i, text in queries:
        assert [(r["item_id"], r["score"]) for r in got[i]] == plain_best(text, records), text


def test_history_query_scores_all_lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").collect()
    records = [((d["doc_id"], i), line) for d in docs for i, line in enumerate((d["text"] or "").split("\n"))]
    some = {r["item_id"]: r["text"] for r in table(spark, sf_dir, "benchmark").orderBy("item_id").limit(3).collect()}
    rows = plans.QUERIES["historical_match"](spark, sf_dir).where(F.col("query_id").isin(*some)).orderBy("query_id", "rank").collect()
    for i, text in some.items():
        want = [(f"{o[0]}:{o[1]}", s) for o, s in plain_best(text, records)]
        assert [(r["line_id"], r["score"]) for r in rows if r["query_id"] == i] == want


@pytest.mark.parametrize("narrow", [0, 1_000_000])
def test_nearest_rank_either_way(spark, narrow):
    rng = random.Random(5)
    groups = {"many": [rng.gauss(0, 1) for _ in range(30_000)], "same": [1.5] * 20_000, None: [float(i % 7) for i in range(25_000)]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("many", None), ("void", None)]
    got = ranking.nearest_rank(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", (1, 50, 95), narrow).collect()
    assert {r["g"] for r in got} == set(groups)
    for r in got:
        ordered = sorted(groups[r["g"]])
        want = [round(ordered[round(p / 100 * (len(ordered) - 1))], 3) for p in (1, 50, 95)]
        assert r["n_values"] == len(ordered) and [r["p1"], r["p50"], r["p95"]] == pytest.approx(want, abs=1e-9)


def test_nearest_rank_of_few(spark):
    rows = [(n, float(i)) for n in range(1, 40) for i in range(n)]
    for r in ranking.nearest_rank(spark.createDataFrame(rows, "g long, v double"), ["g"], "v", (5, 50, 95)).collect():
        assert [r[f"p{p}"] for p in (5, 50, 95)] == [round(p / 100 * (r["g"] - 1)) for p in (5, 50, 95)]


@pytest.mark.parametrize("limit", [0, 64 << 20])
def test_dense_topk_with_odd_vectors(spark, monkeypatch, limit):
    monkeypatch.setattr(retrieval, "BROADCAST_BYTES", limit)
    rng = np.random.default_rng(1)
    held = {i: rng.normal(size=4).tolist() for i in range(40)}
    rows = [*held.items(), (50, [0.0] * 4), (51, None), (52, []), (53, [1.0, None, 1.0, 1.0]), (54, [1.0, 2.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = vectors.where("vec_id < 5 or vec_id > 50").selectExpr("vec_id as query_id", "embedding as query")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["similarity"]) for r in retrieval.dense_topk(asked, vectors, 3, block=7).collect()}
    for q in range(5):
        cos = lambda v: round(float(np.dot(held[q], v) / (np.linalg.norm(held[q]) * np.linalg.norm(v) or 1)), 5)  # noqa: E731, B023
        best = sorted((-cos(v), i) for i, v in [*held.items(), (50, [0.0] * 4)] if i != q)[:3]
        assert [got[q, n + 1] for n in range(3)] == [(i, pytest.approx(-c, abs=2e-5)) for c, i in best]
    assert {q for q, _ in got} == set(range(5))


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master, applicationId = "spark://somewhere:7077", "app"

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda name, default: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        runs.shared_folder(Session(), "x")
