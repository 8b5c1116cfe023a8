"""Past records meet queries where they are read: no pair of terms is formed, and few pairs are aligned."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from caselight.functions import text as T
from caselight.operators import evidence, past_records
from tests.test_exact_ranks import history, plain_best, plain_terms

ODD = ["", " - ", "Подтема запроса: УПД и ЁЛКА", "a  b\tc;ночь ночью", "İstanbul ſ K ΑΣ", "x😀y é1ё2", "упдукд МЧД мчд12 не об", "подписание подписать abcdefgh 12345678", "подтема запроса : что", "я", "Ёё ЁЖ"]


def test_words_terms_and_lengths_are_those_of_the_columns(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "i int, t string").orderBy("i").coalesce(1)
    rows = df.select(T.history_plain(F.col("t")).alias("plain"), F.length(T.history_form(F.col("t"))).alias("n"), T.history_form(F.col("t")).alias("form"), F.array_distinct(T.history_terms(F.col("t"))).alias("terms")).collect()
    asked = past_records.Asked(pa.table({"query": ODD, "q_form": [r["form"] for r in rows], "q_terms": pa.array([r["terms"] for r in rows], pa.list_(pa.string()))}))
    held = past_records.Records(pa.array([r["plain"] for r in rows]), asked)
    assert held.lengths.tolist() == [r["n"] for r in rows]
    assert held.sizes.tolist() == [len(r["terms"]) for r in rows]
    shared = asked.shared(held.rows, held.places, len(rows))
    assert shared.tolist() == [[len(set(a["terms"]) & set(b["terms"])) for b in rows] for a in rows]


@pytest.mark.parametrize(("pairs", "queries"), [(30, 5), (400_000, 1_000)])
def test_slices_blocks_copies_and_equal_queries(spark, monkeypatch, pairs, queries):
    monkeypatch.setattr(evidence, "MEET_PAIRS", pairs)
    monkeypatch.setattr(evidence, "QUERY_SLICE", queries)
    rng = random.Random(7)
    words = ["портал", "подписать", "контракт", "загрузка", "a1", "оферта", "статус", "карта", "дом", "xml", "не", "Ёж"]
    said = lambda: " ".join(rng.choices(words, weights=range(1, 13), k=rng.choice([1, 2, 3, 5, 8, 30])))
    records = [(i, said()) for i in range(150)] + [(150 + i, "xml дом") for i in range(40)] + [(-i, "XML, дом!") for i in range(1, 6)]
    rng.shuffle(records)
    asked = [(i, said()) for i in range(9)] + [(20, "xml дом"), (21, "xml дом"), (22, "нет такого слова"), (23, None)]
    got = history(spark, asked, records)
    for i, text in asked:
        want = plain_best(text, records) if text else []
        assert [(r["item_id"], r["score"]) for r in got[i]] == want, text


def test_no_terms_are_joined_and_no_texts_are_shuffled(spark, capsys):
    asked = spark.createDataFrame([(1, "create a new document on the portal"), (2, "delete the old document")], "query_id long, text string")
    lines = spark.range(400).select(F.col("id").alias("item_id"), F.col("id").alias("order"), F.concat(F.lit("document number "), F.col("id").cast("string"), F.lit(" on the portal")).alias("text"))
    evidence.history_matches(asked, lines).explain()
    plan = capsys.readouterr().out
    assert "explode(s_terms" not in plan and "explode(q_terms" not in plan
    assert "parquet" not in plan and "hashpartitioning(mark" not in plan  # texts are neither written nor dealt


def test_few_pairs_are_aligned(monkeypatch):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(words, k=12)) for _ in range(2_000)]
    query = texts[77]
    queries = pa.table({"query": [query], "q_form": [query], "q_terms": pa.array([list(dict.fromkeys(plain_terms(query)))], pa.list_(pa.string()))})
    batch = pa.RecordBatch.from_pydict({"item_id": list(range(2_000)), "order": list(range(2_000)), "text": texts, "plain": texts})
    want = plain_best(query, list(enumerate(texts)))
    near = pa.Table.from_batches(past_records.near_pairs(queries, np.array([want[-1][1]]), 3, 5_000)(iter([batch])))
    assert {o for o, _ in want} <= set(near["order"].to_pylist()) and near.num_rows < 200
    near = near.sort_by([("most", "descending")])
    near = near.append_column("q_form", pa.array([query] * near.num_rows)).append_column("s_form", near["text"])
    calls = []
    plainly = past_records.SequenceMatcher
    monkeypatch.setattr(past_records, "SequenceMatcher", lambda *a: calls.append(a) or plainly(*a))
    found = pa.Table.from_batches(past_records.aligned(3)(iter(near.to_batches())))
    assert {o for o, _ in want} <= set(found["order"].to_pylist())
    assert len(calls) < 50  # of 2,000 that share a term


def test_nothing_asked_and_nothing_held(spark):
    assert history(spark, [(1, "не об"), (2, "")], [(1, "не об"), (2, "портал")]) == {}
    assert history(spark, [(1, None)], [(1, "портал")]) == {}
    assert history(spark, [(1, "портал")], [(1, None), (2, ""), (3, "?!")]) == {}
    assert [(r["item_id"], r["score"]) for r in history(spark, [(1, "портал")], [(1, "портал")])[1]] == [(1, 1.0)]


def test_pairs_of_one_query_are_aligned_in_many_partitions(spark):
    asked = spark.createDataFrame([(1, "of of of of")], "query_id long, text string")
    lines = spark.range(3000).select(F.col("id").alias("item_id"), F.col("id").alias("order"), F.concat(F.lit("of "), F.col("id").cast("string")).alias("text"))
    found = evidence.history_matches(asked, lines)
    dealt = found._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [query" in dealt and f", {evidence.ALIGN_PARTS}" in dealt and ", text#" in dealt.split("RepartitionByExpression [")[1].split("]")[0]
    assert [(r["item_id"], r["score"]) for r in found.orderBy("rank").collect()] == plain_best("of of of of", [(i, f"of {i}") for i in range(3000)])
