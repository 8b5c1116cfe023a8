"""The term index: stems, gram keys, and pruned searches against scores of all documents."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from caselight.functions.similarity import word_similarity_of
from caselight.operators import term_index

WORDS = [a + b for a in ("inv", "cont", "pay", "sup", "reg") for b in ("oice", "racting", "ments", "plier", "ister", "s")]


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(7)
    return {i: " ".join(draw.choices(WORDS, k=draw.randrange(1, 40)) + [f"code{i % 50}"] * (i % 7 == 0)) for i in range(0, 3000, 3)}


@pytest.fixture(scope="module")
def index(spark, texts):
    rows = [*texts.items(), (None, "a row without an id"), (1, None), (2, "")]
    return term_index.build(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", buckets=4)


def test_stems(spark):
    words = ["contracting", "payments", "договорами", "is", "ring", "поставщиков", "tests"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select(term_index.stem(F.col("w")).alias("s")).collect()
    assert [r["s"] for r in rows] == ["contract", "pay", "договор", "is", "ring", "поставщик", "test"]


def test_blocks_hold_every_posting(spark, index, texts):
    got = {(r["term"], r["doc_id"]): r["tf"] for r in index.postings(index.terms.where("kind = 'simple'").select("term")).collect()}
    want = {}
    for i, text in texts.items():
        for w in text.split():
            want[w, i] = want.get((w, i), 0) + 1
    assert got == want
    assert {r["term"]: r["df"] for r in index.terms.where("kind = 'simple'").collect()} == {t: sum(k == t for k, _ in want) for t, _ in want}


def test_gram_keys_lose_no_similar_term(spark, index):
    asked = ["invoce", "suplier", "code4", "x", "paymnts"]
    terms = [r["term"] for r in index.terms.where("kind = 'simple'").collect()]
    found = term_index.similar_texts(index.grams, spark.createDataFrame([(a,) for a in asked], "query string"))
    got = {(r["query"], r["text"]): r["similarity"] for r in found.collect()}
    assert got == {(a, t): s for a in asked for t in terms if (s := word_similarity_of(a, t)) >= 0.4}
    met = term_index.candidates(index.grams, spark.createDataFrame([(a,) for a in asked], "query string")).count()
    assert len(got) <= met < len(asked) * len(terms)


def test_codes_inside_terms(spark, index):
    found = term_index.containing_texts(index.grams, spark.createDataFrame([("ode4",), ("voi",), ("xyz",), ("ab",)], "code string"))
    assert {tuple(r) for r in found.collect()} == {("ode4", f"code{k}") for k in (4, *range(40, 50))} | {("voi", "invoice")}


def test_pruning_changes_no_row(spark, index, monkeypatch):
    rows = [(1, ["invoice", "code7"], []), (2, ["payments", "supplier"], ["code49"]), (3, ["invoce"], []), (4, ["nothing"], []), (5, ["code21"], ["ode2"]), (6, [], [])]
    asked = spark.createDataFrame(rows, "query_id long, words array<string>, codes array<string>")
    monkeypatch.setattr(term_index, "FIRST_BLOCKS", 2)
    pruned = {tuple(r) for r in term_index.lexical_topk(index, asked, 5).collect()}
    read, all_ = term_index.postings_read(index, asked, 5)
    monkeypatch.setattr(term_index, "FIRST_BLOCKS", 10**6)
    assert pruned == {tuple(r) for r in term_index.lexical_topk(index, asked, 5).collect()}
    assert read < all_ and {r[0] for r in pruned} == {1, 2, 3, 5}
    assert all(r[2] > 0 for r in pruned if r[0] == 5)  # a code comes before everything else
