from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from caselight.functions import models
from caselight.functions import text as T
from caselight.operators import cases, evidence
from caselight.sources import tables

from .test_operators import workbook


def test_backfill_embeds_what_is_missing(spark):
    fragments = spark.createDataFrame([("a", "one two"), ("b", "one two"), ("c", None)], "fragment_id string, text string")
    stored = spark.createDataFrame([("a", "r1"), ("b", "r0")], "fragment_id string, model_revision string")
    got = {r["fragment_id"]: r["embedding"] for r in models.backfill(fragments, stored, "r1").collect()}
    assert set(got) == {"b", "c"} and sum(x * x for x in got["b"]) == pytest.approx(1) and set(got["c"]) == {0.0}


def test_rerank_needs_finite_scores(spark):
    df = spark.createDataFrame([("a b", "b c"), ("", "x")], "q string, t string")
    assert [r[0] for r in df.select(models.rerank_score(F.col("q"), F.col("t"))).collect()] == [0.5, 0.0]
    with pytest.raises(Exception, match="finite"):
        df.select(models.rerank_score(F.col("q"), F.col("t"), lambda q, t: [float("nan")] * len(q))).collect()


def test_extractive_draft(spark):
    df = spark.createDataFrame([("where is the key", "The door is open. The key is below the mat.")], "q string, s string")
    assert df.select(models.draft(F.col("q"), F.col("s"))).first()[0] == "The key is below the mat."


def test_query_entities(spark):
    df = spark.createDataFrame([("УПД ошибка RDIK_77 код 12 и x-5, УПД",)], "t string")
    got = [tuple(x) for x in df.select(T.query_entities(F.col("t"))).first()[0]]
    assert got == [("document_abbreviation", "УПД"), ("exact_code", "RDIK_77"), ("numeric_identifier", "12"), ("exact_code", "x-5")]
    assert df.select(T.exact_codes(F.col("t"))).first()[0] == ["УПД", "RDIK_77", "12", "x-5"]


NOTHING = dict.fromkeys(("role", "process", "provider", "document_status", "error_code", "document_type", "attempted_action", "duration_minutes", "category_id", "model"))
CONTEXTS = [
    ("Поставщик: уже пробовали исправить УПД в ЕИС, прошло 2 часа", {"role": "supplier", "process": "UPD correction", "provider": "EIS", "document_type": "UPD", "attempted_action": "already tried", "duration_minutes": 120.0}),
    ("как загрузить УПД", {"process": "UPD execution", "document_type": "UPD"}),
    ("какой тип документа УКД выбрать", {"process": "contract execution", "document_type": "UKD"}),
    ("добавление исполнения заказчиком, статус неизвестен", {"process": "contract execution", "role": "customer", "document_status": "present", "document_type": "STE"}),
    ("МЧД для пользователя, документ на подписи", {"process": "MCD management", "role": "supplier user", "document_type": "MCD", "document_status": "На подписи"}),
    ("МЧД заказчика", {"process": "MCD management", "document_type": "MCD"}),
    ("администратор, код RDIK-77 и модель", {"role": "company administrator", "error_code": "RDIK-77", "model": "present"}),
    ("ошибка рдик42 в категории 815", {"error_code": "рдик42", "category_id": "815"}),
    ("загрузка оферты на портале поставщиков не помогла", {"process": "offer import", "role": "supplier", "provider": "Supplier Portal", "attempted_action": "already tried"}),
    ("моя оферта", {"process": "offer/STE"}),
    ("прайс", {"process": "YML import"}),
    ("nothing", {}),
]


def test_context(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CONTEXTS)], "i int, t string")
    rows = df.orderBy("i").select(*[c.alias(n) for n, c in T.context(F.col("t"), ("Подписан", "На подписи")).items()]).collect()
    for row, (text, said) in zip(rows, CONTEXTS, strict=True):
        assert row.asDict() == NOTHING | said, text


def test_claims_keep_to_their_evidence(spark):
    """Conditions, quotes and references have to stand in the evidence; blank fragments do not count."""
    schema = "claim_id string, text string, fragment_ids array<string>, applies_if array<string>, evidence_quote string, evidence_reference string"
    text = "Договор подписывает администратор"
    rows = [
        ("all", text, ["b", "a", "blank"], ["роль Поставщик"], "подписывает\nроль", "пункт 7"),
        ("order", text, ["a", "b"], None, "подписывает\nроль", None),
        ("condition", text, ["a", "b"], ["роль поставщик", "роль заказчик"], None, ""),
        ("reference", text, ["a", "b"], [], "договор", "пункт 8"),
        ("none", text, ["a", "b"], None, None, None),
    ]
    fragments = spark.createDataFrame([("a", "роль поставщик, пункт 7"), ("b", "Администратор договор подписывает"), ("blank", " ")], "fragment_id string, text string")
    got = {r["claim_id"]: r["reasons"] for r in evidence.verify_claims(spark.createDataFrame(rows, schema), fragments).collect()}
    assert got == {"all": "", "order": "QUOTE_NOT_IN_EVIDENCE", "condition": "APPLICABILITY_DROPPED", "reference": "REFERENCE_NOT_IN_EVIDENCE", "none": ""}


def test_history_form_and_contradiction(spark):
    df = spark.createDataFrame([("Подтема запроса: Ошибка УПД, ещё!", "можно", "нельзя")], "t string, a string, b string")
    row = df.select(T.history_form(F.col("t")), T.contradict(F.col("a"), F.col("b")), T.contradict(F.col("a"), F.col("a"))).first()
    assert tuple(row) == ("ошибка upd еще", True, False)


def test_names_and_provenance(spark):
    df = spark.createDataFrame([(["Role", "a"], ["role", "B", "A"], {"trace_id": "1", "cookie": "2"})], "x array<string>, y array<string>, m map<string,string>")
    row = df.select(cases.union_of_names(F.col("x"), F.col("y")), cases.provenance(F.col("m"))).first()
    assert tuple(row) == (["Role", "a", "B"], {"trace_id": "1"})


def test_card_audit(spark):
    schema = "card_id string, version string, source_fragment_ids array<string>, source_quotes array<string>, required_slots array<string>"
    cards = spark.createDataFrame([("ok", "1", ["f"], ["Text"], ["role"]), ("bad", "1", ["f", "h", "x"], ["no"], ["odd"]), ("bare", "1", None, None, None)], schema)
    fragments = spark.createDataFrame([("f", "some text", "NORMATIVE"), ("h", "old", "HISTORICAL")], "fragment_id string, text string, corpus string")
    got = {r["card_id"]: r["issues"] for r in evidence.audit_cards(cards, fragments, ("role",)).collect()}
    assert got == {"ok": [], "bad": ["UNKNOWN_SOURCE", "FOREIGN_CORPUS", "QUOTE_NOT_IN_SOURCE", "UNKNOWN_SLOT"], "bare": ["NO_SOURCE"]}


def test_history_gate(spark):
    rows = [(1, 5, 0.9, True, True), (1, 6, 0.9, False, True), (2, 7, 0.8, True, False), (3, 8, 0.9, False, True)]
    df = spark.createDataFrame(rows, "query_id int, item_id int, score double, strong boolean, verified boolean")
    got = {r["query_id"]: (r["sufficiency"], r["item_id"]) for r in evidence.history_gate(df).collect()}
    assert got == {1: ("SUFFICIENT", 5), 2: ("INSUFFICIENT", None), 3: ("INSUFFICIENT", None)}


def test_support_export(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbook())
    rows = tables.load_support_export(spark, str(tmp_path), "Q", "A", "T", "S").collect()
    assert [(r["source_row"], r["question"], r["solution"], r["topic"], r["redactions"]) for r in rows] == [(2, "why?", "5", None, 0)]
