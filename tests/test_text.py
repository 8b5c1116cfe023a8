from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from caselight.functions import ids, similarity
from caselight.functions import text as T


def one(spark, column, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "rule"), [("сук4", "PROFANITY_005"), ("с.у.к.а", "PROFANITY_005"), ("сууука", "PROFANITY_005"), ("ебитда растет", None), ("дурман", None), ("тупик", None), ("тупой баг", "PROFANITY_A03"), ("идиотский", "PROFANITY_A02"), ("хлеб", None), ("рубля", None)])
def test_moderation_rules(spark, text, rule):
    assert one(spark, T.moderation_rule(T.moderation_form(F.col("c0"))), text) == rule


def test_moderation_form_keeps_word_bounds(spark):
    assert one(spark, T.moderation_form(F.col("c0")), "  Cyka,   блин!! ") == "сука блин "


def test_redaction_in_order(spark):
    text = "Пишите на a.b@mail.ru или +7 (999) 123-45-67, ИНН: 7701234567, заявитель: Иванов Иван, номер 123456789"
    assert one(spark, T.redact(F.col("c0")), text) == "Пишите на [EMAIL] или [PHONE], [IDENTIFIER], [PERSON], номер [IDENTIFIER]"
    assert one(spark, T.redaction_count(F.col("c0")), text) == 5


def test_case_titles(spark):
    assert one(spark, T.case_title(F.col("c0")), "раз два") == "раз два"
    assert one(spark, T.case_title(F.col("c0")), "one two three four five six seven") == "one two three four five six…"
    assert one(spark, T.case_title(F.col("c0")), "a" * 50) == "a" * 36 + "…"
    assert one(spark, T.case_title(F.col("c0")), "somewhat longer words stand in this headline") == "somewhat longer words stand in this…"


def test_question_key(spark):
    assert one(spark, T.normalize_question(F.col("c0")), "  Где   Договор?! . ") == "где договор"


@pytest.mark.parametrize(("text", "minutes"), [("жду 30 секунд", 0.5), ("жду 2 часа", 120.0), ("1,5 дня", 2160.0), ("прошло больше часа", 61.0), ("нет", None)])
def test_durations(spark, text, minutes):
    assert one(spark, T.duration_minutes(F.col("c0")), text) == minutes


def test_human_request_is_not_a_provider(spark):
    assert one(spark, T.asks_for_human(F.col("c0")), "позовите специалиста")
    assert one(spark, T.asks_for_human(F.col("c0")), "нужен оператор")
    assert not one(spark, T.asks_for_human(F.col("c0")), "оператор ЭДО не отвечает")


def test_thoughts_have_to_pair(spark):
    assert one(spark, T.without_thoughts(F.col("c0")), "<think>a</think> b") == "b"
    assert one(spark, T.without_thoughts(F.col("c0")), "<think>a b") is None


def test_ids_agree_in_tasks_and_on_the_driver(spark):
    got = one(spark, ids.prefixed_id("doc", "document", F.col("c0")), 'Файл "1".pdf')
    assert got == "doc_" + ids.digest("document", 'Файл "1".pdf')[:32]


def test_snapshot_id_ignores_order_and_repeats():
    assert ids.snapshot_id("NORMATIVE", ["b", "a", "b"]) == ids.snapshot_id("NORMATIVE", ["a", "b"])


def test_text_hash_and_repair(spark):
    assert one(spark, ids.text_hash(F.col("c0")), " е́\r\n") == ids.text_digest("е́")
    assert one(spark, ids.repaired(F.col("c0")), "тест".encode().decode("cp1251")) == "тест"
    assert one(spark, ids.repaired(F.col("c0")), "тест") == "тест"


def test_word_similarity_finds_typos():
    assert similarity.word_similarity_of("konsole", "the console window") > 0.3
    assert similarity.word_similarity_of("word", "two words") >= 0.8
    assert similarity.word_similarity_of("", "x") == 0.0


def test_wire_names(spark):
    assert one(spark, T.wire_name(F.col("c0")), "AnswerAndHandoff") == "ANSWER_AND_HANDOFF"


def test_source_names(spark):
    assert one(spark, T.source_name(F.col("c0")), "a\\.\\b//c.pdf") == "a/b/c.pdf"
