from __future__ import annotations

import io
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from caselight import schemas
from caselight.functions import ids
from caselight.operators import cases, chunking, evidence, grouping, quality, ranking, retrieval
from caselight.sources import sinks, tables


def turns(spark, rows):
    base = {"case_id": "c", "turn_id": "t", "revision": 1, "answer_markdown": None, "evidence_fragment_ids": None, "error_category": None, "service_need": None, "reason_codes": None, "decision": None}
    names = [x.split()[0] for x in schemas.TURNS.split(", ") if " " in x and not x.startswith(("retrieve", "draft", "verify"))]
    filled = [tuple((base | r).get(n) for n in names) for r in rows]
    return spark.createDataFrame(filled, schemas.TURNS)


def test_rubric_never_turns_missing_into_zero(spark):
    rows = turns(spark, [{"turn_id": "a", "answer_markdown": "x", "evidence_fragment_ids": ["f"]}, {"turn_id": "b", "answer_markdown": " x "}, {"turn_id": "c", "error_category": "TIMEOUT", "evidence_fragment_ids": [" "]}])
    got = {r["turn_id"]: r for r in quality.evaluate_turns(rows).collect()}
    assert [got["a"][d] for d in quality.DIMENSIONS] == ["ONE", "ONE", "TWO", "TWO"]
    assert [got["b"][d] for d in quality.DIMENSIONS] == ["UNKNOWN", "UNKNOWN", "TWO", "ONE"]
    assert [got["c"][d] for d in quality.DIMENSIONS] == ["UNKNOWN", "UNKNOWN", "NOT_APPLICABLE", "NOT_APPLICABLE"]
    assert got["c"]["critical_error"] and got["c"]["critical_error_reason"] == "Pushed error category: TIMEOUT"


def test_group_source_takes_the_first_that_is_not_blank(spark):
    df = spark.createDataFrame([(" ", "E", ["b", " a "], "D"), ("N", "E", None, None), (None, "", ["b", " a "], "D"), (None, None, [" "], "D"), (None, None, None, " ")], "n string, e string, r array<string>, d string")
    source, value = quality.group_source(F.col("n"), F.col("e"), F.col("r"), F.col("d"))
    got = [tuple(r) for r in df.select(source, value).collect()]
    assert got == [("error_category", "E"), ("service_need", "N"), ("reason_code", "a|b"), ("decision_label", "D"), ("unclassified", "UNCLASSIFIED")]


def test_issue_groups_do_not_depend_on_order(spark):
    rows = [("k", "s", "v", i % 4) for i in range(9)] + [("one", "s", "w", 1)]
    signals = spark.createDataFrame([(0, 2, True), (1, 0, False)], "case_id long, negative long, unresolved boolean")
    out = []
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "group_key string, group_source string, group_value string, case_id long")
        out.append([tuple(r) for r in quality.issue_groups(df, signals).collect()])
    assert out[0] == out[1] == [("k", "s", "v", 9, 4, 2, 1, "0,1,2")]


def test_intake_and_sinks(spark, tmp_path):
    stored = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    incoming = spark.createDataFrame([("a", 1), ("b", 3), ("c", 4)], "k string, v int")
    got = {r["k"]: r["status"] for r in sinks.intake(stored, incoming, ["k"]).collect()}
    assert got == {"a": "IDEMPOTENT", "b": "CONFLICT", "c": "NEW"}
    with pytest.raises(Exception, match="other content"):
        sinks.append_new(stored, incoming, ["k"], str(tmp_path / "x"))
    sinks.append_new(stored, incoming.where("k <> 'b'"), ["k"], str(tmp_path / "y"))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "y")).collect()] == [("c", 4)]


def test_vectors_are_checked(spark):
    schema = "fragment_id string, embedding array<float>, created_at timestamp, model_revision string"
    old = spark.createDataFrame([("f", [1.0, 0.0], datetime(2024, 1, 1), "r1")], schema)
    new = spark.createDataFrame([("f", [0.0, 1.0], datetime(2024, 1, 2), "r1")], schema)
    assert sinks.upsert_vectors(old, new, 2).first()["embedding"] == [0.0, 1.0]
    with pytest.raises(Exception, match="another length"):
        sinks.upsert_vectors(old, new, 3).collect()


def test_windows_and_limits():
    with pytest.raises(ValueError):
        grouping.check_window(datetime(2024, 1, 2), datetime(2024, 1, 1))
    with pytest.raises(ValueError):
        grouping.check_window(datetime(2024, 1, 1), datetime(2025, 6, 1))
    assert [grouping.clamp(x, 100) for x in (-1, 7, 1000)] == [1, 7, 100]


def test_allocation_of_samples():
    assert ranking.allocate({"a": 100, "b": 4, "c": 1}, 10) == {"a": 7, "b": 2, "c": 1}
    assert ranking.allocate({"a": 1, "b": 1}, 10) == {"a": 1, "b": 1}
    assert sum(ranking.allocate({"a": 1000, "b": 30, "c": 5}, 60).values()) == 60
    assert ranking.allocate({"a": 3, "b": 3, "c": 3}, 2) == {"a": 1, "b": 1}


def test_fusion_ignores_repeats_in_a_channel(spark):
    df = spark.createDataFrame([(1, "x", 7, 1), (1, "x", 7, 2), (1, "y", 7, 3), (1, "x", 8, 3)], "query_id int, channel string, item_id int, rank int")
    got = {r["item_id"]: r["rrf"] for r in ranking.fuse(df).collect()}
    assert got[7] == pytest.approx(1 / 61 + 1 / 63) and got[8] == pytest.approx(1 / 63)


def test_no_channel_finds_nothing(spark):
    assert spark.range(3).where(retrieval.any_channel([])).count() == 0


def test_versions_compare_as_numbers(spark):
    df = spark.createDataFrame([("a", "9", 1), ("a", "10", 2), ("a", "draft", 3), ("b", "x", 4), ("b", "y", 5)], "id string, v string, n int")
    got = {r["id"]: r["v"] for r in evidence.latest_versions(df, "id", "v", ["n"]).collect()}
    assert got == {"a": "10", "b": "y"}


def test_card_match(spark):
    df = spark.createDataFrame([("supplier", "EIS"), (" SUPPLIER ", None), ("customer", "EIS"), (None, None)], "role string, provider string")
    lists = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    context = {"role": F.col("role"), "process": F.lit("p"), "provider": F.col("provider"), "document_status": F.lit(None).cast("string")}
    card = {"roles": lists("supplier"), "process": lists(), "provider": F.lit(None).cast("array<string>"), "document_status": lists()}
    rows = df.select(evidence.match_card(context, card, lists("provider"), F.lit(True)).alias("m")).select("m.*").collect()
    assert [r["applicable"] for r in rows] == [True, False, False, False]
    assert [r["missing"] for r in rows] == [[], ["provider"], [], ["role", "provider"]]
    assert rows[2]["reasons"] == ["WRONG_ROLE", "FORBIDDEN_GENERALIZATION"]
    assert [r["score"] for r in rows] == [1.0, 0.5, 0.5, 0.0]


def gate(spark, query, texts):
    asked = spark.createDataFrame([(1, query)], "query_id int, query string")
    schema = "query_id int, place int, text string, valid boolean, card struct<applicable: boolean, score: double, missing: array<string>, reasons: array<string>>"
    found = spark.createDataFrame([(1, i, t, v, None) for i, (t, v) in enumerate(texts)], schema)
    row = evidence.gate(asked, found).first()
    return row["sufficiency"], row["risk_flags"]


def test_gate(spark):
    answer = "Чтобы загрузить оферту, нажмите кнопку импорта оферты"
    assert gate(spark, "как загрузить оферту через импорт", [(answer, True)]) == ("SUFFICIENT", "")
    assert gate(spark, "как загрузить оферту", []) == ("INSUFFICIENT", "MISSING_SOURCE")
    assert gate(spark, "как загрузить оферту", [(answer, False)]) == ("INSUFFICIENT", "INVALID_EVIDENCE_REFERENCE,MISSING_SOURCE")
    assert gate(spark, "погода завтра", [(answer, True)]) == ("INSUFFICIENT", "LOW_SPECIFICITY")
    assert gate(spark, "загрузить оферту не помогло", [(answer, True)]) == ("INSUFFICIENT", "POST_INSTRUCTION_FAILURE")
    two = [("Загрузить оферту можно сразу", True), ("Загрузить оферту нельзя до проверки", True)]
    assert gate(spark, "загрузить оферту", two)[1] == "CONFLICTING_EVIDENCE"


@pytest.mark.parametrize(
    ("claim", "reason"),
    [
        ("Оферту загружают за 5 минут", ""),
        ("Оферту загружают за 7 минут", "INVENTED_NUMBER"),
        ("Ошибка RDIK_77 при загрузке оферты", "INVENTED_NUMBER,INVENTED_CODE"),
        ("Оферту смотрите на https://example.com/x.", "UNKNOWN_URL"),
        ("Нажмите «Удалить всё» в оферту", "INVENTED_ACTION_OR_STATUS"),
        ("Совсем другое содержание", "LOW_TEXT_GROUNDING"),
        ("Оферту загружают кнопкой", ""),
        ("Оферту загружают, кнопка Отправить", "INVENTED_ACTION_OR_STATUS"),
        ("Статус оферту загружают", ""),
        ("Оферту загружают, статус документ Подписана", "INVENTED_ACTION_OR_STATUS"),
        ("Здесь ошибка", ""),  # general words count by whole words, so the stem of a long one is none
        ("Here the portal", "LOW_TEXT_GROUNDING"),
    ],
)
def test_claims(spark, claim, reason):
    claims = spark.createDataFrame([("c", claim, ["f"])], "claim_id string, text string, fragment_ids array<string>")
    fragments = spark.createDataFrame([("f", "Оферту загружают за 5 минут, ошибка RDIK_5 при загрузке на portal")], "fragment_id string, text string")
    row = evidence.verify_claims(claims, fragments).first()
    expected = reason
    assert (row["reasons"], row["supported"]) == (expected, expected == "")


def test_claims_need_their_fragments(spark):
    claims = spark.createDataFrame([("a", "x", []), ("b", "x", ["f", "lost"]), ("c", "x", ["empty"])], "claim_id string, text string, fragment_ids array<string>")
    fragments = spark.createDataFrame([("f", "x"), ("empty", "  ")], "fragment_id string, text string")
    got = {r["claim_id"]: r["reasons"] for r in evidence.verify_claims(claims, fragments).collect()}
    assert got == {"a": "NO_EVIDENCE_REFERENCE", "b": "WRONG_SNAPSHOT_FRAGMENT", "c": "EMPTY_EVIDENCE"}


def test_routing_of_flags(spark):
    df = spark.createDataFrame([(["technical_diagnosis_required"], False), (["Wrong_Role", "odd"], False), ([], True)], "flags array<string>, human boolean")
    rows = df.select(cases.routing(F.lit(True), F.lit(False), F.col("flags"), F.col("human")).alias("d")).select("d.*").collect()
    assert [r["queue"] for r in rows] == ["l2-technical", "l2-general", "l1-general"]
    assert [r["reasons"] for r in rows] == [["TECHNICAL_DIAGNOSIS_FLAG"], ["WRONG_ROLE", "UNKNOWN_RISK_FLAG:odd"], ["EXPLICIT_HUMAN_REQUEST"]]


def test_json_text_takes_strings_only(spark):
    df = spark.createDataFrame([('{"text": "a"}',), ('{"text": 5}',), ("{bad",), (None,), ("{}",)], "p string")
    assert [r[0] for r in df.select(cases.json_text(F.col("p"), "text")).collect()] == ["a", None, None, None, None]


def fragments_of(spark, *texts):
    rows = chunking.fragments(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [[r for r in sorted(rows, key=lambda r: r["place"]) if r["doc_id"] == i] for i in range(len(texts))]


def test_fragments_of_a_page(spark):
    text = "1. Setup\n\nOne line.\nSecond line.\n\n• First step\nWarning: hot\n\n1.1 Details\nMore text.\n2. End\nLast."
    first, empty, title, none, deep = fragments_of(spark, text, "", "TITLE ONLY", None, "1.2.3 Deep\nbody\nCAPITALS HERE\nrest\n1. One\n1.1 Two\n2 Three\nend")
    assert [r["kind"] for r in first] == ["paragraph", "procedure_step", "warning", "paragraph"]
    assert first[0]["text"] == "Section: 1. Setup\nOne line.\nSecond line." and first[0]["heading"] == "1. Setup"
    assert first[3]["text"] == "Section: 1. Setup / 1.1 Details\nMore text.\nSection: 2. End\nLast."
    assert empty == none == [] and [(r["kind"], r["heading"], r["text"], r["review_status"]) for r in title] == [("definition", "TITLE ONLY", "Section: TITLE ONLY", "NEEDS_REVIEW")]
    assert [r["text"] for r in deep] == ["Section: 1.2.3 Deep\nbody\nSection: CAPITALS HERE\nrest\nSection: 2 Three\nend"]
    assert first[0]["fragment_id"] == "frag_" + ids.digest("fragment", "0", 1, 1, "1. Setup", "page:1;unit:0;bbox:None", ids.text_digest(first[0]["text"]))[:32]
    assert all(r["excerpt"] == r["text"][:240] and r["review_status"] == "VERIFIED" for r in first)


def test_packing_of_units(spark):
    long, half = "x" * 1000, "x" * 800
    found = fragments_of(spark, "\n\n".join([long] * 3), f"{half}\n\n{half}", "a\n\nb - c\n\nwarning d\n\ne")
    assert [[r["kind"] for r in rows] for rows in found] == [["paragraph"] * 3, ["paragraph"], ["paragraph", "warning", "paragraph"]]


def test_lines_tables_and_boxes(spark):
    words = spark.createDataFrame([(1, "b", 5.0, 6.0, 1.01, 2.0), (1, "a", 1.0, 2.0, 1.02, 2.5), (1, "c", 1.0, 2.0, 9.0, 10.0)], "page int, text string, x0 double, x1 double, top double, bottom double")
    got = {r["line"]: (r["text"], r["bbox"]) for r in chunking.recovered_lines(words).collect()}
    assert got[1.0] == ("a b", [1.0, 1.01, 6.0, 2.5])
    table = spark.createDataFrame([(["A", " "], [["1", None], ["2"]])], "h array<string>, r array<array<string>>")
    assert table.select(chunking.table_rows(F.col("h"), F.col("r"))).first()[0] == ["A |  | A: 1 | Column 2: ", "A |  | A: 2 | Column 2: "]
    flags = spark.createDataFrame([("", 0, 0, 0, False), ("short", 0, 1, 1, True), ("", 1, 0, 0, False)], "t string, n int, a int, b int, f boolean")
    rows = flags.select(chunking.page_flags(F.col("t"), F.col("n"), F.col("a"), F.col("b"), F.col("f"))).collect()
    assert [r[0] for r in rows] == [["EMPTY_PAGE"], ["LOW_TEXT_DENSITY", "TABLE_STRUCTURE_WARNING", "EXTRACTION_WARNING", "TEXT_EXTRACTION_FAILED"], []]
    boxes = spark.createDataFrame([([[0.0, 1.0, 2.0, 3.0], None, [-1.0, 5.0, 1.0, 9.0]],), ([None],)], "b array<array<double>>")
    assert [r[0] for r in boxes.select(chunking.union_box(F.col("b"))).collect()] == [[-1.0, 1.0, 2.0, 9.0], None]


def workbook() -> bytes:
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    strings = f"<sst {ns}><si><t>Q</t></si><si><t>A</t></si><si><r><t>why</t></r><r><t>?</t></r></si></sst>"
    sheet = f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2" t="s"><v>2</v></c><c r="C2"><v>5</v></c></row><row><c r="C3" t="inlineStr"><is><t>b</t></is></c></row></sheetData></worksheet>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as book:
        book.writestr("xl/sharedStrings.xml", strings)
        book.writestr("xl/worksheets/sheet1.xml", sheet)
    return out.getvalue()


def test_sheets(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbook())
    rows = tables.read_sheets(spark, str(tmp_path), ["Q", "A", "None"]).orderBy("source_row").collect()
    assert [tuple(r)[1:] for r in rows] == [(2, "why?", "5", ""), (3, "", "b", "")]


def test_manifest(spark, tmp_path):
    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_text('[{"file": "a.pdf", "title": "A", "corpus": "NORMATIVE", "declared_date": "2024-02-01"}]')
    bad.write_text('[{"file": "a.pdf"}, {"file": "a.pdf"}]')
    assert tables.read_manifest(spark, str(good)).count() == 1
    with pytest.raises(Exception, match="listed twice"):
        tables.read_manifest(spark, str(bad)).collect()


def test_resolution_is_filled_once(spark):
    rows = [(1, 1, "FEEDBACK_SOLVED"), (1, 2, "FEEDBACK_UNSOLVED"), (2, 1, "FEEDBACK_SOLVED"), (2, 2, "COMPLETED_UNSOLVED"), (3, 1, "CANCELLED")]
    df = spark.createDataFrame(rows, "c int, o int, k string")
    got = {r["c"]: r["resolution"] for r in cases.resolution(df, "c", "o", "k").collect()}
    assert got == {1: "RESOLVED", 2: "UNRESOLVED", 3: "UNKNOWN"}


def test_running_sums_do_not_depend_on_ranges(spark):
    rows = [("a" if i % 3 else "b", i, i % 5 == 0) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, o long, v boolean")
    value = F.col("v").cast("int")
    wide, narrow = (sorted(map(tuple, grouping.running_sum(df, ["k"], "o", value, "s", True, width).collect())) for width in (1 << 16, 7))
    assert wide == narrow
    for k, o, _, s in wide:
        assert s == sum(1 for x, y, z in rows if x == k and y < o and z)


def test_exact_hits_of_short_queries_and_inside_words(spark):
    texts = ["see rdik-12 now", "pre(two words, and a long tail of them)", "ALL  of\nthese words stand here in one row today", "other", None, ""]
    asked = ["RDIK-12", "wo wor", "words, and", "two words, and a long tail of th", "of these words stand here in one row tod", "these words stand", "missing", "two words, or"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, text string")
    fold = lambda t: " ".join((t or "").lower().split())
    expected = {(i, j) for i, q in enumerate(asked) for j, t in enumerate(texts) if t is not None and fold(q) in fold(t)}
    assert {tuple(r) for r in retrieval.exact_hits(queries, docs, "doc_id", "text").collect()} == expected and len(expected) == 6


def test_fragments_of_a_long_document(spark):
    """Thousands of headings in one document of some megabytes: each line takes the path of the heading above it."""
    n = 40_000
    text = "\n".join(f"{i % 9 + 1}.{i} Heading number {i}\nsome line of text number {i} that goes on" for i in range(n))
    rows = chunking.units(chunking.classified_lines(spark.createDataFrame([(1, text, False)], "doc_id long, text string, flagged boolean")))
    got = rows.agg(F.count("*"), F.count_if(F.element_at("path", -1).endswith(F.concat(F.lit("number "), F.regexp_extract("text", r"text number (\d+)", 1))))).first()
    assert tuple(got) == (n, n)
