"""Evidence rules over stand-ins: parts for condition cards, suppliers for contexts, benchmark for claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evidence, ranking, retrieval
from ..sources.tables import table
from . import retrieval as plans
from .registered import query


@query("""
WITH cards AS (SELECT p_name AS card_id, CAST(p_size AS VARCHAR) AS version, p_partkey FROM part)
SELECT card_id, arg_max(version, CAST(version AS BIGINT) * 100000000 + p_partkey) AS version, arg_max(p_partkey, CAST(version AS BIGINT) * 100000000 + p_partkey) AS part FROM cards GROUP BY 1
""")
def latest_card_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes as versions; equal versions by part."""
    cards = table(spark, sf_dir, "part").select(F.col("p_name").alias("card_id"), F.col("p_size").cast("string").alias("version"), F.col("p_partkey").alias("part"))
    newest = cards.groupBy("card_id", "version").agg(F.max("part").alias("part"))
    return evidence.latest_versions(newest, "card_id", "version", ["part"])


@query("""
WITH cards AS (SELECT p_partkey AS card_id, p_type AS role, p_brand AS process, p_size > 25 AS forbids, CASE WHEN p_size % 3 = 0 THEN 'provider' END AS slot FROM part),
ctx AS (SELECT s_suppkey AS context_id, CASE WHEN s_suppkey % 4 = 0 THEN 'ECONOMY' WHEN s_suppkey % 4 = 1 THEN ' small ' WHEN s_suppkey % 4 = 2 THEN '' END AS role, 'Brand#' || (1 + s_suppkey % 25) AS process, CASE WHEN s_acctbal > 5000 THEN 'EIS' END AS provider FROM supplier),
linked AS (SELECT DISTINCT l_partkey AS card_id, l_suppkey AS context_id FROM lineitem),
m AS (SELECT c.card_id, x.context_id, c.slot, c.forbids, coalesce(trim(x.role), '') = '' AS no_role, coalesce(lower(trim(x.role)) = lower(c.role), FALSE) AS role_hit, lower(x.process) = lower(c.process) AS process_hit, x.provider IS NOT NULL AS has_provider
      FROM linked k JOIN cards c ON c.card_id = k.card_id JOIN ctx x ON x.context_id = k.context_id)
SELECT card_id, context_id, role_hit AND process_hit AND (slot IS NULL OR has_provider) AS applicable,
       round((CAST(role_hit AS INT) + CAST(process_hit AS INT) + CAST(slot IS NOT NULL AND has_provider AS INT)) / (2 + CAST(slot IS NOT NULL AS INT)), 6) AS score,
       concat_ws(',', CASE WHEN no_role THEN 'role' END, CASE WHEN slot IS NOT NULL AND NOT has_provider THEN 'provider' END) AS missing
FROM m
""")
def card_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards and contexts meet through the evidence they share (order lines)."""
    cards = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("card_id"), F.array("p_type").alias("roles"), F.array("p_brand").alias("processes"), (F.col("p_size") > 25).alias("forbids"), F.when(F.col("p_size") % 3 == 0, F.array(F.lit("provider"))).alias("required")
    )
    k = F.col("s_suppkey") % 4
    contexts = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("context_id"),
        F.when(k == 0, "ECONOMY").when(k == 1, " small ").when(k == 2, "").alias("role"),
        F.concat(F.lit("Brand#"), (1 + F.col("s_suppkey") % 25).cast("string")).alias("process"),
        F.when(F.col("s_acctbal") > 5000, "EIS").alias("provider"),
    )
    linked = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("card_id"), F.col("l_suppkey").alias("context_id")).distinct()
    rows = linked.join(cards, "card_id").join(contexts, "context_id")
    none = F.lit(None).cast("array<string>")
    context = {"role": F.col("role"), "process": F.col("process"), "provider": F.col("provider"), "document_status": F.lit(None).cast("string")}
    applicability = {"roles": F.col("roles"), "process": F.col("processes"), "provider": none, "document_status": none}
    matched = rows.select("card_id", "context_id", evidence.match_card(context, applicability, F.col("required"), F.col("forbids")).alias("m"))
    return matched.select("card_id", "context_id", "m.applicable", F.round("m.score", 6).alias("score"), F.array_join("m.missing", ",").alias("missing"))


@query("SELECT p_type AS risk_level, count(*) AS n, count(DISTINCT p_brand) AS n_sources FROM part GROUP BY 1")
def card_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("risk_level")).agg(F.count("*").alias("n"), F.count_distinct("p_brand").alias("n_sources"))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = plans._top_tokens(spark, sf_dir)
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    return hits.select("query_id", "doc_id", F.col("rank").alias("place")).join(texts, "doc_id")


@query()
def evidence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sufficiency for each passage over its ten candidates; other languages than English are no members."""
    langs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    no_card = F.lit(None).cast("struct<applicable: boolean, score: double, missing: array<string>, reasons: array<string>>")
    found = _candidates(spark, sf_dir).join(langs, "doc_id").select("query_id", "place", "text", (F.col("lang") == "en").alias("valid"), no_card.alias("card"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return evidence.gate(asked, found)


@query()
def claim_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each passage as a claim, with one number too many in every third, and some with conditions, quotes and references, against its best document."""
    best = _candidates(spark, sf_dir).where("place = 1").select("query_id", F.array(F.col("doc_id").cast("string")).alias("fragment_ids"))
    texts = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 3 == 0, F.concat("text", F.lit(" 424242"))).otherwise(F.col("text")).alias("text"))
    kind, held = F.col("query_id") % 5, F.substring("text", 1, 20)
    other = F.when(kind == 1, held).when(kind == 2, F.lit("a quote of nobody"))
    told = [F.when(kind == 3, F.array(held, F.lit("role: nobody"))).alias("applies_if"), other.alias("evidence_quote"), F.when(kind == 4, F.lit("section 0 of nothing")).alias("evidence_reference")]
    claims = texts.join(best, "query_id", "left").select(F.col("query_id").alias("claim_id"), "text", "fragment_ids", *told)
    fragments = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("fragment_id"), "text")
    return evidence.verify_claims(claims, fragments)


@query()
def historical_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Past records (the lines of all documents) for each passage: the three of best score, in order."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "text"))
    line_id = F.concat_ws(":", F.col("doc_id").cast("string"), F.col("line").cast("string"))
    found = evidence.history_matches(asked, lines.select(line_id.alias("item_id"), F.struct("doc_id", "line").alias("order"), "text"))
    rounded = [F.round(c, 6).alias(c) for c in ("containment", "jaccard")]
    return found.select("query_id", F.col("item_id").alias("line_id"), *rounded, "score", "strong", "rank")


@query(r"""
WITH t AS (SELECT doc_id, list_distinct(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[A-Za-zА-Яа-яЁё0-9]+'), lambda x: length(x) >= 3 OR regexp_full_match(x, '[0-9]+'))) AS w, regexp_extract(text, '^[^\n]*') AS line FROM documents)
SELECT doc_id, len(w) AS n_tokens, len(list_filter(w, lambda x: contains(lower(line), x))) AS n_in_first_line FROM t
""")
def specificity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct tokens of a text, and how many its first line contains."""
    words = F.array_distinct(T.tokens(F.col("text")))
    line = F.lower(F.regexp_extract("text", r"^([^\n]*)", 1))
    rows = table(spark, sf_dir, "documents").select("doc_id", words.alias("w"), line.alias("line"))
    return rows.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.size(F.filter("w", lambda x: F.col("line").contains(x))).cast("long").alias("n_in_first_line"))


@query("""
WITH s AS (SELECT l_partkey AS card_id, l_suppkey AS src, l_linenumber FROM lineitem),
m AS (SELECT s.card_id, bool_or(x.s_suppkey IS NULL) AS lost, bool_or(coalesce(x.s_acctbal < 0, FALSE)) AS low FROM (SELECT DISTINCT card_id, src FROM s) s LEFT JOIN supplier x ON x.s_suppkey = s.src AND x.s_nationkey <> 3 GROUP BY 1)
SELECT CAST(card_id AS VARCHAR) AS card_id, concat_ws(',', CASE WHEN lost THEN 'UNKNOWN_SOURCE' END, CASE WHEN low THEN 'FOREIGN_CORPUS' END) AS issues FROM m
""")
def card_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as cards whose sources are suppliers: some are unknown, some of another corpus."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    none = F.array().cast("array<string>")
    cards = lines.groupBy(F.col("l_partkey").cast("string").alias("card_id")).agg(F.array_sort(F.collect_list(F.col("l_suppkey").cast("string"))).alias("source_fragment_ids"))
    cards = cards.select("card_id", F.lit("1").alias("version"), "source_fragment_ids", none.alias("source_quotes"), none.alias("required_slots"))
    corpus = F.when(F.col("s_acctbal") < 0, "HISTORICAL").otherwise("NORMATIVE").alias("corpus")
    fragments = table(spark, sf_dir, "supplier").where("s_nationkey <> 3").select(F.col("s_suppkey").cast("string").alias("fragment_id"), F.col("s_name").alias("text"), corpus)
    return evidence.audit_cards(cards, fragments, ()).select("card_id", F.array_join("issues", ",").alias("issues"))


@query()
def query_understanding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed tokens, context and language of each turn."""
    text = F.col("text")
    said = T.context(text)
    kinds = F.array_join(F.transform(T.query_entities(text), lambda x: F.concat_ws(":", x["kind"], x["value"])), ",")
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", kinds.alias("entities"), T.language(text).alias("language"), *[c.alias(n) for n, c in said.items()], T.scope_reply(text).alias("scope"))


#: Phrases that questions are put together from, by the number of an event.
_SUBJECTS = ("исправить УПД", "загрузить УПД", "какой тип документа УКД", "МЧД пользователя", "YML прайс", "загрузка оферты", "моя оферта", "договор", "МЧД", "импорт файла СТЕ", "добавление исполнения")
_DETAILS = ("", "администратор", "поставщик на портале поставщиков", "заказчик, портал заказчиков", "в ЕИС, статус неизвестен", "уже пробовал 2 часа", "код RDIK-{k}", "категория {k}, модель", "не помогло, прошло больше часа", "рдик{k} на подписи", "ждём {k} мин", "состояние 3 дня", "{k} сек")
_STATUSES = ("Подписан", "На подписи")


def _sql_case(column: str, patterns: tuple) -> str:
    fits = lambda p: " AND ".join(f"regexp_matches({column}, '(?i){x}')" for x in ((p,) if isinstance(p, str) else p))
    return "CASE " + " ".join(f"WHEN {fits(p)} THEN '{value}'" for p, value in patterns) + " END"


def _sql_words(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_LONG = r"(?i)([0-9]+(?:[.,][0-9]+)?)\s*(сек|мин|ч|д|мес)"


@query(rf"""
WITH q AS (SELECT event_id, list_extract({_sql_words(_SUBJECTS)}, CAST(event_id % {len(_SUBJECTS)} + 1 AS INT)) || ' ' || replace(list_extract({_sql_words(_DETAILS)}, CAST(user_id % {len(_DETAILS)} + 1 AS INT)), '{{k}}', CAST(json_extract(props, '$.k') AS VARCHAR)) AS q FROM events),
p AS (SELECT *, {_sql_case("q", T.PROCESSES)} AS process, regexp_extract(q, '{_LONG}', 1) AS number, lower(regexp_extract(q, '{_LONG}', 2)) AS unit,
             regexp_extract(q, '(?i)((?:rdik|рдик)[_-][a-zа-яё0-9_-]+)', 1) AS c1, lower(regexp_extract(q, '(?i)(?:^|[^A-Za-zА-Яа-яЁё0-9_-])((?:rdik|рдик)[a-zа-яё0-9_-]*)', 1)) AS c2 FROM q)
SELECT event_id, q AS question, process, CASE WHEN process = 'MCD management' THEN {_sql_case("q", T.MANDATE_ROLES)} ELSE {_sql_case("q", T.ROLES)} END AS role, {_sql_case("q", T.PROVIDERS)} AS provider,
       CASE WHEN contains(lower(q), 'подписан') THEN 'Подписан' WHEN contains(lower(q), 'на подписи') THEN 'На подписи' WHEN regexp_matches(q, '(?i){T.MENTIONS_STATUS}') THEN 'present' END AS document_status,
       coalesce(nullif(c1, ''), nullif(c2, '')) AS error_code, {_sql_case("q", T.DOCUMENTS)} AS document_type, CASE WHEN regexp_matches(q, '(?i)уже\s+(?:пробов|сделал|загрузил)|не\s+помогл') THEN 'already tried' END AS attempted_action,
       CASE WHEN number <> '' THEN CAST(number AS DOUBLE) * CASE unit WHEN 'сек' THEN 1.0 / 60 WHEN 'мин' THEN 1 WHEN 'ч' THEN 60 WHEN 'д' THEN 1440 ELSE 43200 END WHEN regexp_matches(q, '(?i)больше\s+час') THEN 61.0 END AS duration_minutes,
       CASE WHEN regexp_matches(q, '(?i){T.MENTIONS_CATEGORY}') THEN nullif(regexp_extract(q, '(?:^|[^\p{{L}}\p{{N}}_-])([0-9]+)', 1), '') END AS category_id, CASE WHEN regexp_matches(q, '(?i){T.MENTIONS_MODEL}') THEN 'present' END AS model
FROM p
""")
def query_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What questions say of their case: every process, role, provider, status and detail occurs."""
    part = lambda words, n: F.element_at(F.array(*map(F.lit, words)), (n % len(words) + 1).cast("int"))
    detail = F.replace(part(_DETAILS, F.col("user_id")), F.lit("{k}"), F.get_json_object("props", "$.k"))
    rows = table(spark, sf_dir, "events").select("event_id", F.concat(part(_SUBJECTS, F.col("event_id")), F.lit(" "), detail).alias("question"))
    said = T.context(F.col("question"), _STATUSES)
    return rows.select("event_id", "question", *[c.alias(n) for n, c in said.items()])
