"""Arrays that overlap, and structured drafts, over stand-ins from lineitem and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import drafts, overlap
from ..sources.tables import table
from .registered import query


@query("""
WITH l AS (SELECT *, l_partkey * 1000000 + l_suppkey AS source FROM lineitem),
cards AS (SELECT l_partkey AS card_id, list_distinct(list(source)) AS ids FROM l GROUP BY 1),
answers AS (SELECT l_orderkey AS answer_id, list_distinct(list(source)) AS ids FROM l GROUP BY 1),
near AS (SELECT DISTINCT l_partkey AS card_id, l_orderkey AS answer_id FROM lineitem)
SELECT n.card_id, n.answer_id, len(list_intersect(c.ids, a.ids)) AS n_shared FROM near n JOIN cards c ON c.card_id = n.card_id JOIN answers a ON a.answer_id = n.answer_id WHERE list_has_any(c.ids, a.ids)
""")
def card_evidence_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards (parts) and answers (orders) that share a source, a part of one supplier."""
    lines = table(spark, sf_dir, "lineitem").withColumn("source", F.col("l_partkey") * 1000000 + F.col("l_suppkey"))
    cards = lines.groupBy(F.col("l_partkey").alias("card_id")).agg(F.collect_set("source").alias("ids"))
    answers = lines.groupBy(F.col("l_orderkey").alias("answer_id")).agg(F.collect_set("source").alias("ids"))
    found = overlap.overlap_join(cards, answers, "card_id", "answer_id", "ids")
    return found.withColumn("n_shared", F.col("n_shared").cast("long"))


#: Ten forms of drafts around an event's properties, by its number; sound ones and one for each reason.
_CLAIM = '{"claim_id": "c%d", "text": "about %s", "fragment_ids": ["f1", "f2"]%s}'
_FORMS = (
    '```json\n{"draft_markdown": "see {p}", "claims": [' + _CLAIM % (1, "one", "") + ", " + _CLAIM % (2, "two", ', "applies_if": ["role"], "evidence_quote": null') + "]}\n```",
    '{"claims": [' + _CLAIM % (1, "cut", ""),
    '{"answer_blocks": ["a", {"deep": [1, {"Decision": {p}}]}]}',
    '{"claims": [' + _CLAIM % (1, "one", "") + ", " + _CLAIM % (1, "again", "") + "]}",
    '{"props": {p}, "draft_markdown": "x"}',
    '{"claims": [{"claim_id": "c1", "text": "without sources", "fragment_ids": []}]}',
    "[{p}]",
    " \n ",
    '{"draft_markdown": "x", "decision_candidate": "Handoff"}',
    '{"draft_markdown": "{e}", "missing_slots": ["provider"], "requires_human_check": true, "candidate_status": "sufficient"}',
)


def _raw():
    forms = F.array(*[F.lit(f) for f in _FORMS])
    picked = F.element_at(forms, (F.pmod("event_id", F.lit(len(_FORMS))) + 1).cast("int"))
    return F.replace(F.replace(picked, F.lit("{p}"), F.col("props")), F.lit("{e}"), F.col("event_type"))


def _sql_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


_KNOWN = [f"$.{k}" for k in drafts.DRAFT_FIELDS] + [f"$.claims[].{k}" for k in drafts.CLAIM_FIELDS] + ["$.claims[]", "$.answer_blocks[]", "$.missing_slots[]", "$.claims[].fragment_ids[]", "$.claims[].applies_if[]"]
_OF_KIND = {
    "VARCHAR": ["$.draft_markdown", "$.answer_blocks[]", "$.missing_slots[]", "$.claims[].claim_id", "$.claims[].text", "$.claims[].fragment_ids[]", "$.claims[].applies_if[]"],
    "ARRAY": ["$.answer_blocks", "$.claims", "$.missing_slots", "$.claims[].fragment_ids", "$.claims[].applies_if"],
    "BOOLEAN": ["$.requires_human_check", "$.claims[].requires_human_check"],
    "OBJECT": ["$.claims[]"],
}
_WRONG = " OR ".join(f"(path IN ({_sql_list(paths)}) AND type <> '{kind}')" for kind, paths in _OF_KIND.items())
_INDICATORS = _sql_list(f"$.{k}" for k in drafts.INDICATORS)


@query(f"""
WITH raw AS (SELECT event_id, replace(replace(list_extract([{_sql_list(_FORMS)}], CAST(event_id % {len(_FORMS)} + 1 AS INT)), '{{p}}', props), '{{e}}', event_type) AS raw FROM events),
bare AS (SELECT event_id, trim(regexp_replace(trim(raw, E' \\n'), '(?is)^```(?:json)?(.*)```$', '\\1'), E' \\n') AS bare FROM raw),
ok AS (SELECT event_id, CAST(bare AS JSON) AS v FROM bare WHERE json_valid(bare) AND bare <> ''),
tree AS (SELECT ok.event_id, t.key, t.type, t.atom ->> '$' AS text, regexp_replace(replace(t.fullkey, '"', ''), '\\[[0-9]+\\]', '[]', 'g') AS path, t.fullkey AS place FROM ok, json_tree(ok.v) t WHERE t.parent IS NOT NULL),
flags AS (
  SELECT event_id, bool_or(coalesce(lower(key) IN ({_sql_list(drafts.FORBIDDEN)}), FALSE)) AS forbidden,
         bool_or(path NOT IN ({_sql_list(_KNOWN)}) OR {_WRONG} OR (path IN ({_INDICATORS}, '$.claims[].evidence_quote', '$.claims[].evidence_reference') AND type NOT IN ('VARCHAR', 'NULL'))
                 OR coalesce(path IN ('$.claims[].claim_id', '$.claims[].text') AND length(text) = 0, FALSE)) AS unshaped,
         bool_or(coalesce(path IN ({_INDICATORS}) AND lower(text) IN ({_sql_list(drafts.BUSINESS)}), FALSE)) AS business,
         count(*) FILTER (WHERE path = '$.claims[]') AS n, count(*) FILTER (WHERE path = '$.claims[].claim_id') AS n1, count(*) FILTER (WHERE path = '$.claims[].text') AS n2,
         count(DISTINCT regexp_extract(place, 'claims\\[([0-9]+)\\]', 1)) FILTER (WHERE path = '$.claims[].fragment_ids[]') AS n3, count(DISTINCT text) FILTER (WHERE path = '$.claims[].claim_id') AS ids
  FROM tree GROUP BY 1)
SELECT b.event_id, CASE WHEN bare = '' THEN 'EMPTY' WHEN ok.event_id IS NULL THEN 'INVALID_JSON' WHEN json_type(ok.v) <> 'OBJECT' THEN 'NOT_AN_OBJECT' WHEN forbidden THEN 'FORBIDDEN_FIELD'
       WHEN unshaped OR n1 < n OR n2 < n OR n3 < n THEN 'SCHEMA' WHEN business THEN 'BUSINESS_DECISION' WHEN ids < n THEN 'CLAIM_IDS_NOT_UNIQUE' ELSE 'SOUND' END AS verdict,
       coalesce(CASE WHEN json_type(ok.v) = 'OBJECT' AND NOT forbidden AND NOT (unshaped OR n1 < n OR n2 < n OR n3 < n OR business OR ids < n) THEN n END, -1) AS n_claims
FROM bare b LEFT JOIN ok ON ok.event_id = b.event_id LEFT JOIN flags f ON f.event_id = b.event_id
""")
def draft_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts around the properties of events: the first reason against each, or SOUND with the number of its claims."""
    raw = table(spark, sf_dir, "events").select("event_id", _raw().alias("raw"))
    found = drafts.checked_drafts(raw, "event_id", "raw")
    return found.select("event_id", F.coalesce("reason", F.lit("SOUND")).alias("verdict"), F.coalesce(F.col("n_claims").cast("long"), F.lit(-1)).alias("n_claims"))
