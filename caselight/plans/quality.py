"""Quality analytics over stand-ins: events for turns (user_id is the case), labels for feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quality
from ..sources.tables import table
from .registered import query

_KEYED = """
  SELECT user_id AS case_id, CASE WHEN event_type = 'error' THEN 'error_category' WHEN value > 100 THEN 'service_need' WHEN value > 50 THEN 'reason_code' ELSE 'decision_label' END AS group_source,
         CASE WHEN event_type = 'error' THEN 'RUNTIME' WHEN value > 100 THEN 'CONSULTATION' WHEN value > 50 THEN 'A|' || upper(event_type) ELSE event_type END AS group_value, event_id
  FROM events
"""
_KEY = "group_source || ':' || left(sha256(lower(group_source || ':' || group_value)), 16)"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with their group: an error, a need, reason codes, or the bare decision."""
    kind, value = F.col("event_type"), F.col("value")
    error = F.when(kind == "error", "RUNTIME")
    need = F.when((kind != "error") & (value > 100), "CONSULTATION")
    reasons = F.when(value > 50, F.array(F.upper(kind), F.lit("A"))).otherwise(F.array().cast("array<string>"))
    source, name = quality.group_source(need, error, reasons, kind)
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("case_id"), "event_id", source.alias("group_source"), name.alias("group_value"))
    return rows.withColumn("group_key", quality.group_key(F.col("group_source"), F.col("group_value")))


@query(f"""
WITH keyed AS ({_KEYED}), signals AS (
  SELECT doc_id AS case_id, CASE WHEN quality = 0 THEN 1 ELSE 0 END AS negative, toxic = 1 AS unresolved FROM labels
), per_case AS (
  SELECT {_KEY} AS group_key, group_source, group_value, case_id, count(*) AS turns FROM keyed GROUP BY 1, 2, 3, 4
), placed AS (
  SELECT p.*, s.negative, s.unresolved, row_number() OVER (PARTITION BY group_key ORDER BY p.case_id) AS rn FROM per_case p LEFT JOIN signals s ON s.case_id = p.case_id
)
SELECT group_key, group_source, group_value, CAST(sum(turns) AS BIGINT) AS n_turns, count(*) AS n_cases, CAST(coalesce(sum(negative), 0) AS BIGINT) AS negative_feedback,
       count(*) FILTER (WHERE unresolved) AS unresolved_cases, string_agg(CAST(case_id AS VARCHAR), ',' ORDER BY case_id) FILTER (WHERE rn <= 3) AS representative_cases
FROM placed GROUP BY 1, 2, 3 HAVING sum(turns) >= 2
""")
def issue_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    signals = labels.select(F.col("doc_id").alias("case_id"), (F.col("quality") == 0).cast("long").alias("negative"), (F.col("toxic") == 1).alias("unresolved"))
    return quality.issue_groups(_turns(spark, sf_dir), signals)


@query(f"""
WITH keyed AS (SELECT *, {_KEY} AS group_key FROM ({_KEYED}))
SELECT group_key, event_id AS delivery_key, case_id FROM keyed WHERE group_key IN (SELECT group_key FROM keyed GROUP BY 1 HAVING count(*) >= 2)
""")
def issue_group_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _turns(spark, sf_dir)
    groups = turns.groupBy("group_key").agg(F.count("*").alias("n")).where("n >= 2").select("group_key")
    return turns.join(groups, "group_key", "left_semi").select("group_key", F.col("event_id").alias("delivery_key"), "case_id")


@query("""
WITH t AS (
  SELECT d.doc_id, length(trim(coalesce(d.text, ''))) > 0 AND d.n_chars > 400 AS answer, l.doc_id IS NOT NULL AS evidence, coalesce(l.toxic, 0) = 1 AS critical
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
SELECT doc_id, CASE WHEN answer AND evidence THEN 'ONE' ELSE 'UNKNOWN' END AS factual_support, CASE WHEN answer AND evidence THEN 'ONE' ELSE 'UNKNOWN' END AS completeness,
       CASE WHEN answer THEN 'TWO' ELSE 'NOT_APPLICABLE' END AS clarity, CASE WHEN answer AND evidence THEN 'TWO' WHEN answer THEN 'ONE' ELSE 'NOT_APPLICABLE' END AS next_step, critical
FROM t
""")
def rubric_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic", F.lit(True).alias("labelled"))
    rows = table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    answer = (F.length(F.trim(F.coalesce("text", F.lit("")))) > 0) & (F.col("n_chars") > 400)
    scores = quality.rubric(answer, F.col("labelled").isNotNull())
    return rows.select("doc_id", *[c.alias(n) for n, c in scores.items()], (F.coalesce("toxic", F.lit(0)) == 1).alias("critical"))


@query("""
SELECT 'quality' AS dimension, CAST(quality AS VARCHAR) AS rating, count(*) AS n FROM labels GROUP BY 2
UNION ALL SELECT 'toxic', CAST(toxic AS VARCHAR), count(*) FROM labels GROUP BY 2
""")
def quality_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both rating distributions in one pass."""
    rated = table(spark, sf_dir, "labels").select(F.explode(F.create_map(F.lit("quality"), "quality", F.lit("toxic"), "toxic")).alias("dimension", "rating"))
    return rated.groupBy("dimension", F.col("rating").cast("string").alias("rating")).agg(F.count("*").alias("n"))


@query("""
SELECT user_id AS case_id, event_type AS kind, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(DISTINCT sha256(props)) AS n_contents,
       CASE WHEN count(DISTINCT sha256(props)) > 1 THEN 'CONFLICT' WHEN count(*) > 1 THEN 'IDEMPOTENT' ELSE 'NEW' END AS status
FROM events GROUP BY 1, 2, 3
""")
def intake_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts by case, kind and day."""
    rows = table(spark, sf_dir, "events").withColumnsRenamed({"user_id": "case_id", "event_type": "kind"}).withColumn("day", F.date_format(F.to_date("ts"), "yyyy-MM-dd"))
    return quality.intake_status(rows, ["case_id", "kind", "day"], F.sha2("props", 256))


@query("""
WITH f AS (SELECT o_custkey AS case_id, o_orderdate AS completed_at, o_orderstatus || ':' || o_orderpriority AS content FROM orders),
     m AS (SELECT case_id, max(completed_at) AS completed_at, count(*) AS n_facts FROM f GROUP BY 1)
SELECT f.case_id, max(f.completed_at) AS completed_at, max(m.n_facts) AS n_facts, max(content) AS content, count(DISTINCT content) > 1 AS conflict
FROM f JOIN m ON m.case_id = f.case_id AND m.completed_at = f.completed_at GROUP BY 1
""")
def completion_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "case_id")
    return quality.latest_completion(rows, "case_id", "o_orderdate", F.concat_ws(":", "o_orderstatus", "o_orderpriority"))
