"""Quality analytics: rubric, issue groups, intake of facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIMENSIONS = ("factual_support", "completeness", "clarity", "next_step")


def rubric(has_answer: Column, has_evidence: Column) -> dict[str, Column]:
    """Values of the four dimensions. Missing evidence is UNKNOWN, never zero."""
    both = has_answer & has_evidence
    return {
        "factual_support": F.when(both, "ONE").otherwise("UNKNOWN"),
        "completeness": F.when(both, "ONE").otherwise("UNKNOWN"),
        "clarity": F.when(has_answer, "TWO").otherwise("NOT_APPLICABLE"),
        "next_step": F.when(both, "TWO").when(has_answer, "ONE").otherwise("NOT_APPLICABLE"),
    }


def evaluate_turns(turns: DataFrame) -> DataFrame:
    """Scores of turns by schema TURNS; an error category is a signal of its own."""
    ids = F.filter(F.coalesce("evidence_fragment_ids", F.array()), lambda x: F.trim(x) != "")
    has_answer = F.trim(F.coalesce("answer_markdown", F.lit(""))) != ""
    error = F.nullif(F.trim(F.coalesce("error_category", F.lit(""))), F.lit(""))
    scores = rubric(has_answer, F.size(ids) > 0)
    reason = F.when(error.isNotNull(), F.concat(F.lit("Pushed error category: "), error))
    return turns.select("case_id", "turn_id", "revision", *[c.alias(n) for n, c in scores.items()], error.isNotNull().alias("critical_error"), reason.alias("critical_error_reason"))


def group_source(service_need: Column, error: Column, reasons: Column, decision: Column) -> tuple[Column, Column]:
    """Which attribute names a turn's group, and its value: the first that is not blank."""
    blank = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    codes = F.array_sort(F.filter(F.transform(F.coalesce(reasons, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != ""))
    joined = F.nullif(F.array_join(codes, "|"), F.lit(""))
    need, err, dec = blank(service_need), blank(error), blank(decision)
    source = F.when(need.isNotNull(), "service_need").when(err.isNotNull(), "error_category").when(joined.isNotNull(), "reason_code").when(dec.isNotNull(), "decision_label")
    return source.otherwise("unclassified"), F.coalesce(need, err, joined, dec, F.lit("UNCLASSIFIED"))


def group_key(source: Column, value: Column) -> Column:
    return F.concat(source, F.lit(":"), F.substring(F.sha2(F.lower(F.concat(source, F.lit(":"), value)), 256), 1, 16))


def issue_groups(keyed: DataFrame, case_signals: DataFrame, least: int = 2) -> DataFrame:
    """Groups of turns (group_key, group_source, group_value, case_id) with signals per case.

    case_signals: case_id, negative (negative feedback rows), unresolved (boolean). Rows are
    counted as turns, cases once a group, whatever the order of the input.
    """
    names = ("group_key", "group_source", "group_value")
    per_case = keyed.groupBy(*names, "case_id").agg(F.count("*").alias("turns"))
    joined = per_case.join(case_signals, "case_id", "left")
    groups = joined.groupBy(*names).agg(
        F.sum("turns").alias("n_turns"),
        F.count("*").alias("n_cases"),
        F.coalesce(F.sum("negative"), F.lit(0)).alias("negative_feedback"),
        F.count_if("unresolved").alias("unresolved_cases"),
    )
    # the three smallest ids, without a list of all
    w = _first_three(joined, names)
    return groups.join(w, list(names)).where(F.col("n_turns") >= least)


def _first_three(cases: DataFrame, names: tuple[str, ...]) -> DataFrame:
    order = Window.partitionBy(*names).orderBy("case_id")
    few = cases.withColumn("_n", F.row_number().over(order)).where("_n <= 3")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "case_id"))), lambda x: x["case_id"].cast("string")), ",")
    return few.groupBy(*names).agg(listed.alias("representative_cases"))


def intake_status(facts: DataFrame, key: list[str], content: Column) -> DataFrame:
    """status of each key over a batch: NEW (once), IDEMPOTENT (equal repeats), CONFLICT (other content)."""
    judged = facts.groupBy(*key).agg(F.count("*").alias("n"), F.count_distinct(content).alias("n_contents"))
    status = F.when(F.col("n_contents") > 1, "CONFLICT").when(F.col("n") > 1, "IDEMPOTENT").otherwise("NEW")
    return judged.withColumn("status", status)


def latest_completion(facts: DataFrame, key: str, ts: str, content: Column) -> DataFrame:
    """Each key's latest fact, and whether facts of that very time differ (conflict)."""
    rows = facts.select(key, F.col(ts).alias("completed_at"), content.alias("content"))
    latest = rows.groupBy(key).agg(F.max("completed_at").alias("completed_at"), F.count("*").alias("n_facts"))
    tied = rows.join(latest, [key, "completed_at"]).groupBy(key).agg(F.max("completed_at").alias("completed_at"), F.max("n_facts").alias("n_facts"), F.max("content").alias("content"), (F.count_distinct("content") > 1).alias("conflict"))
    return tied
