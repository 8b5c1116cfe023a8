"""Operational rules over cases, turns and their events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grouping import running_sum

#: Risk flags that have a reason code of their own name.
KNOWN_FLAGS = (
    "HUMAN_SUPPORT_REQUIRED", "ROLE_AMBIGUITY", "CONFLICTING_EVIDENCE", "WRONG_ROLE", "WRONG_STATUS", "WRONG_PROVIDER", "FORBIDDEN_GENERALIZATION",
    "HIGH_RISK_MISSING_CONDITION", "NEGATED_QUERY", "LOW_SPECIFICITY", "POST_INSTRUCTION_FAILURE", "MISSING_SOURCE", "INVALID_EVIDENCE_REFERENCE",
)
TECHNICAL_FLAG, UNAVAILABLE_FLAG = "TECHNICAL_DIAGNOSIS_REQUIRED", "KNOWLEDGE_UNAVAILABLE"
#: Decisions that end a row of clarifications.
CLARIFICATION_RESETS = ("ANSWER", "ANSWER_AND_HANDOFF", "HANDOFF_OFFER", "OUT_OF_SCOPE")


def superseded(turns: DataFrame, case: str, revision: str) -> DataFrame:
    """Adds next_revision and is_active: the last turn of a case is active, the others gave way."""
    ahead = F.lead(revision).over(Window.partitionBy(case).orderBy(revision))
    return turns.withColumn("next_revision", ahead).withColumn("is_active", ahead.isNull())


def warnings_before(events: DataFrame, case: str, order: str, violation: Column, close_at: int) -> DataFrame:
    """Adds warnings (violations before this row) and closes (this violation reaches the limit)."""
    counted = running_sum(events, [case], order, violation.cast("int"), "warnings", before=True)
    return counted.withColumn("closes", violation & (F.col("warnings") + 1 >= close_at))


def sticky(events: DataFrame, case: str, revision: str, columns: list[str]) -> DataFrame:
    """Each case's last values that are not null, in order of revision, repeats of a revision ignored."""
    once = events.groupBy(case, revision).agg(*[F.first(c).alias(c) for c in columns])
    picks = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(revision))).alias(c) for c in columns]
    return once.groupBy(case).agg(F.max(revision).alias("last_revision"), *picks)


def merged_slots(facts: DataFrame, keys: list[str], value: str, rank: Column, order: str) -> DataFrame:
    """The value of each slot: of the strongest provenance, and of those the latest."""
    return facts.groupBy(*keys).agg(F.max_by(value, F.struct(rank, F.col(order))).alias(value))


def routing(insufficient: Column, conditional: Column, flags: Column, asks_human: Column) -> Column:
    """Struct of need, line, queue, engineering and reasons (array)."""
    upper = F.transform(flags, F.upper)
    technical = F.array_contains(upper, TECHNICAL_FLAG)
    own = F.filter(flags, lambda f: F.upper(f) != UNAVAILABLE_FLAG)
    codes = F.transform(own, lambda f: F.when(F.upper(f).isin(*KNOWN_FLAGS), F.upper(f)).otherwise(F.concat(F.lit("UNKNOWN_RISK_FLAG:"), f)))
    instead = lambda code: F.when(F.size(codes) > 0, codes).otherwise(F.array(F.lit(code)))

    def decided(need: str, line: str, queue: str, engineering: bool, reasons: Column) -> Column:
        return F.struct(F.lit(need).alias("need"), F.lit(line).alias("line"), F.lit(queue).alias("queue"), F.lit(engineering).alias("engineering"), reasons.alias("reasons"))

    return (
        F.when(technical, decided("TECHNICAL_DIAGNOSIS", "L2", "l2-technical", True, F.array(F.lit("TECHNICAL_DIAGNOSIS_FLAG"))))
        .when(asks_human, decided("CONSULTATION", "L1", "l1-general", False, F.array(F.lit("EXPLICIT_HUMAN_REQUEST"))))
        .when(insufficient, decided("COMPLEX_PROCESS", "L2", "l2-general", False, instead("INSUFFICIENT_EVIDENCE")))
        .when(conditional, decided("ACCOUNT_OR_STATE_CHECK", "L1", "l1-general", False, instead("CONDITION_DEPENDENT")))
        .otherwise(decided("CONSULTATION", "L1", "l1-general", False, codes))
    )


def due_step(elapsed: Column, delay: float, steps: int = 4) -> Column:
    """Scripted step that is due after some seconds."""
    return F.least(F.greatest(F.floor(elapsed / delay), F.lit(0)), F.lit(steps)).cast("int")


def json_text(payload: Column, field: str) -> Column:
    """A string field of a JSON object; malformed JSON, other types and missing fields give null."""
    parsed = F.try_parse_json(payload)
    value = F.try_variant_get(parsed, f"$.{field}", "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(parsed, f"$.{field}", "string"))


def resolution(events: DataFrame, case: str, order: str, kind: str) -> DataFrame:
    """Resolution of each case after its events in order.

    COMPLETED_SOLVED and COMPLETED_UNSOLVED set it, CANCELLED changes nothing, feedback and the
    support's end fill it only while it is UNKNOWN: so the last setting event wins, and else
    the first filling one.
    """
    sets = F.when(F.col(kind) == "COMPLETED_SOLVED", "RESOLVED").when(F.col(kind) == "COMPLETED_UNSOLVED", "UNRESOLVED")
    fills = F.when(F.col(kind) == "FEEDBACK_SOLVED", "RESOLVED").when(F.col(kind) == "FEEDBACK_UNSOLVED", "UNRESOLVED").when(F.col(kind) == "SUPPORT_RESOLVED", "RESOLVED")
    rows = events.select(case, order, sets.alias("sets"), fills.alias("fills"))
    last = F.max_by("sets", F.when(F.col("sets").isNotNull(), F.col(order)))
    first = F.min_by("fills", F.when(F.col("fills").isNotNull(), F.col(order)))
    return rows.groupBy(case).agg(F.coalesce(last, first, F.lit("UNKNOWN")).alias("resolution"))


#: The fields that may be kept of a fact's origin.
PROVENANCE_KEYS = ("trace_id", "producer", "source_reference")


def provenance(supplied: Column) -> Column:
    """The allowed entries of a map of strings."""
    return F.map_filter(supplied, lambda k, _: k.isin(*PROVENANCE_KEYS))


def union_of_names(*lists: Column) -> Column:
    """Names of all lists, each once whatever its case, in the spelling met first."""
    joined = F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists])
    return F.aggregate(joined, F.array().cast("array<string>"), lambda seen, x: F.when(F.exists(seen, lambda s: F.lower(s) == F.lower(x)), seen).otherwise(F.array_append(seen, x)))


def decision(sufficiency: Column, risk: Column, clarifications: Column, verified: Column, human: Column, limit: int = 2) -> Column:
    """What a turn leads to after the evidence gate; clarifications are asked twice at most."""
    return (
        F.when(human, "HANDOFF_OFFER")
        .when((sufficiency == "CONDITION_DEPENDENT") & (clarifications < limit), "CLARIFY")
        .when((sufficiency == "SUFFICIENT") & verified & risk, "ANSWER_AND_HANDOFF")
        .when((sufficiency == "SUFFICIENT") & verified, "ANSWER")
        .otherwise("HANDOFF_OFFER")
    )


def handoff_packages(turns: DataFrame, slots: DataFrame, sources: DataFrame, case: str) -> DataFrame:
    """One row per case: the last question, known slots (`name=value`), and its sources.

    turns: case, seq, question; slots: case, slot, value; sources: case, source.
    """
    last = turns.groupBy(case).agg(F.max_by("question", "seq").alias("question"), F.count("*").alias("n_turns"))
    pairs = F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "slot", F.col("value").cast("string")))), ",").alias("slots")
    known = slots.groupBy(case).agg(pairs)
    cited = sources.groupBy(case).agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))
    return last.join(known, case, "left").join(cited, case, "left")


def aged(at: Column, now: Column, ttl: str) -> Column:
    """Whether something that began at a time has outlived its time to live."""
    return at < now - F.expr(f"interval {ttl}")


def within_tolerance(sent: Column, now: Column, seconds: int) -> Column:
    return F.abs(F.timestamp_diff("SECOND", sent, now)) <= seconds
