"""Structured drafts of a generator: parsed as variants and judged by all nodes of their trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields that only the support core decides, at any depth and in any case.
FORBIDDEN = ("decision", "should_handoff", "handoff_status", "resolution_status", "reason_codes")
#: Indicators may not name these.
BUSINESS = ("answer", "handoff", "handoff_offer", "answer_and_handoff", "clarify", "technical_error")
INDICATORS = ("evidence_status", "status_indicator", "candidate_status", "decision_candidate")
#: The fields of a draft and of a claim with their types; a type in brackets may be null.
DRAFT_FIELDS = {"draft_markdown": "STRING", "answer_blocks": "ARRAY", "claims": "ARRAY", "missing_slots": "ARRAY", "requires_human_check": "BOOLEAN", **dict.fromkeys(INDICATORS, "[STRING]")}
CLAIM_FIELDS = {"claim_id": "STRING", "text": "STRING", "fragment_ids": "ARRAY", "evidence_quote": "[STRING]", "evidence_reference": "[STRING]", "applies_if": "ARRAY", "requires_human_check": "BOOLEAN"}
REQUIRED = ("claim_id", "text", "fragment_ids")
#: Least and greatest lengths of texts.
LENGTHS = {"$.draft_markdown": (0, 30000), "$.claims[].claim_id": (1, 128), "$.claims[].text": (1, 8000)}
REASONS = ("EMPTY", "INVALID_JSON", "NOT_AN_OBJECT", "FORBIDDEN_FIELD", "SCHEMA", "BUSINESS_DECISION", "CLAIM_IDS_NOT_UNIQUE")
FENCE = r"(?is)^\s*```(?:json)?\s*(.*?)\s*```\s*$"


def unfenced(raw: Column) -> Column:
    """The text inside a code fence around it all, or the text itself."""
    text = F.trim(raw, F.lit(" \t\r\n"))
    return F.when(text.rlike(FENCE), F.trim(F.regexp_extract(text, FENCE, 1), F.lit(" \t\r\n"))).otherwise(text)


def _kind(value: Column) -> Column:
    """The type of a variant without what it holds: OBJECT, ARRAY, STRING, BOOLEAN, VOID or a number's."""
    return F.regexp_extract(F.schema_of_variant(value), "^([A-Z]+)", 1)


def nodes(parsed: DataFrame, row_id: str, value: str) -> DataFrame:
    """(row_id, path, place, key, kind, text) of every node below the roots of variants.

    path names the keys on the way, with [] for an element; place has the numbers of elements too.
    The walk goes a level a round, as deep as the deepest tree.
    """
    spark = parsed.sparkSession
    level = parsed.select(row_id, F.lit("$").alias("path"), F.lit("$").alias("place"), F.col(value).alias("v")).where(_kind(F.col("v")).isin("OBJECT", "ARRAY"))
    found = None
    while found is None or not level.isEmpty():
        below = level.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        step = F.when(F.col("key").isNull(), F.lit("[]")).otherwise(F.concat(F.lit("."), "key"))
        exact = F.when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), "key"))
        rows = below.select(row_id, F.concat("path", step).alias("path"), F.concat("place", exact).alias("place"), "key", _kind(F.col("value")).alias("kind"), F.try_variant_get("value", "$", "string").alias("text"), F.col("value").alias("v"))
        found = rows.drop("v") if found is None else found.unionByName(rows.drop("v"))
        level = rows.where(F.col("kind").isin("OBJECT", "ARRAY")).select(row_id, "path", "place", "v")
    return found


def _out_of_shape() -> Column:
    """Whether a node is unknown, of a wrong type or of a wrong length."""
    types = {f"$.{k}": t for k, t in DRAFT_FIELDS.items()} | {f"$.claims[].{k}": t for k, t in CLAIM_FIELDS.items()} | {"$.claims[]": "OBJECT"}
    types |= {f"$.{k}[]": "STRING" for k in ("answer_blocks", "missing_slots")} | {f"$.claims[].{k}[]": "STRING" for k in ("fragment_ids", "applies_if")}
    known = F.col("path").isin(*types)
    right = F.lit(False)
    for path, kind in types.items():
        allowed = (kind.strip("[]"), "VOID") if kind.startswith("[") else (kind,)
        right = right | ((F.col("path") == path) & F.col("kind").isin(*allowed))
    long = F.lit(False)
    for path, (least, most) in LENGTHS.items():
        long = long | ((F.col("path") == path) & ~F.length("text").between(least, most))
    return ~known | ~right | F.coalesce(long, F.lit(False))


def checked_drafts(raw: DataFrame, row_id: str, text: str) -> DataFrame:
    """(row_id, reason, n_claims): the first of REASONS that a draft gives, or null for a sound one.

    A null or blank text is EMPTY. A key that stands twice in one object is invalid.
    """
    bare = raw.select(row_id, unfenced(F.coalesce(text, F.lit(""))).alias("bare"))
    parsed = bare.withColumn("v", F.try_parse_json("bare"))
    tree = nodes(parsed.where("v is not null"), row_id, "v")
    at = lambda *paths: F.col("path").isin(*paths)
    claim = F.regexp_extract("place", r"^(\$\.claims\[\d+\])", 1)
    flags = tree.groupBy(row_id).agg(
        F.bool_or(F.lower("key").isin(*FORBIDDEN)).alias("forbidden"),
        F.bool_or(_out_of_shape()).alias("unshaped"),
        F.bool_or(at(*[f"$.{k}" for k in INDICATORS]) & F.coalesce(F.lower("text").isin(*BUSINESS), F.lit(False))).alias("business"),
        F.count_if(at("$.claims[]")).alias("n_claims"),
        *[F.count_if(at(f"$.claims[].{k}")).alias(f"n_{k}") for k in REQUIRED],
        F.count_distinct(F.when(at("$.claims[].fragment_ids[]"), claim)).alias("n_backed"),
        F.count_distinct(F.when(at("$.claims[].claim_id"), F.col("text"))).alias("n_ids"),
    )
    joined = parsed.join(flags, row_id, "left")
    n = F.coalesce("n_claims", F.lit(0))
    lacking = F.lit(False)
    for c in (*[f"n_{k}" for k in REQUIRED], "n_backed"):
        lacking = lacking | (F.coalesce(c, F.lit(0)) < n)
    no = F.lit(False)
    tests = (F.col("bare") == "", F.col("v").isNull(), _kind(F.col("v")) != "OBJECT", F.coalesce("forbidden", no), F.coalesce("unshaped", no) | lacking, F.coalesce("business", no), F.coalesce("n_ids", F.lit(0)) < n)
    reason = F.coalesce(*[F.when(test, F.lit(name)) for test, name in zip(tests, REASONS, strict=True)])
    return joined.select(row_id, reason.alias("reason"), F.when(reason.isNull(), n).alias("n_claims"))
