"""Operational analytics: windows of time, cases, turns, events, work queues.

Stand-ins: events for the event log (user_id is the case), orders and lineitem for cases and
turns, conversations for timelines with roles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import cases, grouping
from ..sources.tables import table
from .registered import query

START, STOP = "2024-01-05 00:00:00", "2024-01-20 00:00:00"
NOW = "1998-10-01 00:00:00"


@query("""
SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS total, count(*) FILTER (WHERE event_type = 'error') AS errors,
       count(*) FILTER (WHERE event_type = 'purchase') AS purchases, count(*) FILTER (WHERE event_type = 'signup') AS signups,
       count(*) FILTER (WHERE value > 100) AS large
FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' GROUP BY 1
""")
def day_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where(grouping.within("ts", START, STOP))
    kind = F.col("event_type")
    return grouping.day_counts(rows, "ts", {"errors": kind == "error", "purchases": kind == "purchase", "signups": kind == "signup", "large": F.col("value") > 100})


@query("""
SELECT (SELECT count(*) FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20') AS n_events,
       (SELECT count(*) FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1997-07-01') AS n_cases,
       (SELECT count(*) FROM orders o WHERE o_orderstatus = 'O' AND (o_orderdate >= TIMESTAMP '1997-06-01'
          OR EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R' AND l.l_quantity > 45))) AS n_open,
       (SELECT count(DISTINCT owner) FROM (SELECT user_id AS owner FROM events UNION ALL SELECT o_custkey FROM orders)) AS n_owners
""")
def window_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, orders, lines = (table(spark, sf_dir, t) for t in ("events", "orders", "lineitem"))
    n_events = events.where(grouping.within("ts", START, STOP)).agg(F.count("*").alias("n_events"))
    n_cases = orders.where(grouping.within("o_orderdate", "1997-01-01", "1997-07-01")).agg(F.count("*").alias("n_cases"))
    returned = lines.where("l_returnflag = 'R' and l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("returned", F.lit(True))
    kept = orders.where("o_orderstatus = 'O'").join(returned, "o_orderkey", "left")
    n_open = kept.where((F.col("o_orderdate") >= F.lit("1997-06-01").cast("timestamp_ntz")) | F.col("returned")).agg(F.count("*").alias("n_open"))
    owners = events.select(F.col("user_id").alias("owner")).union(orders.select("o_custkey")).agg(F.count_distinct("owner").alias("n_owners"))
    # four rows of one each
    return n_events.crossJoin(n_cases).crossJoin(n_open).crossJoin(owners)


@query("SELECT event_type AS decision, count(*) AS n FROM events GROUP BY 1")
def decision_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.frequency(table(spark, sf_dir, "events"), F.col("event_type"), "decision")


@query("""
SELECT d.source, CASE WHEN l.quality IS NULL THEN 'NULL' WHEN l.quality = 1 THEN 'TRUE' ELSE 'FALSE' END AS solved, count(*) AS n
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1, 2
""")
def tri_state_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    solved = F.when(F.col("quality").isNull(), "NULL").when(F.col("quality") == 1, "TRUE").otherwise("FALSE")
    return rows.groupBy("source", solved.alias("solved")).agg(F.count("*").alias("n"))


@query(r"""
WITH keyed AS (
  SELECT rtrim(regexp_replace(trim(lower(text)), '[ \t\n\r]+', ' ', 'g'), '?!. ') AS question_key, text, role, conv_id * 1000 + turn AS o
  FROM conversations
), decided AS (
  SELECT question_key, role, count(*) AS n, arg_max(text, o) AS text, max(o) AS o FROM keyed WHERE question_key <> '' GROUP BY 1, 2
)
SELECT question_key, CAST(sum(n) AS BIGINT) AS n, arg_max(text, o) AS sample, string_agg(role || '=' || n, ',' ORDER BY role) AS decisions
FROM decided GROUP BY 1
""")
def top_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    key = T.normalize_question(F.col("text"))
    return grouping.repeated_questions(rows, key, "text", "role", F.col("conv_id") * 1000 + F.col("turn"), 1)


@query("""
SELECT e.event_id, e.user_id, e.event_type, coalesce(o.o_orderstatus, '') AS status, coalesce(l.n_lines, 0) AS n_lines
FROM events e LEFT JOIN orders o ON o.o_orderkey = e.event_id
LEFT JOIN (SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY 1) l ON l.l_orderkey = e.event_id
ORDER BY e.ts DESC, e.event_id LIMIT 200
""")
def question_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest 200 questions: the report's size."""
    latest = table(spark, sf_dir, "events").orderBy(F.desc("ts"), "event_id").limit(200)
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("event_id")).agg(F.count("*").alias("n_lines"))
    status = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_orderstatus").alias("status"))
    joined = latest.select("event_id", "user_id", "event_type").join(status, "event_id", "left").join(lines, "event_id", "left")
    return joined.select("event_id", "user_id", "event_type", F.coalesce("status", F.lit("")).alias("status"), F.coalesce("n_lines", F.lit(0)).alias("n_lines"))


@query("""
SELECT d.source, d.lang, count(*) AS n_docs, CAST(sum(coalesce(l.n, 0)) AS BIGINT) AS n_labels, count(DISTINCT d.doc_id) AS n_ids
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM labels GROUP BY 1) l ON l.doc_id = d.doc_id GROUP BY 1, 2
""")
def star_materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.count("*").alias("n"))
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(counted, "doc_id", "left")
    return rows.groupBy("source", "lang").agg(F.count("*").alias("n_docs"), F.sum(F.coalesce("n", F.lit(0))).alias("n_labels"), F.count_distinct("doc_id").alias("n_ids"))


@query("""
SELECT o.o_orderkey AS case_id, c.c_name AS owner, n.n_name AS nation, r.r_name AS region, o.o_totalprice AS price
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey
WHERE o.o_orderstatus = 'F' AND r.r_name = 'ASIA'
""")
def star_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer, nation, region = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    # nations and regions are fixed lists of a few dozen rows
    places = nation.join(F.broadcast(region.where("r_name = 'ASIA'")), F.col("n_regionkey") == F.col("r_regionkey"))
    owners = customer.join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"))
    kept = orders.where("o_orderstatus = 'F'").join(owners, F.col("o_custkey") == F.col("c_custkey"))
    return kept.select(F.col("o_orderkey").alias("case_id"), F.col("c_name").alias("owner"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"), F.col("o_totalprice").alias("price"))


@query("""
SELECT d.lang, count(*) AS n_fragments, count(e.vec_id) AS n_embedded, count(*) FILTER (WHERE e.vec_id IS NULL) AS n_missing
FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id GROUP BY 1
""")
def embedding_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("there"))
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(vectors, "doc_id", "left")
    return rows.groupBy("lang").agg(F.count("*").alias("n_fragments"), F.count("there").alias("n_embedded"), F.count_if(F.col("there").isNull()).alias("n_missing"))


@query("SELECT d.doc_id, d.source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) ORDER BY d.doc_id LIMIT 100")
def pending_evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest hundred without an evaluation: one tick's batch."""
    done = table(spark, sf_dir, "labels").select("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(done, "doc_id", "left_anti").orderBy("doc_id").limit(100)


@query("""
SELECT l.l_orderkey AS case_id, count(*) AS n_missing FROM lineitem l
WHERE NOT EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = l.l_partkey AND p.p_size <= 40) GROUP BY 1
""")
def missing_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose part is not in the snapshot (here: parts up to size 40)."""
    members = table(spark, sf_dir, "part").where("p_size <= 40").select(F.col("p_partkey").alias("l_partkey"))
    lost = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(members, "l_partkey", "left_anti")
    return lost.groupBy(F.col("l_orderkey").alias("case_id")).agg(F.count("*").alias("n_missing"))


@query("""
SELECT nullif(l_returnflag, 'N') AS section, min(l_linenumber) AS page_start, max(l_linenumber) AS page_end, arg_min(l_orderkey, l_linenumber * 100000000 + l_orderkey) AS first_id, count(*) AS n
FROM lineitem GROUP BY 1
""")
def section_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections with their pages; rows without a section (N) form one of their own."""
    rows = table(spark, sf_dir, "lineitem").withColumn("section", F.nullif("l_returnflag", F.lit("N")))
    first = F.min_by("l_orderkey", F.col("l_linenumber") * 100000000 + F.col("l_orderkey")).alias("first_id")
    return rows.groupBy("section").agg(F.min("l_linenumber").alias("page_start"), F.max("l_linenumber").alias("page_end"), first, F.count("*").alias("n"))


@query("""
SELECT o_orderpriority AS corpus, o_orderkey AS snapshot_id, o_orderdate AS created_at FROM (
  SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1
""")
def current_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("corpus"), F.col("o_orderkey").alias("snapshot_id"), F.col("o_orderdate").alias("created_at"))
    return grouping.latest(rows, ["corpus"], F.struct("created_at", "snapshot_id"), ["snapshot_id", "created_at"])


@query("""
SELECT conv_id AS case_id, turn AS revision, role, length(text) AS n_chars FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn = 1
""")
def active_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("case_id"), F.col("turn").alias("revision"), "role", F.length("text").cast("long").alias("n_chars"))
    return grouping.latest(rows, ["case_id"], F.col("revision"), ["revision", "role", "n_chars"])


@query("""
SELECT conv_id AS case_id, turn AS revision, coalesce(lead(turn) OVER w, -1) AS next_revision, lead(turn) OVER w IS NULL AS is_active
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
""")
def superseded_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("case_id"), F.col("turn").alias("revision"))
    return cases.superseded(rows, "case_id", "revision").withColumn("next_revision", F.coalesce("next_revision", F.lit(-1)))


@query("SELECT conv_id AS case_id, arg_min(text, turn) AS first_message FROM conversations WHERE role = 'user' AND trim(text) <> '' GROUP BY 1")
def first_user_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").where("role = 'user' and trim(text) <> ''")
    return rows.groupBy(F.col("conv_id").alias("case_id")).agg(F.min_by("text", "turn").alias("first_message"))


@query("SELECT user_id AS case_id, arg_max(props, event_id) AS payload, max(event_id) AS event_id FROM events WHERE event_type = 'error' GROUP BY 1")
def last_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where("event_type = 'error'")
    return rows.groupBy(F.col("user_id").alias("case_id")).agg(F.max_by("props", "event_id").alias("payload"), F.max("event_id").alias("event_id"))


@query("SELECT user_id AS case_id, count(*) AS unread FROM events WHERE event_type = 'view' AND value > 50 GROUP BY 1")
def unread_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unread (value over 50) notices (views) of each case."""
    rows = table(spark, sf_dir, "events").where("event_type = 'view' and value > 50")
    return rows.groupBy(F.col("user_id").alias("case_id")).agg(F.count("*").alias("unread"))


@query("SELECT event_id AS id, event_type AS message_type, props AS payload FROM events WHERE event_type IN ('signup', 'purchase') AND value >= 10 ORDER BY event_id LIMIT 20")
def outbox_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty oldest undelivered messages: one delivery's batch."""
    rows = table(spark, sf_dir, "events").where("event_type in ('signup', 'purchase') and value >= 10").orderBy("event_id").limit(grouping.clamp(20, 1000))
    return rows.select(F.col("event_id").alias("id"), F.col("event_type").alias("message_type"), F.col("props").alias("payload"))


@query("""
WITH cursors AS (SELECT user_id, min(event_id) AS cursor FROM events WHERE event_type = 'signup' GROUP BY 1)
SELECT e.event_id, e.user_id AS case_id, e.event_type, e.ts FROM events e JOIN cursors c ON c.user_id = e.user_id AND e.event_id > c.cursor
""")
def event_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each case behind its cursor (here: its first signup)."""
    rows = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("case_id"), "event_type", "ts")
    cursors = rows.where("event_type = 'signup'").groupBy("case_id").agg(F.min("event_id").alias("cursor"))
    return rows.join(cursors, "case_id").where("event_id > cursor").select("event_id", "case_id", "event_type", "ts")


@query("""
SELECT o_orderkey AS case_id, date_diff('minute', o_orderdate, TIMESTAMP '1998-10-01') AS age_minutes
FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_orderdate < TIMESTAMP '1998-10-01' - INTERVAL 7 DAY
""")
def stale_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open cases older than seven days at a given time."""
    now = F.lit(NOW).cast("timestamp_ntz")
    rows = table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("O", "P") & (F.col("o_orderdate") < now - F.expr("interval 7 days")))
    return rows.select(F.col("o_orderkey").alias("case_id"), F.timestamp_diff("MINUTE", F.col("o_orderdate"), now).alias("age_minutes"))


@query("""
SELECT o.o_orderkey AS case_id, o.o_custkey AS owner, coalesce(u.unread, 0) AS unread, m.first_message, greatest(o.o_orderdate, m2.last_ship) AS last_activity
FROM orders o
LEFT JOIN (SELECT user_id, count(*) AS unread FROM events WHERE event_type = 'view' GROUP BY 1) u ON u.user_id = o.o_orderkey
LEFT JOIN (SELECT conv_id, arg_min(text, turn) AS first_message FROM conversations WHERE role = 'user' GROUP BY 1) m ON m.conv_id = o.o_orderkey
LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS last_ship FROM lineitem GROUP BY 1) m2 ON m2.l_orderkey = o.o_orderkey
WHERE o.o_orderstatus <> 'F'
""")
def case_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    unread = table(spark, sf_dir, "events").where("event_type = 'view'").groupBy(F.col("user_id").alias("case_id")).agg(F.count("*").alias("unread"))
    said = table(spark, sf_dir, "conversations").where("role = 'user'")
    first = said.groupBy(F.col("conv_id").alias("case_id")).agg(F.min_by("text", "turn").alias("first_message"))
    ship = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("case_id")).agg(F.max("l_shipdate").alias("last_ship"))
    rows = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("case_id"), F.col("o_custkey").alias("owner"), "o_orderdate")
    joined = rows.join(unread, "case_id", "left").join(first, "case_id", "left").join(ship, "case_id", "left")
    return joined.select("case_id", "owner", F.coalesce("unread", F.lit(0)).alias("unread"), "first_message", F.greatest("o_orderdate", "last_ship").alias("last_activity"))


@query("""
WITH counted AS (
  SELECT event_id, user_id AS case_id, event_type = 'error' AS violation,
         coalesce(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS warnings
  FROM events)
SELECT event_id, case_id, CAST(warnings AS BIGINT) AS warnings, violation AND warnings + 1 >= 3 AS closes FROM counted
""")
def moderation_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("case_id"), "event_type")
    return cases.warnings_before(rows, "case_id", "event_id", F.col("event_type") == "error", 3).drop("event_type")


@query("""
WITH marked AS (
  SELECT event_id, user_id AS case_id, event_type, sum(CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island
  FROM events)
SELECT case_id, CAST(island AS BIGINT) AS island, count(*) FILTER (WHERE event_type = 'view') AS clarifications, count(*) FILTER (WHERE event_type = 'view') >= 2 AS limit_reached
FROM marked GROUP BY 1, 2
""")
def clarification_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clarifications (views) since the last answer (purchase or signup)."""
    rows = grouping.islands(table(spark, sf_dir, "events").withColumnRenamed("user_id", "case_id"), ["case_id"], "event_id", F.col("event_type").isin("purchase", "signup"))
    asked = F.count_if(F.col("event_type") == "view")
    return rows.groupBy("case_id", "island").agg(asked.alias("clarifications"), (asked >= 2).alias("limit_reached"))


@query("""
SELECT user_id AS case_id, event_type AS slot, arg_max(value, CASE WHEN value > 100 THEN 1000000000 ELSE 0 END + event_id) AS value FROM events GROUP BY 1, 2
""")
def slot_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slot's value by provenance (over 100: given by the user), then by time."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("case_id"), F.col("event_type").alias("slot"), "value", "event_id")
    return cases.merged_slots(rows, ["case_id", "slot"], "value", (F.col("value") > 100).cast("int"), "event_id")


@query("""
SELECT user_id AS case_id, max(event_id) AS last_revision, arg_max(value, event_id) FILTER (WHERE event_type = 'purchase') AS stage, arg_max(props, event_id) FILTER (WHERE event_type = 'signup') AS specialist
FROM events GROUP BY 1
""")
def sticky_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("case_id"), F.col("event_id").alias("revision"), F.when(F.col("event_type") == "purchase", F.col("value")).alias("stage"), F.when(F.col("event_type") == "signup", F.col("props")).alias("specialist")
    )
    return cases.sticky(rows, "case_id", "revision", ["stage", "specialist"])


@query("""
WITH kinds AS (
  SELECT user_id AS case_id, event_id, CASE event_type WHEN 'purchase' THEN 'COMPLETED_SOLVED' WHEN 'error' THEN 'FEEDBACK_UNSOLVED' WHEN 'signup' THEN 'FEEDBACK_SOLVED' ELSE 'CANCELLED' END AS kind
  FROM events)
SELECT case_id, coalesce(CASE WHEN count(*) FILTER (WHERE kind = 'COMPLETED_SOLVED') > 0 THEN 'RESOLVED' END,
       CASE arg_min(kind, event_id) FILTER (WHERE kind LIKE 'FEEDBACK%') WHEN 'FEEDBACK_SOLVED' THEN 'RESOLVED' WHEN 'FEEDBACK_UNSOLVED' THEN 'UNRESOLVED' END, 'UNKNOWN') AS resolution
FROM kinds GROUP BY 1
""")
def resolution_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "COMPLETED_SOLVED").when(F.col("event_type") == "error", "FEEDBACK_UNSOLVED").when(F.col("event_type") == "signup", "FEEDBACK_SOLVED").otherwise("CANCELLED")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("case_id"), "event_id", kind.alias("kind"))
    return cases.resolution(rows, "case_id", "event_id", "kind")


@query("""
SELECT event_id, least(greatest(CAST(floor(date_diff('second', TIMESTAMP '2024-01-01', ts) / 86400.0) AS INTEGER), 0), 4) AS step FROM events
""")
def handoff_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The demo script's step that is due, one a day."""
    elapsed = F.timestamp_diff("SECOND", F.lit("2024-01-01").cast("timestamp_ntz"), F.col("ts"))
    return table(spark, sf_dir, "events").select("event_id", cases.due_step(elapsed, 86400.0).alias("step"))


@query("""
SELECT event_id, CASE WHEN json_type(props, '$.k') = 'VARCHAR' THEN json_extract_string(props, '$.k') END AS text_field,
       CAST(json_extract_string(props, '$.k') AS BIGINT) AS number_field
FROM events
""")
def payload_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A payload field as text only if it is text, and as a number."""
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", cases.json_text(F.col("props"), "k").alias("text_field"), F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("number_field"))


@query("""
WITH flagged AS (
  SELECT event_id, value < 5 AS insufficient, value >= 5 AND value < 10 AS conditional, value > 200 AS human,
         CASE event_type WHEN 'error' THEN ['role_ambiguity', 'new_flag'] WHEN 'signup' THEN ['KNOWLEDGE_UNAVAILABLE'] WHEN 'purchase' THEN ['TECHNICAL_DIAGNOSIS_REQUIRED'] ELSE [] END AS flags
  FROM events
), coded AS (
  SELECT *, CASE WHEN len(flags) = 2 THEN 'ROLE_AMBIGUITY,UNKNOWN_RISK_FLAG:new_flag' ELSE '' END AS codes, coalesce(flags[1], '') = 'TECHNICAL_DIAGNOSIS_REQUIRED' AS technical FROM flagged)
SELECT event_id,
  CASE WHEN technical THEN 'TECHNICAL_DIAGNOSIS' WHEN human THEN 'CONSULTATION' WHEN insufficient THEN 'COMPLEX_PROCESS' WHEN conditional THEN 'ACCOUNT_OR_STATE_CHECK' ELSE 'CONSULTATION' END AS need,
  CASE WHEN technical THEN 'L2' WHEN human THEN 'L1' WHEN insufficient THEN 'L2' ELSE 'L1' END AS line,
  CASE WHEN technical THEN 'l2-technical' WHEN human THEN 'l1-general' WHEN insufficient THEN 'l2-general' ELSE 'l1-general' END AS queue,
  technical AS engineering,
  CASE WHEN technical THEN 'TECHNICAL_DIAGNOSIS_FLAG' WHEN human THEN 'EXPLICIT_HUMAN_REQUEST' WHEN insufficient AND codes = '' THEN 'INSUFFICIENT_EVIDENCE' WHEN conditional AND codes = '' THEN 'CONDITION_DEPENDENT' ELSE codes END AS reasons
FROM coded
""")
def routing_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    none = F.array().cast("array<string>")
    flags = (
        F.when(kind == "error", F.array(F.lit("role_ambiguity"), F.lit("new_flag")))
        .when(kind == "signup", F.array(F.lit("KNOWLEDGE_UNAVAILABLE")))
        .when(kind == "purchase", F.array(F.lit("TECHNICAL_DIAGNOSIS_REQUIRED")))
        .otherwise(none)
    )
    value = F.col("value")
    decided = cases.routing(value < 5, (value >= 5) & (value < 10), flags, value > 200)
    return table(spark, sf_dir, "events").select("event_id", decided.alias("d")).select("event_id", "d.need", "d.line", "d.queue", "d.engineering", F.array_join("d.reasons", ",").alias("reasons"))


@query("""
SELECT o.o_orderkey AS case_id, count(*) AS n_turns, string_agg(l.l_linenumber || ':' || l.l_returnflag, ',' ORDER BY l.l_linenumber, l.l_returnflag) AS turns
FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY 1
""")
def aggregate_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases with their turns nested, in order."""
    turns = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), "l_linenumber", "l_returnflag")
    held = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"))
    nested = turns.join(held, "case_id").groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag"))).alias("turns"))
    listed = F.transform("turns", lambda t: F.concat_ws(":", t["l_linenumber"].cast("string"), t["l_returnflag"]))
    return nested.select("case_id", F.size("turns").cast("long").alias("n_turns"), F.array_join(listed, ",").alias("turns"))


@query("""
SELECT l.l_orderkey AS case_id, l.l_linenumber AS place, coalesce(p.p_name, CAST(l.l_partkey AS VARCHAR)) AS source, coalesce(p.p_brand, '') AS document
FROM lineitem l LEFT JOIN part p ON p.p_partkey = l.l_partkey AND p.p_size > 10
""")
def evidence_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence ids with their metadata, the id itself where there is none."""
    known = table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand")
    rows = table(spark, sf_dir, "lineitem").join(known, "l_partkey", "left")
    return rows.select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("place"), F.coalesce("p_name", F.col("l_partkey").cast("string")).alias("source"), F.coalesce("p_brand", F.lit("")).alias("document"))


@query("""
WITH c AS (SELECT user_id AS case_id, event_type AS version, count(*) AS n FROM events GROUP BY 1, 2)
SELECT case_id, version, n FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY n DESC, version) AS rn FROM c) WHERE rn = 1
""")
def dominant_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commonest version of each case; of equals the first by name."""
    counted = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("case_id"), F.col("event_type").alias("version")).agg(F.count("*").alias("n"))
    return counted.groupBy("case_id").agg(F.min_by(F.struct("version", "n"), F.struct(-F.col("n"), "version")).alias("row")).select("case_id", "row.*")


@query("SELECT sha256(coalesce(text, '')) AS text_hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_hash"))
    return hashed.groupBy("text_hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query("""
SELECT user_id AS name, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS channels, count(DISTINCT event_type) AS n_channels, count(DISTINCT date_trunc('day', ts)) AS n_days, count(DISTINCT event_type) = 5 AS stable
FROM events GROUP BY 1
""")
def stability_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which channels answer in a case's repeats, and whether all do."""
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("name"))
    found = rows.agg(F.array_sort(F.collect_set("event_type")).alias("c"), F.count_distinct(F.to_date("ts")).alias("n_days"))
    return found.select("name", F.array_join("c", ",").alias("channels"), F.size("c").cast("long").alias("n_channels"), "n_days", (F.size("c") == 5).alias("stable"))


@query("""
WITH last AS (SELECT conv_id AS case_id, arg_max(text, turn) FILTER (WHERE role = 'user') AS question, count(*) AS n_turns FROM conversations GROUP BY 1),
slots AS (SELECT user_id AS case_id, event_type AS slot, count(*) AS value FROM events GROUP BY 1, 2),
known AS (SELECT case_id, string_agg(slot || '=' || value, ',' ORDER BY slot) AS slots FROM slots GROUP BY 1),
cited AS (SELECT o_orderkey AS case_id, o_orderpriority AS sources FROM orders)
SELECT l.case_id, question, n_turns, slots, sources FROM last l LEFT JOIN known k ON k.case_id = l.case_id LEFT JOIN cited c ON c.case_id = l.case_id
""")
def handoff_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("case_id"), F.when(F.col("role") == "user", F.col("turn")).alias("seq"), F.col("text").alias("question"))
    slots = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("case_id"), F.col("event_type").alias("slot")).agg(F.count("*").alias("value"))
    sources = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_orderpriority").alias("source"))
    return cases.handoff_packages(turns, slots, sources, "case_id")


@query("""
WITH t AS (SELECT event_id, CASE WHEN value < 10 THEN 'INSUFFICIENT' WHEN value < 40 THEN 'CONDITION_DEPENDENT' ELSE 'SUFFICIENT' END AS s, event_type = 'error' AS risk, event_id % 4 AS asked, event_type <> 'view' AS verified, value > 200 AS human FROM events)
SELECT event_id, CASE WHEN human THEN 'HANDOFF_OFFER' WHEN s = 'CONDITION_DEPENDENT' AND asked < 2 THEN 'CLARIFY' WHEN s = 'SUFFICIENT' AND verified AND risk THEN 'ANSWER_AND_HANDOFF'
       WHEN s = 'SUFFICIENT' AND verified THEN 'ANSWER' ELSE 'HANDOFF_OFFER' END AS decision FROM t
""")
def turn_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    value, kind = F.col("value"), F.col("event_type")
    sufficiency = F.when(value < 10, "INSUFFICIENT").when(value < 40, "CONDITION_DEPENDENT").otherwise("SUFFICIENT")
    decided = cases.decision(sufficiency, kind == "error", F.col("event_id") % 4, kind != "view", value > 200)
    return table(spark, sf_dir, "events").select("event_id", decided.alias("decision"))


@query("""
SELECT e.event_id, e.user_id AS owner, e.event_type AS type FROM events e
WHERE e.event_type IN ('view', 'click') AND NOT EXISTS (SELECT 1 FROM events a WHERE a.event_type = 'signup' AND a.user_id = e.user_id AND a.event_id = e.event_id + 1)
""")
def notification_inbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notices that were not acknowledged (here: by the owner's next event, a signup)."""
    events = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("owner"), F.col("event_type").alias("type"))
    acks = events.where("type = 'signup'").select((F.col("event_id") - 1).alias("event_id"), "owner")
    return events.where("type in ('view', 'click')").join(acks, ["event_id", "owner"], "left_anti").select("event_id", "owner", "type")
