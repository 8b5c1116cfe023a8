"""Streams over events, run to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import feed
from ..sources.tables import table
from ..sources.written import shared_folder
from ..streaming import keyed, machine
from ..streaming.runs import read_stream, run_once
from .registered import query


@query("""
WITH f AS (SELECT user_id || ':' || event_type AS key, event_id, props AS content, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn,
           first_value(props) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS first FROM events)
SELECT key, event_id, CASE WHEN rn = 1 THEN 'NEW' WHEN content = first THEN 'IDEMPOTENT' ELSE 'CONFLICT' END AS status FROM f
""")
def replay_stream_equiv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed intake as a stream; the SQL is its batch form."""
    facts = read_stream(spark, sf_dir, "events")
    named = facts.select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("key"), "event_id", F.col("props").alias("content"))
    return run_once(keyed.intake(named))


@query("""
WITH u AS (SELECT user_id AS case_id, event_id AS revision, CASE WHEN event_type = 'purchase' THEN value END AS stage, CASE WHEN event_type = 'signup' THEN props END AS specialist FROM events)
SELECT case_id, revision, last_value(stage IGNORE NULLS) OVER w AS stage, last_value(specialist IGNORE NULLS) OVER w AS specialist, TRUE AS applied
FROM u WINDOW w AS (PARTITION BY case_id ORDER BY revision ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
""")
def status_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    updates = read_stream(spark, sf_dir, "events").select(
        F.col("user_id").alias("case_id"), F.col("event_id").alias("revision"), F.when(kind == "purchase", F.col("value")).alias("stage"), F.when(kind == "signup", F.col("props")).alias("specialist")
    )
    return run_once(keyed.status_ingest(updates))


@query("""
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:00') AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2
""")
def session_stream_demo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts with a watermark; in complete mode, so the last windows are there too."""
    counted = run_once(keyed.spikes(read_stream(spark, sf_dir, "events")), "complete")
    return counted.select(F.date_format("window.start", "yyyy-MM-dd HH:00").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


#: Stand-in commands: views start turns, clicks publish and errors fail a revision, large purchases complete the case.
_COMMAND = "CASE event_type WHEN 'view' THEN 'START' WHEN 'click' THEN 'PUBLISH' WHEN 'error' THEN 'FAIL' WHEN 'purchase' THEN 'COMPLETE' END"
_TTL_MINUTES = 720


@query(f"""
WITH c AS (SELECT user_id AS case_id, event_id, epoch_ms(ts) AS ms, {_COMMAND} AS command, 1 + CAST(json_extract(props, '$.k') AS BIGINT) % 8 AS target FROM events
           WHERE event_type <> 'signup' AND (event_type <> 'purchase' OR value > 60)),
done AS (SELECT (SELECT max(epoch_ms(ts)) FROM events) AS now),
n AS (SELECT *, coalesce(sum(CASE WHEN command = 'COMPLETE' THEN 1 ELSE 0 END) OVER (PARTITION BY case_id ORDER BY ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 AS closed FROM c, done WHERE ms < now),
r AS (SELECT *, sum(CASE WHEN command = 'START' AND NOT closed THEN 1 ELSE 0 END) OVER (PARTITION BY case_id ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) AS revision FROM n),
t AS (SELECT case_id, revision, event_id AS turn, ms AS opened, lead(ms) OVER (PARTITION BY case_id ORDER BY revision) AS next_at FROM r WHERE command = 'START' AND NOT closed),
h AS (SELECT r.*, t.turn, t.opened, t.next_at, command IN ('PUBLISH', 'FAIL') AND target = r.revision AND ms < opened + {_TTL_MINUTES * 60_000} AS hit FROM r LEFT JOIN t ON t.case_id = r.case_id AND t.revision = r.revision),
f AS (SELECT *, coalesce(hit, FALSE) AND row_number() OVER (PARTITION BY case_id, revision, hit ORDER BY ms, event_id) = 1 AS first FROM h),
e AS (SELECT t.*, bool_or(coalesce(f.first, FALSE)) AS answered FROM t LEFT JOIN f ON f.case_id = t.case_id AND f.revision = t.revision GROUP BY ALL)
SELECT case_id, event_id, CAST(revision AS BIGINT) AS revision, CASE WHEN command = 'START' THEN CASE WHEN closed THEN 'REJECTED' ELSE 'STARTED' END WHEN command = 'COMPLETE' THEN CASE WHEN closed THEN 'IGNORED' ELSE 'COMPLETED' END
       WHEN first THEN CASE command WHEN 'PUBLISH' THEN 'PUBLISHED' ELSE 'FAILED' END ELSE 'IGNORED' END AS outcome FROM f
UNION ALL
SELECT case_id, turn, CAST(revision AS BIGINT), CASE WHEN next_at < opened + {_TTL_MINUTES * 60_000} THEN 'SUPERSEDED' ELSE 'STALE' END FROM e, done
WHERE NOT answered AND (next_at < opened + {_TTL_MINUTES * 60_000} OR opened + {_TTL_MINUTES * 60_000} < now)
""")
def case_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases as a state machine with timers over the stream of events; the SQL folds the same commands in batch."""
    kind = F.col("event_type")
    command = F.when(kind == "view", "START").when(kind == "click", "PUBLISH").when(kind == "error", "FAIL").when((kind == "purchase") & (F.col("value") > 60), "COMPLETE")
    target = 1 + F.get_json_object("props", "$.k").cast("long") % 8
    at = F.col("ts").cast("timestamp")
    # rows without a command go along for the time they tell
    commands = read_stream(spark, sf_dir, "events").select(F.col("user_id").alias("case_id"), "event_id", at.alias("at"), command.alias("command"), target.alias("target"))
    return run_once(machine.case_machine(commands, _TTL_MINUTES), state_store=machine.ROCKS)


@query("""
WITH done AS (SELECT (max(epoch_ms(ts)) - 600000) AS now FROM events),
hours AS (SELECT event_type AS kind, epoch_ms(date_trunc('hour', ts)) AS start_ms, count(*) AS n FROM events GROUP BY 1, 2),
grid AS (SELECT kind, unnest(generate_series(min(start_ms), max(start_ms), 3600000)) AS start_ms FROM hours GROUP BY 1),
filled AS (SELECT g.kind, g.start_ms, coalesce(h.n, 0) AS n, h.n IS NOT NULL AS seen FROM grid g LEFT JOIN hours h ON h.kind = g.kind AND h.start_ms = g.start_ms),
w AS (SELECT *, count(*) OVER p AS m, sum(n) OVER p AS s, sum(n * n) OVER p AS q FROM filled WINDOW p AS (PARTITION BY kind ORDER BY start_ms ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)),
d AS (SELECT *, s / m AS mean, CASE WHEN m > 0 THEN sqrt(greatest(q / m - (s / m) * (s / m), 0.0)) END AS deviation FROM w)
SELECT kind, start_ms, n, round(mean, 6) AS mean, round(deviation, 6) AS deviation, coalesce(m >= 6 AND n > mean + 2.0 * deviation, FALSE) AS spike FROM d, done WHERE seen AND start_ms + 3600000 <= now
""")
def spike_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours of each kind of event against the day before them, as a stream; the SQL looks back over windows."""
    events = read_stream(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.col("ts").cast("timestamp").alias("at"))
    found = run_once(machine.spikes(events), state_store=machine.ROCKS)
    return found.select("kind", "start_ms", "n", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"), "spike")


@query("""
WITH cursors AS (SELECT user_id, min(event_id) AS cursor FROM events WHERE event_type = 'signup' GROUP BY 1)
SELECT e.event_id, e.user_id AS case_id, e.event_type, e.props AS payload FROM events e JOIN cursors c ON c.user_id = e.user_id AND e.event_id > c.cursor
""")
def feed_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events pushed into a feed of messages and polled from it, behind the cursor of each case (here: its first signup)."""
    columns = "event_id", F.col("user_id").alias("case_id"), "event_type", F.col("props").alias("payload")
    path = shared_folder(spark, "feed")
    sent = read_stream(spark, sf_dir, "events").select(*columns)
    feed.push(sent, path, shared_folder(spark, "feed-marks"))
    rows = table(spark, sf_dir, "events").where("event_type = 'signup'")
    cursors = rows.groupBy(F.col("user_id").alias("case_id")).agg(F.min("event_id").alias("cursor"))
    behind = feed.poll(spark, path, sent.schema).join(cursors, "case_id").where("event_id > cursor")
    return run_once(behind.select("event_id", "case_id", "event_type", "payload"))
