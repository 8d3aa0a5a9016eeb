"""Queries of the streaming jobs, and of tightened text."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators.text import tightened
from tracewell.registry import query
from tracewell.sources.model import BLOCKS_SQL, blocks, table
from tracewell.streaming import jobs


def _events(spark, sf_dir, watermark="10 minutes"):
    return jobs.event_stream(spark, f"{sf_dir}/events.parquet", watermark)


@query("SELECT event_id, user_id, event_type FROM events")
def r01_event_stream(spark, sf_dir):
    return jobs.drained(_events(spark, sf_dir).select("event_id", "user_id", "event_type"), "r01")


@query("SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id, max_by(event_type, (ts, event_id)) AS event_type, max_by(value, (ts, event_id)) AS value, count(*) AS calls FROM events GROUP BY user_id")
def r02_progress_snapshot(spark, sf_dir):
    return jobs.drained(jobs.snapshots(_events(spark, sf_dir)), "r02", "complete")


@query("SELECT event_id, CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 WHEN 'purchase' THEN 4 WHEN 'error' THEN 0 END AS step, event_type IN ('signup', 'view', 'click') AS is_active, event_type = 'purchase' AS is_complete FROM events")
def r03_stage_mapping(spark, sf_dir):
    return jobs.drained(jobs.staged(_events(spark, sf_dir)).select("event_id", "step", "is_active", "is_complete"), "r03")


@query("WITH g AS (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS next FROM events) SELECT user_id, ts AS last_beat FROM g WHERE next - ts > INTERVAL 6 HOUR")
def r04_lease_expiry(spark, sf_dir):
    """Silences over 6 hours that a later beat ended; the last one of a user is open until its timeout fires."""
    ends = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("of_user")).agg(F.max("ts").alias("end"))
    found = jobs.drained(jobs.expired_leases(_events(spark, sf_dir), 6 * 3600), "r04")
    return found.join(ends.hint("merge"), F.col("user_id") == F.col("of_user")).where(F.col("last_beat") < F.col("end")).select("user_id", "last_beat")


@query("SELECT user_id, event_type, props FROM events GROUP BY ALL")
def r05_dispatch_dedup(spark, sf_dir):
    """A watermark longer than the log, so that each request counts once in all of it."""
    return jobs.drained(jobs.distinct_dispatches(_events(spark, sf_dir, "400 days")).select("user_id", "event_type", "props"), "r05")


@query(
    "WITH p AS (SELECT * FROM events WHERE event_type = 'purchase'), v AS (SELECT * FROM events WHERE event_type = 'view') SELECT p.event_id, p.user_id, v.event_id AS s_event_id FROM p LEFT JOIN v "
    "ON p.user_id = v.user_id AND v.ts >= p.ts AND v.ts <= p.ts + INTERVAL 1 HOUR WHERE p.ts < (SELECT least((SELECT max(ts) FROM p), (SELECT max(ts) FROM v))) - INTERVAL 3 HOUR"
)
def r06_reservation_matching(spark, sf_dir):
    """Reservations whose time is surely over: an outer stream join holds the latest back until the watermark passes them."""
    log = table(spark, sf_dir, "events")
    purchases = _events(spark, sf_dir).where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    settled = _events(spark, sf_dir).where("event_type = 'view'").select(F.col("event_id").alias("s_event_id"), F.col("user_id").alias("s_user_id"), F.col("ts").alias("s_ts"))
    over = log.agg(F.least(F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))), F.max(F.when(F.col("event_type") == "view", F.col("ts")))).alias("over"))
    found = jobs.drained(jobs.matched(purchases, settled, "1 HOUR").select("event_id", "user_id", "s_event_id", "ts"), "r06")
    return found.crossJoin(F.broadcast(over)).where(F.col("ts") < F.col("over") - F.expr("INTERVAL 3 HOUR")).select("event_id", "user_id", "s_event_id")


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS calls, round(sum(value), 2) AS amount FROM events WHERE event_type <> 'signup' GROUP BY 1")
def r07_day_spending(spark, sf_dir):
    return jobs.drained(jobs.day_spending(_events(spark, sf_dir).where("event_type <> 'signup'")), "r07", "complete")


@query(
    "WITH l AS (SELECT user_id, event_id, ts, event_type, sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events) "
    "SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN (row_number() OVER (PARTITION BY user_id, island ORDER BY ts, event_id) - CASE WHEN island > 0 THEN 1 ELSE 0 END)::INT ELSE 0 END AS streak FROM l"
)
def r08_fault_streaks(spark, sf_dir):
    return jobs.drained(jobs.fault_streaks(_events(spark, sf_dir)), "r08")


@query()
def r09_streaming_admission(spark, sf_dir):
    """Rows only: a fold in which rejected requests consume nothing (tested against a plain loop)."""
    return jobs.drained(jobs.admission(_events(spark, sf_dir), 2_000.0), "r09")


@query()
def r10_file_intake(spark, sf_dir):
    """Rows only: the small dimension files of the data folder as binary files with their digests."""
    return jobs.drained(jobs.accepted_files(spark, sf_dir, "{region,nation,supplier}.parquet"), "r10")


@query(
    "WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 2 HOUR THEN 1 ELSE 0 END AS fresh FROM events), "
    "i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS island FROM g) SELECT user_id, count(DISTINCT island) AS sessions, count(*) AS beats FROM i GROUP BY user_id"
)
def r11_heartbeat_sessions(spark, sf_dir):
    found = jobs.drained(jobs.sessions(_events(spark, sf_dir), "2 hours"), "r11", "complete")
    return found.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("beats").cast("long").alias("beats"))


@query("SELECT user_id, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'error') <= 10 AS passed FROM events GROUP BY user_id")
def r12_incremental_audit(spark, sf_dir):
    errors = F.count_if(F.col("event_type") == "error").alias("errors")
    return jobs.incremental_audit(_events(spark, sf_dir), [errors], F.col("errors") <= 10, "r12")


@query(f"WITH {BLOCKS_SQL} SELECT material_id, block_id, sha256(regexp_replace(regexp_replace(markdown, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) AS sha FROM blocks")
def t15_tightened(spark, sf_dir):
    return blocks(spark, sf_dir).select("material_id", "block_id", F.sha2(tightened(F.col("markdown")), 256).alias("sha"))
