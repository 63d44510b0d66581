"""Registered streaming queries (T1-T4): each runs its Structured Streaming
job to completion over the ``events`` flow landed by day (availableNow) and
returns the sink as a batch DataFrame; the oracle is the batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.fixtures import tables
from ..streaming import audit as T
from .registry import register

# Longer than the 30-day span of the fixture flow, so no row is late.
WATERMARK = "40 days"


def _flow(spark, d, name, run, events=None):
    """Lands the events by day, runs the stream over them, and returns its output folder; the landing zone and the
    checkpoint go when the run is over."""
    landing, out, ckpt = T.new_run_dirs(spark, name)
    events = tables(spark, d).raw("events") if events is None else events
    run(T.land_by_day(events, landing), out, ckpt)
    T.discard(spark, landing, ckpt)
    return out


@register("audit_stream_ingest", "SELECT * FROM audit_log")
def q_audit_stream_ingest(spark, d):
    return spark.read.parquet(_flow(spark, d, "ingest", lambda src, out, ckpt: T.audit_stream_ingest(
        spark, src, WATERMARK, out, ckpt, max_files=5)))


# Every third event is delivered again a day later, every fifth nine days later (some a third time).
@register("audit_ingest_repeats", "SELECT * FROM audit_log")
def q_audit_ingest_repeats(spark, d):
    ev = tables(spark, d).raw("events").withColumn("arrival", F.col("ts").cast("date"))
    flow = ev.unionByName(ev.where("event_id % 3 = 0").withColumn("arrival", F.date_add("arrival", 1))).unionByName(
        ev.where("event_id % 5 = 0").withColumn("arrival", F.date_add("arrival", 9)))
    return T.ingested_audit(spark, _flow(spark, d, "repeats", lambda src, out, ckpt: T.audit_keyed_ingest(
        spark, src, out, ckpt, max_files=5), flow))


@register("audit_daily_counts", "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n_events FROM events GROUP BY 1, 2")
def q_audit_daily_counts(spark, d):
    return T.current_daily_counts(spark, _flow(spark, d, "daily", lambda src, out, ckpt: T.audit_daily_counts(
        spark, src, WATERMARK, out, ckpt, max_files=5)))


# Append mode with a 1-day watermark over files in event-time order: exactly the
# day windows that end at or before max(ts) - 1 day are final and emitted.
@register("audit_daily_windows", """
SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n_events FROM events
WHERE date_trunc('day', ts) + INTERVAL '1' DAY <= (SELECT max(ts) FROM events) - INTERVAL '1' DAY GROUP BY 1, 2""")
def q_audit_daily_windows(spark, d):
    return spark.read.parquet(_flow(spark, d, "windows", lambda src, out, ckpt: T.audit_daily_counts_append(
        spark, src, "1 day", out, ckpt, max_files=5)))


@register("request_state_stream", """
SELECT actor_id, target_id, status, occurred_at, log_id FROM (
 SELECT actor_id, TRY_CAST(json_extract_string(metadata, '$.k') AS BIGINT) AS target_id,
  CASE event_type WHEN 'REQUEST_SUBMITTED' THEN 'Pending' WHEN 'REQUEST_APPROVED' THEN 'Approved'
   WHEN 'REQUEST_DENIED' THEN 'Denied' WHEN 'ACCESS_REVOKED' THEN 'Revoked' END AS status, occurred_at, log_id,
  row_number() OVER (PARTITION BY actor_id, TRY_CAST(json_extract_string(metadata, '$.k') AS BIGINT)
   ORDER BY occurred_at DESC, log_id DESC) AS rn
 FROM audit_log WHERE event_type IN ('REQUEST_SUBMITTED','REQUEST_APPROVED','REQUEST_DENIED','ACCESS_REVOKED')) WHERE rn = 1""")
def q_request_state_stream(spark, d):
    out = _flow(spark, d, "state", lambda src, out, ckpt: T.request_state_stream(spark, src, "1 day", out, ckpt, max_files=5))
    T.compact_request_state(spark, out)
    return T.current_request_state(spark, out)


# Approvals here are valid 20 days so warnings and expiries fire inside the 30-day flow.
# Oracle: per key, approvals in time order; a timer fires when it falls before the
# key's next approval and before the final watermark
# (latest approval time - 1 day), all in epoch milliseconds.
@register("expiry_sweep_stream", """
WITH appr AS (
 SELECT DISTINCT actor_id, TRY_CAST(json_extract_string(metadata, '$.k') AS BIGINT) AS target_id, epoch_us(occurred_at) // 1000 AS a
 FROM audit_log WHERE event_type = 'REQUEST_APPROVED'),
wm AS (SELECT max(a) - 86400000 AS w FROM appr),
h AS (SELECT actor_id, target_id, a,
       LEAST(COALESCE(lead(a) OVER (PARTITION BY actor_id, target_id ORDER BY a), (SELECT w FROM wm)), (SELECT w FROM wm)) AS horizon FROM appr)
SELECT actor_id, target_id, 'Expiring' AS kind, epoch_ms(a) AS approved_at, epoch_ms(a + 6 * 86400000) AS fire_at
FROM h WHERE a + 6 * 86400000 < horizon
UNION ALL
SELECT actor_id, target_id, 'Expired', epoch_ms(a), epoch_ms(a + 20 * 86400000) FROM h WHERE a + 20 * 86400000 < horizon""")
def q_expiry_sweep_stream(spark, d):
    out = _flow(spark, d, "expiry", lambda src, out, ckpt: T.expiry_sweep_stream(
        spark, src, "1 day", out, ckpt, valid_days=20, warn_days=14, max_files=5))
    return spark.read.parquet(out).select(
        "actor_id", "target_id", "kind", T.ms_to_wall_clock(F.col("approved_ms")).alias("approved_at"),
        T.ms_to_wall_clock(F.col("fire_ms")).alias("fire_at"))
