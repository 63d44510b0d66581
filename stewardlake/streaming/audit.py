"""Structured Streaming jobs over the audit-event flow.

The source is a folder of parquet files with the ``events`` schema (the
audit log's landing zone); the fixture's ``events`` table is written by day to
drive it. Watermarks need a ``timestamp`` column, so the
``timestamp_ntz`` event time is turned into the instant with the same UTC
wall clock (not a session-time-zone cast); the watermark delay must be
longer than the disorder of the input, or late rows are dropped (the
count is reported from the query progress).

Every query keeps its checkpoint under the shared ``spark.checkpoint.dir``
so a restarted driver or lost executor resumes where it stopped, and sinks
are written idempotently per epoch.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_subdir, use_rocksdb_state
from ..sources.fixtures import audit_log_from_events
from . import changelog, expiry

EVENTS_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"

#: The table of ``audit_keyed_ingest``.
KEYED_SCHEMA = ("log_id bigint, event_type string, actor_id bigint, metadata string, occurred_at timestamp_ntz, "
                "day date, epoch string")

# Event type -> request status (the event flow's meaning for a request).
STATUS_BY_EVENT = [
    ("REQUEST_SUBMITTED", "Pending"),
    ("REQUEST_APPROVED", "Approved"),
    ("REQUEST_DENIED", "Denied"),
    ("ACCESS_REVOKED", "Revoked"),
]


@dataclass
class StreamRun:
    output: str
    checkpoint: str
    rows_dropped_by_watermark: int = 0
    batches: int = 0
    state_rows: list[int] = field(default_factory=list)  # after each batch


def land_by_day(events: DataFrame, folder: str, reverse: bool = False) -> str:
    """Writes the events as a landing zone with one folder per day of arrival, in one job, and returns the pattern of
    these folders. A day is one file, or a few of Spark's advisory size: with a file for each day of every task that
    reads the events, the batches of the stream would grow with the input. ``arrival`` (a date) is a row's day of arrival, the day of ``ts`` if there is no such column. Files
    get modification times in the order of days (or the reverse, for late data): that is the order of the stream."""
    spark = events.sparkSession
    day = F.col("arrival") if "arrival" in events.columns else F.col("ts").cast("date")
    (events.withColumn("day", F.date_format(day, "yyyyMMdd")).drop("arrival").hint("rebalance", "day")
     .write.mode("overwrite").partitionBy("day").parquet(folder))
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    days = sorted((s.getPath() for s in fs.listStatus(path(folder)) if s.isDirectory()), key=lambda p: p.getName(), reverse=reverse)
    for rank, p in enumerate(days):
        for f in fs.listStatus(p):
            fs.setTimes(f.getPath(), 1_000_000_000_000 + 1000 * rank, -1)
    return f"{folder}/day=*"


EPOCH_NTZ = "1970-01-01 00:00:00"


def event_time(ts_ntz: str) -> F.Column:
    """The watermark column: the instant whose UTC wall clock equals the
    time-zone-free event time (independent of the session time zone, unlike
    a plain cast)."""
    micros = F.timestamp_diff("MICROSECOND", F.lit(EPOCH_NTZ).cast("timestamp_ntz"), F.col(ts_ntz))
    return F.timestamp_micros(micros)


def ms_to_wall_clock(ms: F.Column) -> F.Column:
    """Epoch milliseconds to the time-zone-free wall clock."""
    return F.lit(EPOCH_NTZ).cast("timestamp_ntz") + F.make_dt_interval(secs=(ms / F.lit(1000)).cast("decimal(18,6)"))


def wall_clock(instant: F.Column) -> F.Column:
    """Back from such an instant to the time-zone-free wall clock."""
    secs = (F.unix_micros(instant) / F.lit(1_000_000)).cast("decimal(18,6)")
    return F.lit(EPOCH_NTZ).cast("timestamp_ntz") + F.make_dt_interval(secs=secs)


def _event_stream(spark: SparkSession, landing_glob: str, max_files: int | None) -> DataFrame:
    use_rocksdb_state(spark)
    r = spark.readStream.schema(EVENTS_SCHEMA)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(landing_glob).withColumn("event_time", event_time("ts"))


def _field(progress, name: str):
    return progress.get(name) if isinstance(progress, dict) else getattr(progress, name)


def _run(q) -> StreamRun:
    q.awaitTermination()
    run = StreamRun(output="", checkpoint="")
    for p in q.recentProgress:
        run.batches += 1
        run.state_rows.append(sum(_field(op, "numRowsTotal") for op in _field(p, "stateOperators") or []))
        for op in _field(p, "stateOperators") or []:
            run.rows_dropped_by_watermark += int(_field(op, "numRowsDroppedByWatermark") or 0)
    return run


def audit_stream_ingest(spark: SparkSession, landing_glob: str, watermark: str, out: str, ckpt: str,
                        max_files: int | None = 1) -> StreamRun:
    """Append audit rows, dropping duplicate log ids within the watermark."""
    ev = _event_stream(spark, landing_glob, max_files)
    audit = audit_log_from_events(ev).withColumn("event_time", event_time("occurred_at"))
    deduped = audit.withWatermark("event_time", watermark).dropDuplicatesWithinWatermark(["log_id"]).drop("event_time")
    q = (deduped.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt)
         .outputMode("append").trigger(availableNow=True).start())
    run = _run(q)
    run.output, run.checkpoint = out, ckpt
    return run


def audit_keyed_ingest(spark: SparkSession, landing_glob: str, out: str, ckpt: str, max_files: int | None = 1) -> StreamRun:
    """T1 without a horizon: every log id once, however late a row or its repeat arrives, and no state.

    The table is kept by day and epoch (of this checkpoint). Each micro-batch is
    reduced to one row per log id and anti-joined with the days it touches, but
    for its own epoch; a repeat has its event's time, so its first delivery is
    among these. A retried epoch replaces its own partitions, so a restart adds
    nothing, nor does the whole flow read again with a new checkpoint.
    ``ingested_audit`` reads the table."""
    audit = audit_log_from_events(_event_stream(spark, landing_glob, max_files)).withColumn("day", F.to_date("occurred_at"))

    stream = hashlib.md5(ckpt.encode()).hexdigest()[:8]

    def write(batch: DataFrame, epoch: int) -> None:
        own = batch.sparkSession
        first = batch.dropDuplicates(["log_id"])
        days = [r["day"] for r in batch.select("day").distinct().collect()]
        if not days:
            return
        known = _table_or_none(own, out)
        if known is not None:
            there = known.where(F.col("day").isin(days) & (F.col("epoch") != f"{stream}-{epoch}")).select("day", "log_id")
            first = first.join(there, ["day", "log_id"], "left_anti")
        (first.withColumn("epoch", F.lit(f"{stream}-{epoch}")).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("day", "epoch").parquet(out))

    q = audit.writeStream.foreachBatch(write).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    run = _run(q)
    run.output, run.checkpoint = out, ckpt
    return run


def _table_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return None
    return spark.read.schema(KEYED_SCHEMA).parquet(path)


def ingested_audit(spark: SparkSession, out: str) -> DataFrame:
    """The table that ``audit_keyed_ingest`` keeps."""
    return spark.read.schema(KEYED_SCHEMA).parquet(out).drop("day", "epoch")


def audit_daily_counts(spark: SparkSession, landing_glob: str, watermark: str, out: str, ckpt: str,
                       max_files: int | None = 1) -> StreamRun:
    """Events per type per day. The day is taken from the time-zone-free
    event time. Update mode: a trigger writes only the counts that it changed,
    as an epoch of a changelog; ``current_daily_counts`` takes the last one of
    each day and type, ``compact_daily_counts`` folds the log. The state is one
    row per day and type."""
    ev = _event_stream(spark, landing_glob, max_files).withWatermark("event_time", watermark)
    audit = ev.select(F.col("ts").cast("date").cast("timestamp_ntz").alias("day"), F.col("event_type"))
    counts = audit.groupBy("day", "event_type").agg(F.count(F.lit(1)).alias("n_events"))
    q = (counts.writeStream.foreachBatch(changelog.append_epochs(out)).option("checkpointLocation", ckpt)
         .outputMode("update").trigger(availableNow=True).start())
    run = _run(q)
    run.output, run.checkpoint = out, ckpt
    return run


def _last_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("day", "event_type").agg(F.max_by("n_events", "epoch").alias("n_events"))


def current_daily_counts(spark: SparkSession, out: str) -> DataFrame:
    return _last_counts(changelog.changes(spark, out))


def compact_daily_counts(spark: SparkSession, out: str) -> int | None:
    return changelog.compact(spark, out, _last_counts)


def audit_daily_counts_append(spark: SparkSession, landing_glob: str, watermark: str, out: str, ckpt: str,
                              max_files: int | None = 1) -> StreamRun:
    """T2 in append mode: tumbling one-day event-time windows; a window is
    emitted once, when the watermark passes its end, and its state is then
    dropped (bounded state for an unbounded flow). Windows still open when
    the input ends are not emitted yet; late rows behind the watermark are
    dropped and counted."""
    ev = _event_stream(spark, landing_glob, max_files).withWatermark("event_time", watermark)
    counts = ev.groupBy(F.window("event_time", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n_events"))
    out_df = counts.select(wall_clock(F.col("w.start")).alias("day"), "event_type", "n_events")
    q = (out_df.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt)
         .outputMode("append").trigger(availableNow=True).start())
    run = _run(q)
    run.output, run.checkpoint = out, ckpt
    return run


def _status_expr(col):
    e = None
    for et, st in STATUS_BY_EVENT:
        e = F.when(col == et, st) if e is None else e.when(col == et, st)
    return e


def request_state_stream(spark: SparkSession, landing_glob: str, watermark: str, out: str, ckpt: str,
                         max_files: int | None = 1, ttl: str = "7 days") -> StreamRun:
    """The latest status per (actor, target) from the event flow.

    A streaming aggregate keeps max(occurred_at, log_id, status) per key and
    ``ttl`` period; once the watermark has passed a period's end its rows leave
    the state, so the state is bounded by the keys of the last periods, not by
    all keys ever seen. Update mode emits only the keys a micro-batch changed,
    and the sink appends them as an epoch of a changelog, so each trigger writes
    work proportional to the batch. ``current_request_state`` folds base and log
    to the current table (the largest time wins, whatever period it is from) and
    ``compact_request_state`` folds the log into a new base."""
    ev = _event_stream(spark, landing_glob, max_files)
    audit = audit_log_from_events(ev).withColumn("event_time", event_time("occurred_at")).withWatermark("event_time", watermark)
    keyed = audit.select(
        "actor_id", F.get_json_object("metadata", "$.k").cast("bigint").alias("target_id"), "event_time",
        F.struct(F.col("occurred_at"), F.col("log_id"), _status_expr(F.col("event_type")).alias("status")).alias("e"),
    ).filter(F.col("e.status").isNotNull())
    latest = keyed.groupBy(F.window("event_time", ttl), "actor_id", "target_id").agg(F.max("e").alias("e")).drop("window")
    q = (latest.writeStream.foreachBatch(changelog.append_epochs(out)).option("checkpointLocation", ckpt)
         .outputMode("update").trigger(availableNow=True).start())
    run = _run(q)
    run.output, run.checkpoint = out, ckpt
    return run


def _latest_state(rows: DataFrame) -> DataFrame:
    return rows.groupBy("actor_id", "target_id").agg(F.max("e").alias("e"))


def compact_request_state(spark: SparkSession, out: str) -> int | None:
    return changelog.compact(spark, out, _latest_state)


def current_request_state(spark: SparkSession, out: str) -> DataFrame:
    """Per key the largest (time, log id, status) of the base and the epochs after it."""
    return _latest_state(changelog.changes(spark, out)).select(
        "actor_id", "target_id", F.col("e.status").alias("status"),
        F.col("e.occurred_at").alias("occurred_at"), F.col("e.log_id").alias("log_id"))


def expiry_sweep_stream(spark: SparkSession, landing_glob: str, watermark: str, out: str, ckpt: str,
                        valid_days: int = 90, warn_days: int = 14, max_files: int | None = 1) -> StreamRun:
    """T4: per approved (actor, target), an 'Expiring' event ``warn_days`` before expiry and an 'Expired' event at
    expiry (see ``expiry``; the batch twin is U2). A later approval of the same key restarts its clock; the older
    approval's timers that fall before it still fire."""
    ev = _event_stream(spark, landing_glob, max_files)
    audit = audit_log_from_events(ev).withColumn("event_time", event_time("occurred_at"))
    appr = audit.filter(F.col("event_type") == "REQUEST_APPROVED").select(
        "actor_id", F.get_json_object("metadata", "$.k").cast("bigint").alias("target_id"), "event_time",
        F.unix_millis("event_time").alias("event_ms")).withWatermark("event_time", watermark)
    fired = expiry.expiry_events(appr, warn_days * 86_400_000, valid_days * 86_400_000)
    q = (fired.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt)
         .outputMode("append").trigger(availableNow=True).start())
    run = _run(q)
    run.output, run.checkpoint = out, ckpt
    return run


def new_run_dirs(spark: SparkSession, name: str) -> tuple[str, str, str]:
    """Fresh (landing, output, checkpoint) folders under the shared checkpoint dir."""
    base = checkpoint_subdir(spark, f"stream-{name}-{uuid.uuid4().hex[:12]}")
    return f"{base}/landing", f"{base}/out", f"{base}/ckpt"


def discard(spark: SparkSession, *folders: str) -> None:
    """Removes run folders that nothing reads any more."""
    for folder in folders:
        p = spark._jvm.org.apache.hadoop.fs.Path(folder)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
