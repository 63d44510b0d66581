"""Streaming jobs against their batch twins, in and out of event-time order."""

from pyspark.sql import functions as F

from stewardlake.sources.fixtures import tables
from stewardlake.streaming import audit as T
from stewardlake.streaming import changelog

SF = "/root/testdata/sf0.001"


def _landing(spark, name, reverse, events=None):
    landing, out, ckpt = T.new_run_dirs(spark, name)
    events = tables(spark, SF).raw("events") if events is None else events
    return T.land_by_day(events, landing, reverse=reverse), out, ckpt


def _same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_landing_files_come_in_the_order_of_days(spark):
    src, out, _ = _landing(spark, "t-order", reverse=False)
    seen = []
    q = (spark.readStream.schema(T.EVENTS_SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
         .writeStream.foreachBatch(lambda b, _: seen.append(b.agg(F.min("ts"), F.max("ts")).first()))
         .option("checkpointLocation", out).trigger(availableNow=True).start())
    q.awaitTermination()
    assert len(seen) == 30 and all(x[1] < y[0] for x, y in zip(seen, seen[1:]))


def test_repeats_in_the_delay_and_long_after_come_once(spark):
    ev = tables(spark, SF).raw("events").withColumn("arrival", F.col("ts").cast("date"))
    late = ev.where("event_id % 4 = 0").withColumn("arrival", F.date_add("arrival", 12))  # first delivery after 12 days
    flow = (ev.where("event_id % 4 != 0").unionByName(late).unionByName(ev.where("event_id % 3 = 0"))
            .unionByName(ev.where("event_id % 6 = 0").withColumn("arrival", F.date_add("arrival", 1)))
            .unionByName(ev.where("event_id % 5 = 0").withColumn("arrival", F.date_add("arrival", 20))))
    src, out, ckpt = _landing(spark, "t-keyed", False, flow)
    run = T.audit_keyed_ingest(spark, src, out, ckpt, max_files=7)
    assert run.batches > 5
    assert _same(T.ingested_audit(spark, out), tables(spark, SF).audit_log)
    # the same checkpoint again: nothing new; the whole flow once more from the start: repeats only
    T.audit_keyed_ingest(spark, src, out, ckpt, max_files=7)
    T.audit_keyed_ingest(spark, src, out, ckpt + "-2", max_files=50)
    assert _same(T.ingested_audit(spark, out), tables(spark, SF).audit_log)


def test_ingest_in_order_keeps_every_row(spark):
    src, out, ckpt = _landing(spark, "t-in-order", reverse=False)
    run = T.audit_stream_ingest(spark, src, "1 day", out, ckpt, max_files=8)
    assert spark.read.parquet(out).count() == tables(spark, SF).raw("events").count()
    assert run.rows_dropped_by_watermark == 0


def test_ingest_reversed_short_watermark_drops_late_rows(spark):
    """Files arriving newest first with a 1-day watermark: late rows are lost
    (and reported), which is why the delay must exceed the disorder."""
    src, out, ckpt = _landing(spark, "t-rev-short", reverse=True)
    run = T.audit_stream_ingest(spark, src, "1 day", out, ckpt, max_files=8)
    kept = spark.read.parquet(out).count()
    total = tables(spark, SF).raw("events").count()
    assert kept < total
    assert run.rows_dropped_by_watermark == total - kept


def test_ingest_reversed_long_watermark_equals_batch(spark):
    src, out, ckpt = _landing(spark, "t-rev-long", reverse=True)
    T.audit_stream_ingest(spark, src, "40 days", out, ckpt, max_files=8)
    got = spark.read.parquet(out)
    want = tables(spark, SF).audit_log
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_daily_counts_equal_batch_twin_even_reversed(spark):
    src, out, ckpt = _landing(spark, "t-daily", reverse=True)
    T.audit_daily_counts(spark, src, "1 day", out, ckpt, max_files=8)
    got = T.current_daily_counts(spark, out)
    ev = tables(spark, SF).raw("events")
    want = ev.groupBy(F.col("ts").cast("date").cast("timestamp_ntz").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n_events"))
    assert got.count() == 150
    assert _same(got, want)
    T.compact_daily_counts(spark, out)
    assert _same(T.current_daily_counts(spark, out), want)


def test_expiry_timers_fire_in_order(spark):
    src, out, ckpt = _landing(spark, "t-expiry", reverse=False)
    T.expiry_sweep_stream(spark, src, "1 day", out, ckpt, valid_days=20, warn_days=14, max_files=8)
    fired = spark.read.parquet(out)
    rows = fired.collect()
    assert rows, "timers should fire within the 30-day flow"
    day = 86_400_000
    for r in rows:
        delta = r["fire_ms"] - r["approved_ms"]
        assert delta == (6 * day if r["kind"] == "Expiring" else 20 * day)
    # every expiry was preceded by its warning
    exp = fired.filter("kind = 'Expired'").select("actor_id", "target_id", "approved_ms")
    warn = fired.filter("kind = 'Expiring'").select("actor_id", "target_id", "approved_ms")
    assert exp.exceptAll(warn).count() == 0
    # nothing fires past the final watermark (max event time - 1 day)
    max_ms = tables(spark, SF).raw("events").select(F.unix_millis(F.max(T.event_time("ts")))).first()[0]
    assert max(r["fire_ms"] for r in rows) <= max_ms - day


def _batch_state(audit):
    status = T._status_expr(F.col("event_type"))
    keyed = audit.select("actor_id", F.get_json_object("metadata", "$.k").cast("bigint").alias("target_id"),
                         F.struct("occurred_at", "log_id", status.alias("status")).alias("e")).filter("e.status IS NOT NULL")
    return keyed.groupBy("actor_id", "target_id").agg(F.max("e").alias("e")).select(
        "actor_id", "target_id", "e.status", "e.occurred_at", "e.log_id")


def test_request_state_leaves_the_state_and_stays_in_the_table(spark):
    src, out, ckpt = _landing(spark, "t-state", reverse=False)
    run = T.request_state_stream(spark, src, "1 day", out, ckpt, max_files=2, ttl="4 days")
    assert run.batches > 10 and run.rows_dropped_by_watermark == 0
    assert max(run.state_rows) > 2 * min(run.state_rows[8:])  # closed periods are gone
    assert any(b < a for a, b in zip(run.state_rows, run.state_rows[1:]))
    assert _same(T.current_request_state(spark, out), _batch_state(tables(spark, SF).audit_log))


def test_compaction_switches_the_version_and_later_epochs_follow(spark):
    ev = tables(spark, SF).raw("events")
    half = ev.select(F.date_add(F.min("ts").cast("date"), 15)).first()[0]
    src, out, ckpt = _landing(spark, "t-compact", False, ev.where(F.col("ts") < F.lit(half)))
    T.request_state_stream(spark, src, "1 day", out, ckpt, max_files=3)
    first = _batch_state(tables(spark, SF).audit_log.where(F.col("occurred_at") < F.lit(half)))
    assert changelog.versions(spark, out)[0] is None and len(changelog.versions(spark, out)[1]) > 3
    through = T.compact_request_state(spark, out)
    assert changelog.versions(spark, out) == (through, [])
    assert _same(T.current_request_state(spark, out), first)
    assert T.compact_request_state(spark, out) is None  # nothing to fold
    # more days for the same stream: the reader opens the base and the epochs after it
    ev.where(F.col("ts") >= F.lit(half)).coalesce(1).write.parquet(src[:-1] + "99991231")
    T.request_state_stream(spark, src, "1 day", out, ckpt, max_files=1)
    base, epochs = changelog.versions(spark, out)
    assert base == through and epochs and min(epochs) > through
    whole = _batch_state(tables(spark, SF).audit_log)
    assert _same(T.current_request_state(spark, out), whole)
    # a base whose job did not end has no _SUCCESS and is not seen; old epochs go with the second compaction after them
    T.current_request_state(spark, out).limit(1).write.parquet(f"{out}/base/through=000000999")
    T.discard(spark, f"{out}/base/through=000000999/_SUCCESS")
    assert changelog.versions(spark, out)[0] == through
    T.discard(spark, f"{out}/base/through=000000999")
    last = T.compact_request_state(spark, out)
    assert changelog._numbers(spark, f"{out}/base", "through") == [through, last]
    assert all(e > through for e in changelog._numbers(spark, f"{out}/log", "epoch"))
    assert _same(T.current_request_state(spark, out), whole)


def test_daily_counts_append_emits_closed_windows_only(spark):
    """Append mode with a 1-day watermark, files in event-time order: every
    window ending after max(ts) - 1 day is still open, the rest are final."""
    src, out, ckpt = _landing(spark, "t-daily-append", reverse=False)
    T.audit_daily_counts_append(spark, src, "1 day", out, ckpt, max_files=8)
    got = spark.read.parquet(out)
    ev = tables(spark, SF).raw("events")
    max_ts = ev.select(F.max("ts")).first()[0]
    import datetime as dt
    horizon = max_ts - dt.timedelta(days=1)
    want = (ev.withColumn("day", F.col("ts").cast("date").cast("timestamp_ntz"))
            .filter(F.col("day") + F.expr("INTERVAL 1 DAY") <= F.lit(horizon))
            .groupBy("day", "event_type").agg(F.count(F.lit(1)).alias("n_events")))
    got_ntz = got.select("day", "event_type", "n_events")
    assert got_ntz.exceptAll(want).count() == 0 and want.exceptAll(got_ntz).count() == 0
    assert 0 < got.count() < 150


def test_expiry_output_does_not_depend_on_batching(spark):
    """The same in-order flow in 1-day, 8-day and single micro-batches gives the
    oracle's rows (timers fire by event time, not by batch boundaries)."""
    import __spark_entry__ as E
    from tools.oracle_check import canon, duck

    cur = duck(SF).execute(E.oracle_sql()["expiry_sweep_stream"])
    want = canon([d[0] for d in cur.description], cur.fetchall())
    for max_files in (1, 8, 100):
        src, out, ckpt = _landing(spark, f"t-expiry-{max_files}", reverse=False)
        T.expiry_sweep_stream(spark, src, "1 day", out, ckpt, valid_days=20, warn_days=14, max_files=max_files)
        got = spark.read.parquet(out).select(
            "actor_id", "target_id", "kind", T.ms_to_wall_clock(F.col("approved_ms")).alias("approved_at"),
            T.ms_to_wall_clock(F.col("fire_ms")).alias("fire_at"))
        assert canon(got.columns, [tuple(r) for r in got.collect()]) == want, max_files


FLOWS = [
    # the same three approvals in all orders and batches: 6.9 restarts the clock of day 1 before its warning on day 7
    [[1.0, 6.9, 7.1]], [[1.0], [6.9], [7.1]], [[1.0], [7.1], [6.9]], [[7.1, 1.0, 6.9]], [[1.0], [7.1, 6.9]],
    # a gap in which the warning of day 1 is due before the next approval
    [[1.0], [7.5], [8.0]],
    # an approval waits while the earlier one is already warned: both timers of each, but the first one's end
    [[1.0], [], [7.8, 10.0]], [[1.0, 1.0], [7.8], [10.0], [10.0]], [[10.0, 1.0, 7.8]],
    # repeats
    [[1.0, 1.0], [1.0]],
]
PACE = [1.5, 7.2, 8.1, 12.0, 14.0, 16.0, 18.5, 40.0]  # approvals of another key that move the watermark


def _timers(times, end, warn=6.0, valid=20.0):
    """What the approvals of a key fire before ``end``: a timer is silent if a later approval came up to its time."""
    times = sorted(set(times))
    out = []
    for a, b in zip(times, [*times[1:], None]):
        out += [(kind, a, a + after) for kind, after in (("Expiring", warn), ("Expired", valid))
                if a + after < end and (b is None or a + after < b)]
    return sorted(out)


def _run_flows(spark, name, max_files):
    import datetime as dt

    start = dt.datetime(2024, 3, 1)
    rows = [(start + dt.timedelta(days=t), k, start.date() + dt.timedelta(days=i))
            for k, flow in enumerate(FLOWS) for i, batch in enumerate(flow) for t in batch]
    rows += [(start + dt.timedelta(days=t), 1000 + i, start.date() + dt.timedelta(days=i)) for i, t in enumerate(PACE)]
    events = spark.createDataFrame([(n, t, u, "purchase", 0.0, '{"k": 2}', day) for n, (t, u, day) in enumerate(rows)],
                                   T.EVENTS_SCHEMA + ", arrival date").coalesce(1)
    src, out, ckpt = _landing(spark, name, False, events)
    T.expiry_sweep_stream(spark, src, "7 days", out, ckpt, valid_days=20, warn_days=14, max_files=max_files)
    zero = (start - dt.datetime(1970, 1, 1)) // dt.timedelta(milliseconds=1)
    found = {}
    for r in spark.read.parquet(out).collect():
        day = [round((r[c] - zero) / 86_400_000, 4) for c in ("approved_ms", "fire_ms")]
        found.setdefault(r["actor_id"], []).append((r["kind"], *day))
    return found


def test_timers_of_waiting_approvals_in_all_orders_and_batches(spark):
    """Every approval has its own timers, whatever waits and however the rows are dealt out."""
    for max_files in (1, 3, 100):
        found = _run_flows(spark, f"t-timers-{max_files}", max_files)
        for k, flow in enumerate(FLOWS):
            want = _timers([t for batch in flow for t in batch], 33.0)
            assert sorted(found.get(k, [])) == want, (max_files, flow)


def test_a_timer_is_decided_from_the_list():
    """Approvals on days 1 and 10: the warning of day 7 and of day 16, no end on day 21, an end on day 30."""
    from stewardlake.streaming.expiry import fired

    assert fired([1, 10], 7, 14, 20) == [("Expiring", 1)]
    assert fired([10, 1], 16, 14, 20) == [("Expiring", 10)]
    assert fired([1, 10], 21, 14, 20) == [] and fired([1, 10], 30, 14, 20) == [("Expired", 10)]
    assert fired([1, 7], 7, 14, 20) == []  # an approval at the time of the warning restarts the clock
    assert fired([1, 15], 21, 14, 20) == [("Expiring", 15)]  # the end of day 1 falls on the same time, and is silent
    assert fired([], 21, 14, 20) == []


def test_late_rows_of_counts_are_reported(spark):
    src, out, ckpt = _landing(spark, "t-state-late", reverse=True)
    run = T.request_state_stream(spark, src, "1 day", out, ckpt, max_files=8, ttl="2 days")
    assert run.rows_dropped_by_watermark > 0
