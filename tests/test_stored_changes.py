"""Bucketed tables, access over time and robust outliers."""

import datetime as dt
import os
import random
import statistics
import uuid

import pytest
from pyspark.sql import functions as F

from stewardlake.operators import access as A
from stewardlake.operators import demand as D
from stewardlake.operators import intervals as I
from stewardlake.plans.params import requests_as_of
from stewardlake.session import checkpoint_subdir
from stewardlake.sources.bucketed import BucketedTable
from stewardlake.sources.fixtures import tables


def _files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def _same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.fixture()
def stored(spark, sf_small):
    name = f"t_requests_{uuid.uuid4().hex[:8]}"
    table = BucketedTable(spark, name, checkpoint_subdir(spark, name), ["requester_id"], buckets=4, parts=16)
    yield table.create(tables(spark, sf_small).access_requests)
    table.drop()


def test_a_batch_rewrites_the_parts_it_names(spark, sf_small, stored):
    requests = tables(spark, sf_small).access_requests
    assert _same(stored.read(), requests)
    before = _files(stored.path)
    who = requests.agg(F.min("requester_id")).first()[0]
    ids = requests.where(F.col("requester_id") == who).select("request_id")
    for named, by in ((spark.createDataFrame([(who,)], "requester_id long"), ["requester_id"]), (ids, ["request_id"])):
        parts = stored.change(named, by, lambda old: old.withColumn(
            "status", F.when(F.col("requester_id") == who, "Denied").otherwise(F.col("status"))))
        after = _files(stored.path)
        touched = {os.path.basename(os.path.dirname(f)) for f in before ^ after}
        assert len(parts) == 1 and touched == {f"part={parts[0]}"}
        before = after
    want = requests.withColumn("status", F.when(F.col("requester_id") == who, "Denied").otherwise(F.col("status")))
    assert _same(stored.read(), want)
    # a part of which nothing is left goes, and its rows come back as an addition
    part = stored.parts_of(ids.withColumn("requester_id", F.lit(who)))[0]
    gone = stored.read().where(F.pmod(F.hash("requester_id"), F.lit(16)) == part).checkpoint()
    assert stored.change(gone.select("requester_id"), ["requester_id"], lambda old: old.where(F.lit(False))) == [part]
    assert stored.read().count() == want.count() - gone.count()
    assert stored.add(gone) == [part] and _same(stored.read(), want)
    assert stored.change(ids.limit(0), ["request_id"], lambda old: old) == []


def test_joins_and_states_on_the_key_shuffle_no_requests(spark, sf_small, stored):
    """W1 over the stored table: no exchange; J1's joins: none above its scan, and users come to its buckets."""
    t = tables(spark, sf_small)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        state = A.access_state(stored.read(), t.users, requests_as_of())
        detail = A.requests_detail(stored.read(), t.data_products, t.users)
        for df in (state, detail):
            lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
            scan = next(i for i, x in enumerate(lines) if "FileScan parquet" in x and stored.name in x)
            depth = next(k for k, ch in enumerate(lines[scan]) if ch.isalnum() or ch == "*")
            above = []
            for x in reversed(lines[:scan]):
                at = next((k for k, ch in enumerate(x) if ch.isalnum() or ch == "*"), 0)
                if at < depth:
                    above.append(x)
                    depth = at
            assert not [x for x in above if "Exchange" in x and "Broadcast" not in x], above
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert _same(A.access_state(stored.read(), t.users, requests_as_of()), A.access_state(t.access_requests, t.users, requests_as_of()))


def _day(n):
    return dt.datetime(2000, 1, 1) + dt.timedelta(days=n)


def test_intervals_and_calls_against_plain_loops(spark):
    rnd = random.Random(8)
    rows = []
    for i in range(400):
        a, end = rnd.randint(0, 900), rnd.choice([None, rnd.randint(-5, 120)])
        user = 1 if i % 3 == 0 else rnd.randint(2, 9)
        rows.append((user, rnd.randint(1, 3), rnd.choice(["Approved", "Approved", "Denied"]), _day(a), _day(a + 1) if i % 7 else None,
                     None if end is None or i % 40 == 0 else _day(a + 1 + end)))
    req = spark.createDataFrame(rows, "requester_id long, product_id long, status string, requested_at timestamp_ntz, "
                                      "resolved_at timestamp_ntz, expires_at timestamp_ntz")
    far = dt.datetime(9999, 12, 31)
    held = {}
    for u, p, s, asked, done, end in rows:
        a, b = done or asked, end or far
        if s == "Approved" and a < b:
            held.setdefault((u, p), []).append((a, b))
    want = []
    for key, spans in held.items():
        merged = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1][1], merged[-1][2] = max(merged[-1][1], b), merged[-1][2] + 1
            else:
                merged.append([a, b, 1])
        want += [(*key, *m) for m in merged]
    intervals = I.access_intervals(req)
    assert sorted(map(tuple, intervals.collect())) == sorted(want)

    calls = [(i, 1 if i % 3 == 0 else rnd.randint(2, 10), rnd.randint(1, 4), _day(rnd.randint(-100, 1500))) for i in range(1500)]
    calls += [(9000 + 2 * k + j, u, p, t) for k, (u, p, a, b, _) in enumerate(want) for j, t in enumerate((a, b))]  # both ends
    df = spark.createDataFrame(calls, "call_id long, user_id long, product_id long, called_at timestamp_ntz")
    ok = {i: next((w[2] for w in want if w[:2] == (u, p) and w[2] <= t < w[3]), None) for i, u, p, t in calls}
    got = I.calls_with_access(df, intervals).collect()
    assert len(got) == len(calls) and all(r["from_at"] == ok[r["call_id"]] for r in got)
    assert {r["call_id"] for r in I.calls_without_access(df, intervals).collect()} == {i for i, a in ok.items() if a is None}
    assert I.calls_with_access(df.limit(0), intervals).count() == 0
    plan = I.calls_with_access(df, intervals)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "Cartesian" not in plan


def test_one_extreme_among_five_days(spark):
    """A lone extreme stretches mean and deviation so far that its z is under 2; from the median it is far."""
    rows = [("a", dt.date(2024, 1, i + 1), q) for i, q in enumerate([10.0, 11.0, 9.0, 10.5, 500.0])]
    rows += [("same", dt.date(2024, 1, i + 1), 3.0) for i in range(4)] + [("same", dt.date(2024, 1, 9), 4.0), ("null", dt.date(2024, 1, 1), None)]
    usage = spark.createDataFrame(rows, "usage_type string, usage_date date, usage_quantity double")
    assert D.billing_outliers(usage.where("usage_type = 'a'"), 2.0).count() == 0
    for sketch in (False, True):
        got = {(r["usage_type"], r["qty"]): r["robust_z"] for r in D.billing_outliers_robust(usage, sketch=sketch).collect()}
        assert set(got) == {("a", 500.0), ("same", 4.0)} and got["same", 4.0] == float("inf")


def test_sketched_medians_are_near_the_exact_ones(spark):
    rnd = random.Random(4)
    values = {g: [rnd.lognormvariate(g, 1) for _ in range(5000)] for g in range(3)}
    df = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs], "g int, v double").repartition(7)
    exact = {r["g"]: r for r in D.robust_scores(df, ["g"], "v").groupBy("g").agg(F.first("median").alias("m"), F.first("mad").alias("d")).collect()}
    rough = {r["g"]: r for r in D.robust_scores(df, ["g"], "v", True).groupBy("g").agg(F.first("median").alias("m"), F.first("mad").alias("d")).collect()}
    for g, vs in values.items():
        assert abs(exact[g]["m"] - statistics.median(vs)) < 1e-9
        assert abs(exact[g]["d"] - statistics.median(abs(v - statistics.median(vs)) for v in vs)) < 1e-9
        rank = sum(v <= rough[g]["m"] for v in vs) / len(vs)
        assert abs(rank - 0.5) < 0.02
        assert abs(rough[g]["d"] / exact[g]["d"] - 1) < 0.1
